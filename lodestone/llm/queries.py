"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_threads import OP9_SQL, QUOTED_THREADS_SQL, op9_chat_threads, quoted_threads
from .decontaminate import op7_decontamination
from .language_id import op10_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .minhash_dedup import op5_minhash_dedup
from .packing import op8_packing
from .quality import op4_quality
from .secret_scan import OP2_SQL, SECRET_LEDGER_SQL, op2_secret_scan, secret_ledger
from .sql import OP5_SQL, OP7_SQL
from .suffix_dedup import op1_suffix_dedup
from .training_order import op3_training_order, training_shards

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_training_order": op3_training_order,
    "op4_quality": op4_quality,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_chat_threads": op9_chat_threads,
    "op10_language_id": op10_language_id,
    # the same operators on inputs that the tables lack: a second version set, messages that quote, and shard files
    "secret_ledger": secret_ledger,
    "training_shards": training_shards,
    "quoted_threads": quoted_threads,
}
ORACLE_SQL = {
    "op2_secret_scan": OP2_SQL,
    "op5_minhash_dedup": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_chat_threads": OP9_SQL,
    "secret_ledger": SECRET_LEDGER_SQL,
    "quoted_threads": QUOTED_THREADS_SQL,
}
