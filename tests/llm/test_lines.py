import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from lodestone.llm.line_dedup import OP6_SQL, drop_common_lines, line_key

ROWS = [(i, f"Header\nline {i}\n  HEADER \n\nfoot{i % 2}") for i in range(12)]
ROWS += [(20, None), (21, ""), (22, "header"), (23, "É\né\n\t"), (24, "same\n" * 12), (25, "x" * 300000 + "\nheader\r")]


def brute(rows, min_docs, min_chars, keep_first):
    seen, first = Counter(), {}
    for doc, t in sorted(rows, key=lambda r: r[0]):
        for k in {line_key(x.encode()).decode() for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                seen[k] += 1
                first.setdefault(k, doc)
    out = {}
    for doc, t in rows:
        lines, kept, used = (t or "").split("\n"), [], set()
        for x in lines:
            k = line_key(x.encode()).decode()
            if len(k) >= max(1, min_chars) and seen[k] >= min_docs:
                if not keep_first or first[k] != doc or k in used:
                    continue
                used.add(k)
            kept.append(x)
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
@pytest.mark.parametrize("min_chars", [1, 5])
def test_matches_brute_force(spark, keep_first, broadcast_bytes, min_chars):
    rows = ROWS + [(30 + i, "\n".join(random.Random(i).choices(["a", "b", "header", "zz zz", ""], k=6))) for i in range(30)]
    df = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, n_lines long, key string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in drop_common_lines(df, min_docs=10, min_chars=min_chars, keep_first=keep_first, broadcast_bytes=broadcast_bytes, bits=1 << 12).collect()}
    assert got == brute(rows, 10, min_chars, keep_first)


def test_sql_agrees(spark):
    documents = pd.DataFrame(ROWS, columns=["doc_id", "text"])  # noqa: F841
    want = {r[0]: r[1:] for r in duckdb.sql(OP6_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in drop_common_lines(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    assert got == want


def test_empty_table_and_repeated_rows(spark):
    assert drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(1, "a\nb")] * 10 + [(None, "a")], "doc_id long, text string")
    assert {r["text"] for r in drop_common_lines(rows).collect()} == {""}
