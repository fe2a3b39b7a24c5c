import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm.packing import SumOfSquares, pack
from lodestone.llm.tokens import encode, vocabulary_path
from lodestone.llm.training_order import feistel, read_slots, training_order, write_shards

RND = random.Random(4)
WORDS = ["the", "Ünïcode", "don't", "\n\n", "  ", "12345", "<|endoftext|>", "…", "naïve", "x" * 50, "‍", "日本語"]
ROWS = [(i, " ".join(RND.choices(WORDS, k=RND.randint(0, 300)))) for i in range(60)] + [(100, None), (101, ""), (102, "long text " * 20000), (102, "long text " * 20000)]


def reference_ids(text):
    t = Tokenizer.from_file(vocabulary_path())
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_tokenizers(spark):
    texts = [t or "" for _, t in ROWS[:62]] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    t = Tokenizer.from_file(vocabulary_path())
    for text in texts:
        assert encode(text, vocabulary_path()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_tile_documents_and_sequences(spark):
    df = spark.createDataFrame([(d, t, d, "k") for d, t in ROWS], "doc_id long, text string, start long, ids string").repartition(3)
    rows = pack(df, window=256).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] == len(r["ids"]) // 4 > 0
            at += r["length"]
        assert at <= 256
    for doc, text in dict(ROWS).items():
        want = [*reference_ids(text), 0]
        copies = 2 if doc == 102 else 1
        got = sorted(docs[doc], key=lambda r: r["start"])
        assert sum(r["length"] for r in got) == copies * len(want)
        for r in got:
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(want)
    total, used = 256 * len(seqs), sum(r["length"] for r in rows)
    assert total - used < 3 * 256  # a short sequence at most for each partition
    assert zlib.crc32(rows[0]["ids"]) >= 0
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    rnd, bins = random.Random(1), SumOfSquares(20)
    for _ in range(3000):
        size = rnd.randint(1, 20)
        before = bins.counts.copy()
        best = min(_sum_after(before, h, size) for h in range(0, 21 - size) if h == 0 or before[h])
        bins.place((0, 0, np.zeros(size), 0))
        assert (bins.counts**2).sum() == best and all(len(o) == c for o, c in zip(bins.open, bins.counts, strict=True))


def _sum_after(counts, h, size):
    c = counts.copy()
    if size < 20:
        c[h] -= h > 0
        if h + size < 20:
            c[h + size] += 1
    return (c**2).sum()


def packed_plainly(texts, window):
    """Sequences of one partition's (id, text) pairs: a dictionary of levels, and the sum of squares worked out for each choice."""
    t, opened, out = Tokenizer.from_file(vocabulary_path()), defaultdict(list), []
    for doc, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), window):
            piece = ids[start : start + window]
            counts = {h: len(x) for h, x in opened.items() if x}

            def after(h, size=len(piece), counts=counts):
                c = defaultdict(int, counts)
                if h:
                    c[h] -= 1
                if h + size < window:
                    c[h + size] += 1
                return sum(x * x for x in c.values())

            choices = [h for h in {0, *counts} if h + len(piece) <= window]
            level = min(choices, key=lambda h: (after(h), -h))
            held = opened[level].pop() if level else []
            held.append((doc, start, piece))
            (out if level + len(piece) == window else opened[level + len(piece)]).append(held)
    rest = [p for h in sorted(opened, reverse=True) for held in opened[h] for p in held]
    flat = [(doc, start + k, x) for doc, start, piece in rest for k, x in enumerate(piece)]
    return [[x for _, _, piece in seq for x in piece] for seq in out] + [[x for _, _, x in flat[a : a + window]] for a in range(0, len(flat), window)]


def partitions(df):
    parts = defaultdict(list)
    for r in df.selectExpr("spark_partition_id() AS part", "doc_id", "text").collect():
        parts[r["part"]].append((r["doc_id"], r["text"]))
    return [parts[k] for k in sorted(parts)]


def want_slots(df, window):
    every = [s for part in partitions(df) for s in packed_plainly(part, window)]
    slots = feistel(np.arange(len(every)), len(every), 20240229)
    out = [b""] * len(every)
    for slot, s in zip(slots.tolist(), every, strict=True):
        out[slot] = np.array(s + [0] * (window - len(s)), "<u2").tobytes()
    return out


def test_sequences_equal_plain_packing(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in pack(df, window=64).collect():
        got[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    own = sorted(b"".join(x for _, x in sorted(pieces)) for pieces in got.values())
    assert own == sorted(np.array(s, "<u4").tobytes() for part in partitions(df) for s in packed_plainly(part, 64))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_keyed_bijection(n):
    x = np.arange(n)
    a, b = feistel(x, n, 1), feistel(x, n, 2)
    assert sorted(a) == list(range(n)) and (feistel(a, n, 1, inverse=True) == x).all()
    assert n < 64 or (a != b).mean() > 0.9 and (a != x).mean() > 0.9


def test_shards_hold_every_sequence_in_slot_order(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    made = training_order(df, window=64, shard_rows=50).persist()
    rows = sorted(made.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    assert all(r["shard_id"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 128 for r in rows)
    manifest = {r["shard_id"]: r["n_rows"] for r in write_shards(made, str(tmp_path / "out")).collect()}
    assert sum(manifest.values()) == len(rows)
    for begin, end in ((0, len(rows)), (47, 53), (len(rows) - 1, len(rows))):
        got = list(read_slots(str(tmp_path / "out"), begin, end, window=64, shard_rows=50))
        assert [g.tobytes() for g in got] == [bytes(r["ids"]) for r in rows[begin:end]]
    tokens = sum(r["n_tokens"] for r in rows)
    assert tokens == sum(len(reference_ids(t)) + 1 for _, t in ROWS)
    assert training_order(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert {r["part"]: r["shard"] for r in made.selectExpr("spark_partition_id() AS part", "shard_id AS shard").distinct().collect()} == {k: k for k in manifest}
    assert manifest == {r["shard_id"]: r["n_rows"] for r in write_shards(made, str(tmp_path / "out")).collect()}  # a second try
    assert want_slots(df, 64) == [bytes(r["ids"]) for r in rows]
    made.unpersist()
    odd = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), (None, "y", 3)], "doc_id string, text string, slot int")
    wide = training_order(odd, window=64, id_bytes=4).collect()
    assert {d for r in wide for d in r["doc_ids"]} == {"a", None} and all(len(r["ids"]) == 256 for r in wide)


def test_long_runs_of_one_character(spark):
    """1,000,000 blanks, line feeds, letters or digits pack like any text, and short runs give the same ids on both ways."""
    from lodestone.llm import tokens

    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "1" * 1_000_000, ("x" * 499 + " ") * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pack(docs).selectExpr("doc_id", "length", "doc_tokens").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(rows) == len(texts) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in rows)
    path = tokens.vocabulary_path()
    for c in (" ", "\n", "q", "字", "!"):
        text = f"one {c * (tokens.RUN - 1)} two"
        assert tokens.encode(text, path).tolist() == tokens._tokenizer(path).encode(text, add_special_tokens=False).ids
