import random

import numpy as np

from lodestone.llm.suffix_array import suffix_array


def naive(x):
    return sorted(range(len(x)), key=lambda i: x[i:])


def test_order_matches_sorting():
    rnd = random.Random(5)
    cases = [[], [3], [1, 1, 1, 1], [2, 1, 2, 1, 2], list(b"mississippi"), list(b"abracadabra" * 5), [0, 0, 1, 0, 0, 1, 0]]
    for _ in range(600):
        k = rnd.choice([1, 2, 3, 8, 200])
        part = [rnd.randrange(k) for _ in range(rnd.randint(1, 30))]
        cases.append(part * rnd.choice([1, 1, 2, 5]) + [rnd.randrange(k) for _ in range(rnd.randint(0, 40))])
    for x in cases:
        assert suffix_array(np.array(x, np.int64)).tolist() == naive(x), x


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc] = (len(raw), sum(gone), spans, kept)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(300)] + ["é", "the", "of"]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    passage, base = text(40), text(200)
    rows = [(None, base), (1, None), (2, ""), (3, "short"), (4, "a" * 5000), (5, "a" * 250 + "b" * 250 + "ab" * 200), (6, base), (7, "x" * 99), (8, "x" * 100), (9, "x" * 101)]
    for i in range(10, 60):
        kind = i % 5
        if kind == 0:
            t = text(60) + " " + passage + " " + text(60)
        elif kind == 1:
            w = base.split(" ")
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            t = " ".join(w)
        elif kind == 2:
            t = passage[rnd.randrange(40) :] + text(10) + passage[: rnd.randrange(60, 200)]
        elif kind == 3:
            t = text(150)
        else:
            part = text(12)
            t = part * 6 + text(20) + base[200:500]
        rows.append((i, t))
    return rows


def test_matches_brute_force(spark):
    from lodestone.llm.suffix_dedup import drop_repeats

    rows = corpus(11)
    df = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, doc long, kept string").repartition(4)
    want = brute(rows)
    for hot in (1000, 3):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in drop_repeats(df, bits=1 << 18, hot=hot).collect()}
        assert got == want


def test_ranges_cover_every_place():
    from lodestone.llm.suffix_dedup import SIDE, _ranges

    assert sorted(j for a, b in _ranges() for j in range(a, b + 1)) == list(range(SIDE + 1))


def test_empty_table_and_repeated_rows(spark):
    from lodestone.llm.suffix_dedup import drop_repeats

    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string"), bits=1 << 18).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 90), (1, "ab" * 90)], "doc_id long, text string")
    assert {(r["n_removed"], r["n_spans"]) for r in drop_repeats(twice, bits=1 << 18).collect()} == {(178, 1)}


def test_removing_the_order_breaks_the_result(monkeypatch):
    """Equal windows meet only through the suffix array's order."""
    from lodestone.llm import suffix_dedup

    rnd = random.Random(1)
    piece = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    shared = piece(20)
    left, right = [shared + piece(28) for _ in range(300)], [piece(48) for _ in range(300)]
    for k in range(0, 300, 3):
        right[k] = right[0][:28] + piece(20)
    ones, rank = np.ones(300, np.int64), np.arange(300)
    args = (ones, left, right, 0 * ones, 48 * ones, rank)
    got = suffix_dedup.repeated(*args)
    assert [x != 0 for x in got] == [k % 3 == 0 and k > 0 for k in range(300)] and got[3] == 1 << 20
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: rng.permutation(len(text)))
    rng = np.random.default_rng(1)
    assert (suffix_dedup.repeated(*args) != got).any()


def test_hot_groups_are_dealt_until_they_are_small(spark):
    """200,000 different contexts of one anchor: every group that is left has at most ``hot``, and nothing is lost."""
    from pyspark.sql import functions as F

    from lodestone.llm.suffix_dedup import SIDE, _dealt, _placed

    n = 200_000
    tail = "sha2(cast(id AS string), 256)"
    hot = spark.range(n).selectExpr("7L AS kmer", "id AS doc", "0L AS p", "0L AS least", "48L AS most", f"encode(concat(repeat('a', 11), substring({tail}, 1, 37)), 'utf-8') AS left", "encode(repeat('z', 48), 'utf-8') AS right")
    rest, different = _dealt(hot)
    again, left = _placed(different, 1000)
    assert left.groupBy("gkey").count().agg(F.max("count")).first()[0] <= 1000
    marks = rest.unionByName(again).groupBy("doc").agg(F.expr("bit_or(mask)").alias("m"))
    # places 0 to 11 repeat in all documents but the first; later ones where hex digits agree, which for 20 is chance alone
    assert marks.where("m & 4095 = 4095").count() == n - 1 and SIDE == 48
    want = spark.range(n).selectExpr("id", f"substring({tail}, 1, 4) AS part").groupBy("part").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1)).first()[0]
    assert marks.where(F.expr("shiftright(m, 15) & 1 = 1")).count() == want


def test_many_documents_with_one_passage(spark):
    from lodestone.llm.suffix_dedup import drop_repeats

    rnd = random.Random(4)
    passage = "".join(rnd.choices("abcdefgh ", k=160))
    rows = [(i, "%020x" % rnd.getrandbits(80) + passage + "%06x" % rnd.getrandbits(24)) for i in range(5000)]
    want = brute(rows)
    df = spark.createDataFrame([(str(i).zfill(8), t) for i, t in rows], "doc_id string, text string").repartition(4)
    got = {int(r["doc_id"]): (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in drop_repeats(df, bits=1 << 20, hot=100).collect()}
    assert got == want
