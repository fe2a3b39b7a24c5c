import itertools
import random

import numpy as np

from lodestone.llm.base import shingle_sets
from lodestone.llm.minhash_dedup import _remaining, components, near_duplicates, sketches


def brute(rows, n=2, percent=80):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            comp[max(ra, rb)] = min(ra, rb)
    return {(d, len(sets[d]), root(d), root(d) == d) for d in sets}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 120))
        for _ in range(rnd.choice([1, 1, 4, 12])):
            copy = list(words)
            for _ in range(rnd.choice([0, 0, 1, 3, 6])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((len(rows), rnd.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "ÉTÉ chaud"), (906, "été chaud"), (907, "w1 " * 30000)]
    return rows


def test_matches_brute_force_with_extra_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, component_id long, kept string").repartition(3)
    for n, percent in ((2, 80), (5, 80), (2, 60)):
        got = {tuple(r) for r in near_duplicates(df, n=n, percent=percent, bands=40 if percent == 80 else 100, rows=5 if percent == 80 else 2).collect()}
        assert got == brute(rows, n, percent)


def test_empty_null_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (0, "a b c"), (None, "a b c"), (None, None), (2, "x y"), (2, "a b c")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(df, n=2).collect()), key=str)
    assert got == sorted([(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (None, 2, None, True), (None, 0, None, True), (2, 1, 0, False), (2, 2, 0, False)], key=str)


def test_repeated_ids_do_not_multiply_and_string_ids_work(spark):
    words = ["v%d" % i for i in range(60)]
    near = [*words[:-1], "other"]
    rows = [("a", " ".join(words))] * 40 + [("b", " ".join(near))] * 40 + [("c", "alone here now")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), n=2).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {("a", "a", True, 40), ("b", "a", False, 40), ("c", "c", True, 1)}


def test_many_near_copies_and_a_stray_cost_in_proportion(spark):
    """The stray is near one copy only: it differs from the centre in too many words, and joins the rest through that copy."""
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(120)]

    def changed(base, at):
        return [("z%d" % rnd.randrange(10**9) if i in at else w) for i, w in enumerate(base)]

    rows = [(0, " ".join(words))]
    for i in range(1, 6000):
        rows.append((i, " ".join(changed(words, {rnd.randrange(60)}))))
    one = changed(words, {70, 80, 90})
    rows += [(6000, " ".join(one)), (6001, " ".join(changed(one, {100, 105, 110, 115}))), (6002, "another text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = {r[0]: r[2] for r in near_duplicates(df, n=2).collect()}
    assert out.pop(6002) == 6002
    assert set(out.values()) == {0} and len(out) == 6002


def test_pairs_across_components_are_dealt_in_proportion(spark):
    """A main component of m members goes out once; each stray goes to all blocks."""
    m, strays = 3000, 3
    stars = spark.range(m + strays).selectExpr("0L AS a", "id + 1 AS b", f"id < {m} AS linked", "100L AS size", f"CASE WHEN id < {m} THEN X'' ELSE unhex(lpad(hex(id), 16, '0')) END AS delta")
    labels = spark.range(m).selectExpr("id + 1 AS id", "0L AS component")
    got = {frozenset(r) for r in _remaining(stars, labels, percent=80).collect()}
    assert len(components(spark.createDataFrame([tuple(x) for x in got], "a long, b long")).where("component = 0").collect()) == strays + 1


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    one, two = np.sort(base[:900]), np.sort(base[100:])
    h, first = np.concatenate((one, two, base[:1])), np.array([0, 900, 1800, 1801])
    s = sketches(h, first, 256)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert len(shingle_sets([b"", b"a"], 5)[0]) == 1


def test_components_of_paths_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    rnd = random.Random(2)
    names = rnd.sample(range(1000, 5000), 300)
    got2 = {tuple(r) for r in components(spark.createDataFrame(list(itertools.pairwise(names)), "a long, b long")).collect()}
    assert got2 == {(i, min(names)) for i in names}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)} | {(200 + i, 200) for i in range(30)}
