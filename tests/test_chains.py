"""Sample call chains against enumeration, also where a hop has more walks than a search starts with."""

import random

from lodestone.operators import graph

CALLS = "caller_name string, callee_name string"


def chains(spark, calls, *args, **kw):
    return [r["chain"] for r in graph.sample_chains(spark.createDataFrame(calls, CALLS), *args, **kw).collect()]


def enumerated(calls, name, max_depth, limit):
    above, out, walks = {}, [], [[name]]
    for caller, callee in calls:
        above.setdefault(callee, set()).add(caller or graph.TOP_LEVEL)
    for depth in range(1, max_depth + 1):
        near = [[*w, c] for w in walks for c in above.get(w[-1], ()) if c not in w]
        out += [w for w in near if depth == max_depth or w[-1] == graph.TOP_LEVEL]
        walks = [w for w in near if w[-1] != graph.TOP_LEVEL]
    return sorted(out, key=lambda w: (len(w), w))[:limit]


def test_chains_through_late_names_are_found(spark):
    calls = [(f"c{k:04d}", "f") for k in range(1500)] + [(None, "c1499"), ("", "c1498")]
    assert chains(spark, calls, "f") == [["f", "c1498", graph.TOP_LEVEL], ["f", "c1499", graph.TOP_LEVEL]]


def test_chains_equal_enumeration_however_few_walks_it_starts_with(spark, monkeypatch):
    monkeypatch.setattr(graph, "WALKS", (1, 3))
    for seed, limit in ((1, 2), (2, 10)):
        rnd = random.Random(seed)
        calls = [(f"n{rnd.randrange(7)}", f"n{rnd.randrange(7)}") for _ in range(16)] + [(None, f"n{rnd.randrange(1, 7)}")]
        assert chains(spark, calls, "n0", 4, limit) == enumerated(calls, "n0", 4, limit)
