import corpus_pipeline as p
from lodestone.llm.base import cut

SMALL = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = docs.where("doc_id = 1").first()
    odd = [(9000, None, None, "s", 0), (9001, "", "en", "s", 0), (9002, "12 34", "en", "s", 5), (9003, base["text"], base["lang"], "s", base["n_chars"]), (9004, f"{item}\n{docs.where('doc_id = 6').first()['text'][:200]} zz", "en", "s", 1)]
    odd += [(9100 + i, f"{docs.where('doc_id = 5').first()['text'][i * 40 : i * 40 + 400]}\nShared line of twelve documents\nend{i}", "en", "s", 1) for i in range(12)]
    now = docs.select(*p.COLUMNS).unionByName(spark.createDataFrame(odd, docs.select(*p.COLUMNS).schema))
    seen = {}
    for name, stage in p.STAGES[:-1]:
        now = cut(stage(spark, now, SMALL), name)
        assert now.columns == p.COLUMNS
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    assert not {9000, 9001, 9002} & seen["language_id"].keys() and docs.count() <= len(seen["language_id"])
    shared = [d for d, t in seen["line_dedup"].items() if "Shared line" in t]
    assert shared == [9100]
    assert 9003 in seen["line_dedup"] and 9003 not in seen["near_dedup"] and 1 in seen["near_dedup"]
    assert 9004 in seen["near_dedup"] and 9004 not in seen["decontamination"]
    pieces = p.STAGES[-1][1](spark, now, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == seen["decontamination"].keys()


def test_empty_table(spark):
    now = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for name, stage in p.STAGES:
        now = cut(stage(spark, now, SMALL), name)
        assert now.count() == 0
