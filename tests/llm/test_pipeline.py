"""The stages keep columns, decide what they say, and take odd documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from overlapkit.llm import _shared as S

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = S.materialize(stage(spark, docs, SF))
        assert out.columns == docs.columns
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs = out
    good = {i for i, r in labels.items() if r.quality == 1}
    assert len(good - seen["quality"]) <= 0.02 * len(good)
    assert len(seen["quality"] & (labels.keys() - good)) <= 0.1 * len(labels.keys() - good)
    clean = {i for i in seen["quality"] if i in labels and not labels[i].toxic}
    assert len(clean - seen["toxicity"]) <= 0.02 * len(clean)
    assert seen["mixing"] <= seen["near_dedup"] <= seen["toxicity"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.where("not round_trip").count() == 0 and last.count() == docs.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_documents(spark):
    """Null and repeated ids, null, empty and very long texts, and columns with names that stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.where("doc_id < 40")
    text = "The first line of a plain letter that nobody wrote twice, and that goes on for a while. " * 3
    odd = [(None, text, "en", "a"), (None, text + "more of it", "en", None), (900_001, None, None, None), (900_001, "", "en", "a"), (900_002, "word " * 50_000, "en", "a"), (900_003, " " * 50_000 + "end", "en", "b")]
    rows = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in odd], docs.schema)
    names = ("score", "node", "h1", "again", "shard", "y", "own", "size", "place")
    clash = good.unionByName(rows).unionByName(good.limit(3)).withColumns({c: F.lit("x") for c in names})
    made = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = made[name] = S.materialize(stage(spark, clash, SF))
        assert out.columns == clash.columns, name
        kept = out.count()
        assert 0 < kept <= (3 if name == "mixing" else 1) * clash.count() and out.where("score = 'x' and node = 'x'").count() == kept
    distinct = made["near_dedup"]
    assert distinct.where("doc_id is null").count() == 1 and distinct.groupBy("doc_id").count().where("count > 1").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, clash, SF)
    assert last.count() == clash.count() and last.where("not round_trip").count() == 0
