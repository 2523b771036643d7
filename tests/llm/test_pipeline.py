"""The pipeline's stages, each against a plain version of its decision."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import quality_rules, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.dtypes
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-dedup", "secret scan", "mixing", "packing"]
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], SF).cache()
        assert name == "packing" or out.dtypes == schema
        seen.append(out)
    start, good, single, clean, mixed, packed = seen
    verdict = quality_rules.judged(start, ["doc_id"]).where("kept").select("row.doc_id")
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in verdict.collect()}
    assert {r[0] for r in single.select("doc_id").collect()} == {r["component_id"] for r in simhash.near_duplicates(good).collect()}
    assert clean.count() == single.count() and clean.where(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count() == 0
    untouched = single.join(clean, ["doc_id", "text"]).count()
    assert untouched == single.count() - clean.where(F.contains("text", F.lit("[SECRET]"))).count()
    assert mixed.join(clean, clean.columns, "left_semi").count() == mixed.count() == mixed.select("doc_id").distinct().count()
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d"))
    assert whole.where("n <> d").count() == 0 and whole.count() == mixed.count()
    tokens = lambda df: {tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length")).collect()}
    assert tokens(cp.run(spark, SF)) == tokens(packed)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, columns with names used inside, an empty table: through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    first = docs.where("length(text) > 400").limit(1).collect()[0]
    odd = [(None, first["text"], None, None, None), (9001, None, None, "s", 0), (9002, "", "en", None, 0), (9003, "wort " * 20_000, "de", "s", None), tuple(first), tuple(first)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    docs = docs.select("*", *(F.lit(7).alias(c) for c in ("row", "uid", "fp", "rate", "base", "spans", "word", "part", "n_words", "max_symbols", "component_id")))
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in cp.STAGES:
            out = stage(spark, kept, SF).cache()
            if name == "packing":
                assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").distinct().collect()}
            else:
                assert out.dtypes == docs.dtypes and out.count() <= kept.count()
                assert out.where("row <> 7 or uid <> 7 or rate <> 7").count() == 0
            kept = out
    assert not {9001, 9002, 9003} & {r[0] for r in cp.rules(spark, docs, SF).select("doc_id").collect()}


def test_run_leaves_one_table(spark, tmp_path, monkeypatch):
    """Tables of a stage go when its rows are written, and those rows when the next stage's are."""
    monkeypatch.setattr("tidemark.shared.shared_dir", lambda spark: f"file://{tmp_path}")
    assert cp.run(spark, SF).count() > 0
    left = sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir())
    assert left == ["packing-parts", "packing-tokens", "pipeline-mixing"]
