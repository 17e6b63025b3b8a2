"""The pipeline: each stage on what its predecessor kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from shoebox.llm import decontaminate, simhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = d.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF).persist()
        kept[name] = d.count()
        if name != "sharding":
            assert d.columns == columns
        if name == "SimHash near-dedup":
            assert simhash_dedup.near_duplicates(d).where("doc_id <> component_id").count() == 0
        if name == "benchmark decontamination":
            assert decontaminate.contained(d, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    sizes = [r["n"] for r in d.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == kept["mixing sources to target weights"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_run_leaves_its_result_alone_of_all_tables(spark):
    import glob

    from shoebox.plans.lineage import shared_dir

    held = lambda: set(glob.glob(shared_dir(spark).removeprefix("file:") + "/table-*"))
    before = held()
    result = corpus_pipeline.run(spark, SF)
    assert len(held() - before) == 1 and result.count() > 0


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Rows without text, id, language or source, repeated rows, long texts and columns with clashing names end in no crash."""
    (tmp_path / "sf").mkdir()
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "sf/benchmark.parquet"))
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    words = d.first()["text"]
    odd = spark.createDataFrame([(None, words, "en", "a", 1), (900, None, "en", None, 0), (901, "", None, "a", 0), (902, words, "xx", "a", 9), (902, words, "xx", "a", 9), (903, words * 200, "en", None, 2)], d.schema)
    clash = d.unionByName(odd).withColumns({c: F.lit("x") for c in ("_id", "row", "shard_", "md5", "target", "_times")})
    for docs in (clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path / "sf")).persist()
            assert name == "sharding" or docs.columns == columns
        ids = {r["doc_id"] for r in docs.collect()}
        assert ids <= {r["doc_id"] for r in clash.collect()} - {900, 901}
