"""The stages, each on what the one before kept, against what its operator says of all rows."""

import corpus_pipeline as pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from test_decontam import brute as leaks
from test_neardup import brute as components

from loomstead.llm import quality
from loomstead.llm.common import BATCH_BYTES, materialize, skew_safe_left_join, small_batches


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    for name, stage in pipeline.STAGES[:3]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        after = [r["doc_id"] for r in docs.collect()]
        assert len(after) == len(set(after))
        if name == "quality_classifier":
            want = good
        elif name == "near_duplicates":
            want = {i for i, (_, c) in components(rows).items() if i == c}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            held = {i for i, t in rows for _, x in items if x.lower() in t.lower()}
            assert not held & set(after)
            dropped = [(i, t) for i, t in rows if i not in set(after)]
            assert {i for i, _ in dropped} == {i for i, _ in leaks(items, dropped)} and held
            want = set(after)
        assert set(after) == want and set(after) < kept
        kept = set(after)
    rows = pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == kept
    totals = {}
    for r in rows:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["length"]
    assert all(totals[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_edges(spark, edges, tmp_path):
    edges.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "score", "rank").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (6, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert not {r["doc_id"] for r in rows} & {6, 7}
    # a repeated row goes through once, so its pieces make it up once
    totals = {}
    for r in rows:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["length"]
    assert all(totals[r["doc_id"]] == r["doc_tokens"] for r in rows if r["doc_id"] is not None)
    assert all(r["length"] > 0 and 0 <= r["offset"] <= 2048 - r["length"] for r in rows)
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(empty / f"{name}.parquet"))
    assert pipeline.run(spark, str(empty)).count() == 0


def test_skew_safe_join(spark):
    left = spark.range(20_000).selectExpr("if(id % 3 = 0, 1, id) as k", "id as v")
    right = left.groupBy("k").count().withColumnRenamed("count", "rows").where("k % 7 <> 0").selectExpr("*", "k * 2 as x")
    got = skew_safe_left_join(left, right, ["k"], "rows", 20_000)
    assert got.count() == 20_000 and got.where("k % 7 = 0 AND x IS NOT NULL OR k % 7 <> 0 AND x <> 2 * k OR k % 7 <> 0 AND x IS NULL").count() == 0
    assert sorted(got.columns) == ["k", "v", "x"]


def test_stages_send_texts_in_small_batches(spark, sf_dir):
    """Batches to Python are bounded by bytes, while a stage's last step runs too; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)
    docs = spark.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 40_000).alias("text"))
    try:
        for _, stage in pipeline.STAGES:
            spark.conf.set(key, 64 << 20)
            stage(spark, docs.limit(0), sf_dir)
            got = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r["n"] for r in got) == 64 and max(r["bytes"] for r in got) <= BATCH_BYTES + 250_000
        spark.conf.set(key, 4096)
        small_batches(spark)
        assert int(spark.conf.get(key).removesuffix("b")) == 4096
    finally:
        spark.conf.set(key, before)
