"""SimHash fingerprints bit by bit, hot points, and the shared helpers."""

import importlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

simhash, common = (importlib.import_module(f"samplewright.llm.{n}") for n in ("simhash", "common"))


def plain(text):
    """The fingerprint by its definition: majority of each bit over the shingles' hashes."""
    words = re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_definition():
    rng = np.random.default_rng(8)
    words = ["a", "B", "Ünï", "ÄB", "\u212a", "\u00a0x", "\x1cq", "x" * 400, "\U0001f600", "Z\u0130"]
    texts = ["", " \t\n", "one", "One TWO", "a b c", "a b c d", "a a a a a a"]
    texts += [str(rng.choice([" ", "\n", "\t ", "\x0b"])).join(rng.choice(words, rng.integers(1, 60))) for _ in range(300)]
    for t in texts:
        assert simhash.fingerprint(t) == plain(t), t


def test_a_hot_point_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "MIN_HOT", 50)
    rows = common.written(spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") * 1048576).cast("long").alias("point")))
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == 3000
    assert {r["component_id"] for r in got if r["point"] == 5} == {0}
    keyed = rows.groupBy("point").agg(F.count("*").alias("_rows"))
    spread = common.joined_spread(rows, common.written(keyed.withColumn("x", F.col("point") + 1)), ["point"]).collect()
    assert len(spread) == 3000 and all(r["x"] == r["point"] + 1 for r in spread)


def test_no_local_folder_off_a_local_master(monkeypatch):
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars int, point string, _row string, _d string, _k string, score string, _nth int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path / "none")).count() == 0
    texts = [None, "", "good words here", "good words here", "x" * 50_000, "word " * 5000]
    rows = [(k if k else None, t, None, None, None, "p", "r", "d", "k", "s", 7) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "odd" / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path / "odd")))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert {tuple(r)[5:] for r in docs.collect()} == {("p", "r", "d", "k", "s", 7)}
    assert {r["doc_id"] for r in docs.collect()} == {2, 4, 5}
