import os
import zlib

from pyspark.sql import functions as F

from quern.llm import common
from tests.conftest import frame


def test_tables_in_the_shared_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    df = common.cut(frame(spark, [(1, "a")], "k long, v string"), "x")
    assert [tuple(r) for r in df.collect()] == [(1, "a")] and len(os.listdir(f"{tmp_path}/quern")) == 1
    common.drop(df)
    assert not [f for f in os.listdir(f"{tmp_path}/quern") if not f.endswith(".crc")]
    common.cut(spark.range(1), "y")
    common.clear(spark)
    assert not os.path.exists(f"{tmp_path}/quern")


def test_labelled_sample_is_bounded_and_outside_the_fold(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    labels = frame(spark, [(i, i % 2) for i in range(100)] + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    rows = common.labelled_sample(docs, labels, "toxic", 5, 30).collect()
    assert len(rows) == 30 and all(r["y"] == r["doc_id"] % 2 for r in rows)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


def test_one_text_of_an_id_and_no_very_long_one(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = frame(spark, [(ids[0], f"t{k}") for k in range(20_000)] + [(ids[1], "x" * 50_000), (ids[2], "y")], "doc_id long, text string")
    labels = frame(spark, [(i, 1) for i in ids], "doc_id long, toxic int")
    assert sorted(r["doc_id"] for r in common.labelled_sample(docs, labels, "toxic", 5, 6000).collect()) == [ids[0], ids[2]]


def test_settings_of_the_session_are_left_alone(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.ready(spark)
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "123456")
        common.ready(spark)
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.set(key, old)


def test_batches_of_long_texts_are_small(spark):
    common.ready(spark)
    long = spark.range(1000).select("id", F.expr("repeat('x', 100000)").alias("text")).coalesce(1)
    sizes = [r[0] for r in long.mapInPandas(lambda batches: (b[["id"]].head(1).assign(id=b["text"].map(len).sum()) for b in batches), "id long").collect()]
    assert sum(sizes) == 10**8 and max(sizes) < 20 << 20
