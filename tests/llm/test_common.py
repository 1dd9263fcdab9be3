"""Slices by bytes, sessions with settings of their own, tables that go when a step ends, very long texts."""

import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers as P
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, common, language_id, token_files

PATH = P.path("byte_bpe_50k.json")


def test_slices_are_bounded_by_bytes_and_lose_nothing():
    r = random.Random(4)
    texts = [None if r.random() < 0.1 else "é" * r.choice([0, 1, 5, 20, 300]) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, min(at + 7, 400))), pa.array(texts[at : at + 7], pa.string())], ["i", "t"]) for at in range(0, 400, 7)]
    batches.insert(3, batches[0].slice(0, 0))
    for limit, rows in ((100, 20_000), (1, 20_000), (10_000, 13), (10**9, 20_000)):
        out = list(common.slices(batches, limit, 1, rows))
        assert [x for b in out for x in b.column(0).to_pylist()] == list(range(400)) and [x for b in out for x in b.column(1).to_pylist()] == texts
        for b in out:
            size = sum(len((t or "").encode()) for t in b.column(1).to_pylist())
            assert b.num_rows and b.num_rows <= rows and (size <= limit or sum(bool(t) for t in b.column(1).to_pylist()) == 1)
    assert len(list(common.slices(batches, 10**9, 1))) == 1 and list(common.slices([], 5)) == []


def test_settings_are_of_a_copy(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        df = common.tuned(spark.range(5))
        assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3" and common.tuned(df) is df
        assert all(df.sparkSession.conf.get(k) == v for k, v in common.SETTINGS.items())
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000" and spark.conf.get("spark.lodestone.tuned", None) is None
        assert df.join(spark.range(3), "id").count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scratch_tables_go(spark):
    with common.scratch(spark):
        a = common.staged(spark.range(5), "scratch-a")
        with common.scratch(spark):
            b = common.staged(a, "scratch-b")
            c = common.staged(b, "scratch-c", outside=True)
        assert c.count() == 5 and not os.path.exists(b.inputFiles()[0].removeprefix("file://"))
        kept = common.staged(c, "scratch-d", outside=True)
    assert kept.count() == 5 and not os.path.exists(a.inputFiles()[0].removeprefix("file://")) and not os.path.exists(c.inputFiles()[0].removeprefix("file://"))


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(7)
    got = common.numbered(df, "at", F.desc("x")).orderBy("at").collect()
    assert [r.at for r in got] == list(range(1000)) and [r.x for r in got] == sorted((r.x for r in got), reverse=True)
    assert common.numbered(df.limit(0), "at", "x").count() == 0


def test_very_long_texts_in_one_partition(spark):
    """Several texts of 20 MB, one after the other, through the kernels that hold texts."""
    part, times = "Some words of a long text, with numbers 1234 and marks!\n", 360_000
    docs = spark.range(3).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("x "), F.repeat(F.lit(part), times)).alias("text"))
    t = Tokenizer.from_file(PATH)
    text = "x " + part * 10
    ids = t.encode("x " + part * 3, add_special_tokens=False).ids
    once = (len(t.encode(text, add_special_tokens=False).ids) - len(ids)) // 7
    for r in bpe.round_trip_digests(docs, PATH).collect():
        assert r.n_tokens == len(ids) + (times - 3) * once
        assert r.decoded_sha256 == hashlib.sha256(("x " + part * times).encode()).hexdigest()
    model = language_id.ByteGru(["a", "b"])
    got = language_id.predict(docs.limit(1), model).collect()
    assert len(got) == 1 and got[0].lang_pred in ("a", "b")


def test_other_vocabularies_are_not_cut(tmp_path):
    """A pre-tokeniser that puts a space before each text: the ids are the library's, not those of chunks."""
    other = Tokenizer.from_file(PATH)
    from tokenizers.pre_tokenizers import ByteLevel

    other.pre_tokenizer = ByteLevel(add_prefix_space=True)
    path = str(tmp_path / "other.json")
    other.save(path)
    texts = ["one two", "", "three, four five"]
    flat, bounds = token_files.library_codes(path).of(pa.array(texts))
    assert [flat[x:y].tolist() for x, y in zip(bounds, bounds[1:])] == [other.encode(x, add_special_tokens=False).ids for x in texts]
    with pytest.raises(ValueError, match="no plain byte-level"):
        bpe.PairIndexBpe(path)


def test_the_driver_gives_memory_back_between_many_small_tables(spark):
    """After every few tables the heap is collected in full and free native memory returned; before, it was left to chance."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if not re.search("Young|Copy|Scavenge", b.getName()))
    before = full()
    rows = common.staged(spark.range(3), "relief")
    for _ in range(common.RELIEF):
        rows = common.staged(rows, "relief")
    assert full() > before
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2]


def test_relief_works_on_any_jvm(spark):
    common.relieve(spark)
    assert spark.range(3).count() == 3


def test_relief_reaches_executors(tmp_path):
    """In a session of its own, whose executors work in tmp_path: each of the two collects its heap."""
    (tmp_path / "home/work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
from lodestone.llm import common

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.executor.extraJavaOptions", "-Xlog:gc:file={tmp_path}/gc-%p.log").getOrCreate()
spark.range(0, 1000, 1, 4).selectExpr("sum(id)").collect()
common.relieve(spark)
"""
    env = os.environ | {"SPARK_HOME": f"{tmp_path}/home", "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "SPARK_SCALA_VERSION": "2.13", "PYTHONPATH": str(Path(common.__file__).parents[2])}
    for name in ("SPARK_CONF_DIR", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "PYSPARK_SUBMIT_ARGS"):
        env.pop(name, None)
    subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, check=True, capture_output=True, timeout=120)
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2
    assert all("System.gc()" in log for log in logs)
