import glob
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.compaction import Conflict, Store
from lodestone.llm.common import table


def content(df):
    return sorted(map(str, map(tuple, df.collect())))


def rows(spark, first, last):
    return spark.range(first, last).selectExpr("id AS doc_id", "CASE WHEN id % 5 != 0 THEN repeat(cast(id AS string), 20) END AS text", "id AS version")


def test_appends_and_merges(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", target_bytes=6_000, base_bytes=3_000, fan_in=3)
    want = []
    for k in range(10):
        part = rows(spark, k * 50, k * 50 + 50).coalesce(2)
        want += content(part)
        before = store.manifest()
        after = store.append(part)
        assert after["version"] == before["version"] + 1 and after["runs"][:-1] == before["runs"]
        assert content(store.read()) == sorted(want)
        if k in (3, 6):
            assert store.compact() >= 1 and content(store.read()) == sorted(want)
    old = store.manifest()["version"]
    store.compact()
    assert content(store.read()) == sorted(want) == content(store.read(old))
    manifest = store.manifest()
    assert all(len([r for r in manifest["runs"] if r["tier"] == t]) < 3 for t in range(9))
    merged = max(manifest["runs"], key=lambda r: r["bytes"])
    assert len(merged["files"]) == max(1, round(merged["bytes"] / 6_000))
    assert store.vacuum() > 0 and content(store.read()) == sorted(want)
    assert store.versions() == [manifest["version"]]
    named = {f["path"].removeprefix("file://") for r in manifest["runs"] for f in r["files"]}
    assert {p for p in glob.glob(f"{tmp_path}/s/data/**/*.parquet", recursive=True)} == named


def test_commits_are_atomic(spark, tmp_path):
    store, other = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    seen = store.manifest()
    other.append(rows(spark, 0, 5))
    with pytest.raises(Conflict):
        store.commit(seen, [])
    # a run that was written but not committed is invisible
    rows(spark, 100, 200).write.parquet(f"file://{tmp_path}/s/data/lost")
    assert content(store.read()) == content(rows(spark, 0, 5)) and store.versions() == [1]
    assert not glob.glob(f"{tmp_path}/s/manifest/draft*")


def test_a_commit_during_a_merge_is_kept(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", fan_in=2)
    store.append(rows(spark, 0, 5))
    store.append(rows(spark, 5, 9))
    run = store._run

    def and_another(folder):
        monkeypatch.setattr(store, "_run", run)
        Store(spark, store.path).append(rows(spark, 9, 12))
        return run(folder)

    monkeypatch.setattr(store, "_run", and_another)
    assert store.compact_once()
    assert content(store.read()) == content(rows(spark, 0, 12)) and len(store.manifest()["runs"]) == 2


def test_arrivals_and_odd_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", fan_in=2)
    assert store.compact() == 0 and store.versions() == []
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "t" * 100_000, None)], "doc_id long, text string, _arrival string")
    assert store.append_arrivals(odd, F.coalesce("doc_id", F.lit(7)) % 3) == 1
    assert content(store.read()) == content(odd) and store.read().columns == odd.columns
    empty = Store(spark, f"file://{tmp_path}/e", fan_in=2)
    for _ in range(2):
        empty.append(odd.limit(0))
    empty.compact()
    assert empty.read().count() == 0 and empty.read().columns == odd.columns


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op3_compaction"])
    got = queries.op3_compaction(spark, sf)
    assert got.columns == want.columns
    assert content(got) == sorted(map(str, want.fetchall())) and got.count() == table(spark, sf, "documents").count()


def test_vacuum_deletes_what_no_manifest_names(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", fan_in=2)
    docs = rows(spark, 0, 40)
    store.append_arrivals(docs, F.col("doc_id") % 4)
    store.append(rows(spark, 40, 50))
    for lost in ("lost", "half/_arrival=0"):
        rows(spark, 100, 120).coalesce(1).write.parquet(f"{store.path}/data/{lost}")
    (tmp_path / "s/manifest/draft-old").write_text("{")
    assert store.vacuum(keep=99) == 0 and (tmp_path / "s/data/lost").exists()
    assert store.vacuum(keep=99, grace_ms=0) == 2
    assert not (tmp_path / "s/data/lost").exists() and not (tmp_path / "s/data/half").exists() and not glob.glob(f"{tmp_path}/s/manifest/draft*")
    want = content(rows(spark, 0, 50))
    assert content(store.read()) == want
    store.compact()
    store.vacuum(grace_ms=0)
    named = {f["path"].removeprefix("file://") for r in store.manifest()["runs"] for f in r["files"]}
    assert set(glob.glob(f"{tmp_path}/s/data/**/*.parquet", recursive=True)) == named and content(store.read()) == want


def test_writers_at_once_lose_nothing(spark, tmp_path):
    stores = [Store(spark, f"file://{tmp_path}/s", fan_in=3) for _ in range(4)]

    def write(k):
        for j in range(3):
            stores[k].append(rows(spark, (3 * k + j) * 5, (3 * k + j) * 5 + 5).coalesce(1))
        stores[k].compact()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    assert content(stores[0].read()) == content(rows(spark, 0, 60))
    versions = stores[0].versions()
    assert versions == list(range(1, versions[-1] + 1)) and versions[-1] >= 12
    # a name that is taken is never overwritten
    taken = (tmp_path / f"s/manifest/v{versions[-1]:012d}.json").read_text()
    with pytest.raises(Conflict):
        stores[0].commit({**stores[0].manifest(), "version": versions[-1] - 1}, [])
    assert (tmp_path / f"s/manifest/v{versions[-1]:012d}.json").read_text() == taken
