"""The bucketed catalog, replacing a saved one, and the bucketed page state."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from drapery.operators import incremental as INC
from drapery.session import scratch_path
from drapery.sources import catalog_io as IO
from drapery.sources import catalog_store as CS
from drapery.sources import page_state as PS
from drapery.sources.files import Conflict, Folder, commit, snapshot, versions

COLS = IO.CATALOG_COLUMNS
ROW = "style_id string, color_name string, price double, audience string, subcategory string"


def frame(spark, *rows):
    return spark.createDataFrame([(*r, "Women", "Tops") for r in rows], ROW)


def saved(df):
    return {(r.style_id, r.color_name): r.price for r in df.select("style_id", "color_name", F.col("price").cast("double")).collect()}


def test_upsert_rewrites_touched_buckets_only(spark):
    path = scratch_path(spark, "store")
    many = frame(spark, *[(f"s{i}", "Red", float(i)) for i in range(200)])
    first = CS.upsert(many, path, COLS, buckets=16)
    assert first == {"rows": 200, "invalid": 0, "buckets": 16, "version": 1}
    before = CS.current(spark, path)["folders"]
    second = CS.upsert(frame(spark, ("s7", "Red", 99.0), ("s7", "Blue", 5.0), ("new", "Red", 1.0)), path, COLS)
    after = CS.current(spark, path)["folders"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert second["buckets"] == len(moved) <= 2 and second["version"] == 2
    want = {(f"s{i}", "Red"): float(i) for i in range(200)} | {("s7", "Red"): 99.0, ("s7", "Blue"): 5.0, ("new", "Red"): 1.0}
    assert saved(CS.read_store(spark, path)) == want
    assert saved(CS.read_store(spark, path, version=1)) == {(f"s{i}", "Red"): float(i) for i in range(200)}
    one = CS.read_store(spark, path, style_ids=["s7"])
    assert saved(one) == {("s7", "Red"): 99.0, ("s7", "Blue"): 5.0}
    folder = re.escape(after[str(spark.range(1).select(CS.bucket_of(F.lit("s7"), 16)).first()[0])])
    assert all(re.search(folder, f) for f in one.inputFiles())


def test_upsert_reads_touched_buckets_only(spark, monkeypatch):
    path, read = scratch_path(spark, "store"), []
    CS.upsert(frame(spark, *[(f"s{i}", "Red", 1.0) for i in range(100)]), path, COLS, buckets=8)
    rows = CS._rows
    monkeypatch.setattr(CS, "_rows", lambda *a: read.append(df := rows(*a)) or df)
    CS.upsert(frame(spark, ("s3", "Red", 2.0)), path, COLS)
    assert len(read) == 1 and len({re.search("bucket=[0-9]+", f)[0] for f in read[0].inputFiles()}) == 1


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", ["parquet 1", "parquet 2", "write 1", "rename 1"])
def test_a_lost_upsert_leaves_the_old_catalog(spark, monkeypatch, step):
    from pyspark.sql import DataFrameWriter

    path = scratch_path(spark, "store")
    CS.upsert(frame(spark, ("a", "Red", 1.0), ("b", "Red", 2.0)), path, COLS, buckets=4)
    what, at = step.split()
    owner = DataFrameWriter if what == "parquet" else Folder
    real, calls = getattr(owner, what), []

    def failing(self, *args, **kw):
        calls.append(1)
        if len(calls) == int(at):
            raise Lost
        return real(self, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(owner, what, failing)
        with pytest.raises(Lost):
            CS.upsert(frame(spark, ("a", "Red", 9.0), ("c", "Red", 3.0)), path, COLS)
    assert saved(CS.read_store(spark, path)) == {("a", "Red"): 1.0, ("b", "Red"): 2.0}
    CS.upsert(frame(spark, ("a", "Red", 9.0)), path, COLS)
    assert saved(CS.read_store(spark, path)) == {("a", "Red"): 9.0, ("b", "Red"): 2.0}


def test_two_writers_conflict_and_expire(spark):
    path = scratch_path(spark, "store")
    for price in (1.0, 2.0, 3.0):
        CS.upsert(frame(spark, ("a", "Red", price)), path, COLS, buckets=4)
    folder, snap = Folder(spark, path), CS.current(spark, path)
    with pytest.raises(Conflict):
        commit(folder, snap)
    assert versions(folder) == [1, 2, 3]
    gone = CS.expire(spark, path, keep=1)
    assert len(gone) == 2 and versions(folder) == [3] and saved(CS.read_store(spark, path)) == {("a", "Red"): 3.0}
    assert CS.upsert(frame(spark).limit(0), path, COLS)["version"] == 3
    assert not folder.names("_staged") and json.dumps(snap)


def test_upsert_catalog_takes_a_plain_one_over(spark):
    path = scratch_path(spark, "catalog")
    IO.write_catalog(frame(spark, ("a", "Red", 1.0), ("b", "Red", 2.0)), path)
    IO.upsert_catalog(frame(spark, ("b", "Red", 5.0)), path)
    assert saved(IO.read_catalog(spark, path, fmt="parquet")) == {("a", "Red"): 1.0, ("b", "Red"): 5.0}


@pytest.mark.parametrize("at", [1, 2])
def test_a_lost_overwrite_leaves_the_old_catalog(spark, monkeypatch, at):
    path, calls, real = scratch_path(spark, "catalog"), [], Folder.rename
    IO.write_catalog(frame(spark, ("a", "Red", 1.0)), path)

    def failing(self, old, new):
        calls.append(1)
        if len(calls) == at:
            raise Lost
        return real(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(Folder, "rename", failing)
        with pytest.raises(Lost):
            IO.write_catalog(frame(spark, ("b", "Red", 2.0)), path)
    assert saved(IO.read_catalog(spark, path, fmt="parquet")) == {("a", "Red"): 1.0}
    IO.write_catalog(frame(spark, ("c", "Red", 3.0)), path, mode="append")
    assert saved(IO.read_catalog(spark, path, fmt="parquet")) == {("a", "Red"): 1.0, ("c", "Red"): 3.0}
    IO.write_catalog(frame(spark, ("d", "Red", 4.0)), path)
    assert saved(IO.read_catalog(spark, path, fmt="parquet")) == {("d", "Red"): 4.0}
    assert not Folder(spark, path + IO.PREVIOUS).exists()


NOW = dt.datetime(2024, 1, 15)


def exchanges_over_state(df):
    """Exchanges between the scan of the state and the join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    depth = lambda x: len(re.match(r"[\s:|+*-]*", x)[0])
    at = next(i for i, x in enumerate(lines) if "page_state_" in x and "Scan" in x)
    found, d = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < d:
            d = depth(x)
            if "Join" in x:
                break
            if "Exchange" in x:
                found.append(x)
    return found


def test_state_is_not_shuffled(spark):
    path = scratch_path(spark, "state")
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    old = pages.filter("page_id < 200").select("url", F.md5(F.when(F.col("page_id") % 10 == 0, "x").otherwise(F.col("html"))).alias("checksum"),
                                               F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_scraped"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = PS.write_state(old.unionByName(old.limit(5)), path, buckets=6)
        assert state.count() == 200
        for df in (INC.changed_pages(pages, state, NOW), INC.stale_pages(pages.select("url"), state, NOW), INC.skip_existing(pages.select("url"), state)):
            df.collect()
            assert exchanges_over_state(df) == []
        want = sorted(map(tuple, INC.changed_pages(pages, old, NOW).collect()))
        after = sorted(map(tuple, INC.upsert_state(old, INC.changed_pages(pages, old, NOW)).collect()))
        got = PS.advance_state(pages, path, NOW)
        assert sorted(map(tuple, got.collect())) == want
        assert sorted(map(tuple, PS.read_state(spark, path).drop("status").collect())) == after
        again = PS.advance_state(pages, path, NOW + dt.timedelta(days=1))
        assert {r.status for r in again.collect()} == {"same"} and snapshot(Folder(spark, path))["version"] == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_state_of_nothing_and_null_urls(spark):
    path = scratch_path(spark, "state")
    pages = spark.createDataFrame([(1, None, "a"), (2, "u", None), (3, "v", "b"), (4, "v", "c")], "page_id long, url string, html string")
    assert PS.read_state(spark, path).count() == 0
    got = {r.url: (r.status, r.checksum) for r in PS.advance_state(pages, path, NOW, buckets=3).collect()}
    assert got["v"] == ("new", "4a8a08f09d37b73795649038408b5f33") and got[None][0] == "new"
    assert PS.advance_state(pages.limit(0), path, NOW).count() == 0 and PS.read_state(spark, path).count() == 3
