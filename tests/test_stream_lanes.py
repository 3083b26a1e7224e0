"""A run's streams side by side: every URL in one lane, the rows of a single stream."""

import os

import pytest
from pyspark.sql import functions as F

from drapery.sources.sites import SITES
from drapery.streaming import stream_catalog as S

from test_stream import LD, land, page


def folders(path):
    return sorted(d for d in os.listdir(path) if d.startswith("lane="))


def test_a_url_lands_in_one_lane_in_full_files(spark, tmp_path):
    landing = f"file://{tmp_path}/landing"
    pages = spark.createDataFrame([page(i, f"p{i % 150}") for i in range(300)] + [(900, None, "x")], S.PAGES_SCHEMA).repartition(7)
    S.land_pages(pages, landing, 10, lanes=3)
    assert folders(tmp_path / "landing") == ["lane=0-of-3", "lane=1-of-3", "lane=2-of-3"]
    got = spark.read.parquet(landing)
    assert sorted(r.page_id for r in got.collect()) == [*range(300), 900]
    assert got.groupBy("url").agg(F.count_distinct("lane").alias("n")).filter("n <> 1").count() == 0
    sizes = [r["count"] for r in got.groupBy(F.input_file_name(), "lane").count().collect()]
    assert max(sizes) == 10 and sum(n < 10 for n in sizes) <= 3
    with pytest.raises(ValueError):
        S.land_pages(pages, landing, 10, lanes=4)


def test_lanes_are_one_run_with_the_rows_of_one_stream(spark, tmp_path):
    rows = [page(i, f"p{i}") for i in range(60)] + [(60 + i, None if i == 0 else page(0, f"p{i}")[1], LD % ("Again", "1.00")) for i in range(10)]
    pages = spark.createDataFrame(rows, S.PAGES_SCHEMA)
    out = {}
    for lanes in (1, 3):
        landing, sink, ckpt = (f"file://{tmp_path}/{n}{lanes}" for n in ("landing", "sink", "ckpt"))
        S.land_pages(pages.coalesce(1), landing, 5, lanes)
        streams = S.stream_lanes(spark, landing, sink, ckpt, SITES["shop"], files_per_trigger=4)
        assert len(streams) == lanes
        S.await_all(streams)
        out[lanes] = sorted(r.style_id for r in S.read_sink(spark, sink).collect())
        progress = S.batch_progress(spark, sink).collect()
        assert {r.run_id for r in progress} == {S.run_id(spark, ckpt)} and len(progress) >= lanes
        assert len({r.batch_id for r in progress}) == len(progress) and max(r.pages for r in progress) <= 20
    assert out[1] == out[3] and len(out[1]) == 61
    # a lost commit of one lane: its batch takes the place of itself
    ckpt = tmp_path / "ckpt3" / "lane=1-of-3" / "commits"
    last = max((n for n in os.listdir(ckpt) if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        (ckpt / name).unlink(missing_ok=True)
    again = [f"file://{tmp_path}/{n}3" for n in ("landing", "sink", "ckpt")]
    before = spark.read.parquet(again[1]).count()
    S.await_all(S.stream_lanes(spark, *again, SITES["shop"], files_per_trigger=4))
    assert spark.read.parquet(again[1]).count() == before
    # another run over the same pages: only the page without a URL, which nothing can be told from, passes again
    S.await_all(S.stream_lanes(spark, again[0], again[1], f"file://{tmp_path}/another", SITES["shop"]))
    assert spark.read.parquet(again[1]).count() == before + 1


def test_a_failing_lane_stops_the_others(spark, tmp_path):
    landing = tmp_path / "landing"
    S.land_pages(spark.createDataFrame([page(i, f"p{i}") for i in range(20)], S.PAGES_SCHEMA), f"file://{landing}", 5, lanes=2)
    (landing / "lane=0-of-2" / "part-broken.parquet").write_bytes(b"no parquet")
    streams = S.stream_lanes(spark, f"file://{landing}", f"file://{tmp_path}/sink", f"file://{tmp_path}/ckpt", SITES["shop"])
    with pytest.raises(Exception, match="part-broken"):
        S.await_all(streams)
    assert not any(q.isActive for q in streams)


def test_keys_are_the_values_before_they_are_standardised(spark, tmp_path):
    """Colours that differ in their case only are two rows; a replaced title case would make them one."""
    landing, sink = f"file://{tmp_path}/landing", f"file://{tmp_path}/sink"
    html = ('<html><script id="ProductJson-x" type="application/json">{"id":1,"title":"Item","variants":['
            '{"id":1,"option1":"black","price":100},{"id":2,"option1":"BLACK","price":200},{"id":3,"option1":"black","price":300}]}</script></html>')
    land(spark, landing, [(1, "https://shop.example.com/products/a", html)])
    S.stream_catalog(spark, landing, sink, f"file://{tmp_path}/ckpt", SITES["shop"]).awaitTermination()
    saved = spark.read.parquet(sink)
    assert sorted((r.color_name, r.price) for r in saved.collect()) == [("Black", 1.0), ("Black", 2.0)]
    assert not [c for c in saved.columns if c.startswith("_")]


@pytest.mark.parametrize("name, most", [("checkpoint_append", 250), ("stream_catalog", 500)])
def test_queries_run_a_stream_a_lane(spark, sf, monkeypatch, name, most):
    from drapery.plans import all_queries
    seen = {}

    def lanes(spark, landing, sink, *args, **options):
        seen["streams"], seen["sink"] = start(spark, landing, sink, *args, **options), sink
        return seen["streams"]

    start = S.stream_lanes
    monkeypatch.setattr(S, "stream_lanes", lanes)
    rows = all_queries()[name](spark, sf)
    assert len(seen["streams"]) == S.lanes_for(spark) == spark.sparkContext.defaultParallelism
    progress = S.batch_progress(spark, seen["sink"]).collect()
    assert max(r.pages for r in progress) <= most
    assert rows.exceptAll(all_queries()["catalog_shopify"](spark, sf)).count() == 0
    assert rows.count() == all_queries()["catalog_shopify"](spark, sf).count()
