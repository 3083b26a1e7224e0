"""Change detection and the watermark in the stream."""

import datetime as dt

from drapery.sources.sites import SITES
from drapery.streaming import stream_catalog as S

LD = '<html><script type="application/ld+json">{"@type":"Product","name":"%s","offers":{"price":"%s"}}</script></html>'


def page(i, url, title="Item", price="5.00"):
    return (i, f"https://shop.example.com/products/{url}", LD % (title, price))


def land(spark, landing, rows, schema=S.PAGES_SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)


def test_changed_pages_pass_and_unchanged_ones_do_not(spark, tmp_path):
    landing, sink, ckpt = f"file://{tmp_path}/landing", f"file://{tmp_path}/sink", tmp_path / "checkpoint"

    def run():
        S.stream_catalog(spark, landing, sink, f"file://{ckpt}", SITES["shop"], dedupe="changes").awaitTermination()

    def prices(latest=True):
        return {r.product_url.rsplit("/", 1)[1]: r.price for r in S.read_sink(spark, sink, latest).collect()}

    land(spark, landing, [page(1, "a"), page(2, "b"), page(3, "c")])
    run()
    # unchanged, changed twice in one batch, new
    land(spark, landing, [page(4, "a"), page(5, "b", price="6.00"), page(6, "b", price="7.00"), page(7, "d")])
    run()
    assert prices() == {"a": 5.0, "b": 7.0, "c": 5.0, "d": 5.0}
    assert {r.batch_id: r.pages for r in S.batch_progress(spark, sink).collect()} == {0: 3, 1: 2}
    # the second batch is run again: the state is that before it, and its rows replace themselves
    commits = sorted((p for p in (ckpt / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (ckpt / "commits" / name).unlink(missing_ok=True)
    run()
    assert prices() == {"a": 5.0, "b": 7.0, "c": 5.0, "d": 5.0}
    assert {r.batch_id: r.pages for r in S.batch_progress(spark, sink).collect()} == {0: 3, 1: 2}
    # back to an earlier content is a change as well
    land(spark, landing, [page(8, "b"), page(9, "c"), page(10, "a", price="1.00")])
    run()
    assert prices() == {"a": 1.0, "b": 5.0, "c": 5.0, "d": 5.0}
    assert {r.batch_id: r.pages for r in S.batch_progress(spark, sink).collect()} == {0: 3, 1: 2, 2: 2}


def test_watermark_drops_repeats_within_the_delay(spark, tmp_path):
    landing, sink, ckpt = (f"file://{tmp_path}/{x}" for x in ("landing", "sink", "checkpoint"))
    schema = S.PAGES_SCHEMA + ", fetched timestamp"

    def batch(*rows):
        land(spark, landing, [(*page(i, url), dt.datetime(2024, 1, day)) for i, url, day in rows], schema)
        S.stream_catalog(spark, landing, sink, ckpt, SITES["shop"], skip_done=False, dedupe="watermark", schema=schema,
                         event_time="fetched", delay="7 days").awaitTermination()
        return sorted(r.page_id for r in spark.read.parquet(sink).collect())

    assert batch((1, "a", 1), (2, "b", 1), (3, "a", 2)) in ([1, 2], [2, 3])
    kept = batch((4, "a", 5), (5, "c", 12))  # a repeat within the delay
    assert 4 not in kept and 5 in kept
    batch((6, "d", 28))  # moves the watermark beyond the state of a and b
    kept = batch((7, "a", 29), (8, "d", 30))
    assert 7 in kept and 8 not in kept
    # older than the watermark: late
    assert 9 not in batch((9, "e", 2))
