"""What a micro-batch costs does not grow with the batches before it."""

import os

from drapery.sources.sites import SITES
from drapery.streaming import stream_catalog as S

from test_stream import land, page


def test_a_batch_writes_one_file_a_folder_and_parses_once(spark, tmp_path):
    landing, sink, ckpt = (f"file://{tmp_path}/{n}" for n in ("landing", "sink", "checkpoint"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        land(spark, landing, [page(i, f"p{i}") for i in range(40)])
        land(spark, landing, [page(100 + i, f"q{i}") for i in range(40)])
        S.stream_catalog(spark, landing, sink, ckpt, SITES["shop"]).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for root in ("sink", "sink.urls"):
        made = [len([f for f in files if f.startswith("part-")]) for _, _, files in os.walk(tmp_path / root)]
        assert sorted(n for n in made if n) == [1, 1], root
    # a partition of state a core, however many a shuffle has
    state = tmp_path / "checkpoint" / "state" / "0"
    assert len([d for d in os.listdir(state) if d.isdigit()]) == spark.sparkContext.defaultParallelism
    assert S.read_sink(spark, sink).count() == 80


def test_only_the_folders_of_other_runs_are_listed(spark, tmp_path):
    sink, landing = f"file://{tmp_path}/sink", f"file://{tmp_path}/landing"
    assert S._saved_by_others(spark, sink, "a") is None
    land(spark, landing, [page(1, "a"), page(2, "b")])
    ckpt = f"file://{tmp_path}/one"
    S.stream_catalog(spark, landing, sink, ckpt, SITES["shop"]).awaitTermination()
    own = S.run_id(spark, ckpt)
    assert S._saved_by_others(spark, sink, own) is None
    assert S._saved_by_others(spark, sink, "another").count() == 2
    land(spark, landing, [page(3, "c")])
    S.stream_catalog(spark, landing, sink, f"file://{tmp_path}/two", SITES["shop"]).awaitTermination()
    progress = {(r.run_id == own, r.pages) for r in S.batch_progress(spark, sink).collect()}
    assert progress == {(True, 2), (False, 1)}
