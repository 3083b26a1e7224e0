"""The catalog plan as a Structured Streaming job.

Pages land as files in a folder. The stream applies the stateless catalog
transforms once (JSON, elements, rules - all narrow), drops URLs it has
already seen (``dropDuplicates`` on the URL, state kept in the checkpoint),
and hands each micro-batch to ``foreachBatch``, which skips URLs saved by
other runs, keeps the first row per (style_id, color_name) and writes the
batch to its own ``run_id=/batch_id=`` partition. The run id is kept beside
the checkpoint, so a replayed batch overwrites exactly its own partition and
a new run never touches an earlier one's rows. Saved URLs are kept in a
narrow table of their own beside the sink; no batch reads the sink again.
Reading the sink merges all parts with the batch plan's rule, so stream
output equals batch output.

One stream handles one batch at a time, and a small batch is mostly planning
and file operations that no core shortens. ``stream_lanes`` therefore runs a
stream per landing folder of ``land_pages(..., lanes=n)``, side by side: a
URL's lane follows from its hash, as the partition of a keyed topic does, so
each lane's state is exact for its URLs, and the lanes are one run.

With ``dedupe="changes"`` the state of a URL is the checksum of its last
fetch: a page that was fetched again passes if its content has changed and is
dropped if not, as ``changed_pages`` would decide. The sink then holds every
content of a page, and ``read_sink(latest=True)`` takes the last one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import CATALOG_COLUMNS, dedup_first, standardize
from ..plans.catalog import catalog_rows
from ..sources.sites import Site

PAGES_SCHEMA = "page_id bigint, url string, html string"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the runs that share a checkpoint: a marker beside it, made once."""
    folder, fs = _hadoop(spark, checkpoint.rstrip("/") + ".run")
    if fs.exists(folder):
        return fs.listStatus(folder)[0].getPath().getName()
    new = uuid.uuid4().hex
    marker, fs = _hadoop(spark, f"{checkpoint.rstrip('/')}.run/{new}")
    fs.create(marker).close()
    return new


def keys_path(sink: str) -> str:
    """Where the URLs saved in ``sink`` are listed."""
    return sink.rstrip("/") + ".urls"


def _saved_by_others(spark: SparkSession, sink: str, own: str) -> DataFrame | None:
    """The URLs that other runs have saved, if there are any. Only their folders
    are listed: a run's own grow by one with each of its batches."""
    folder, fs = _hadoop(spark, keys_path(sink))
    if not fs.exists(folder):
        return None
    runs = [f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName() not in ("_SUCCESS", f"run_id={own}")]
    runs = [r for r in runs if r.rsplit("/", 1)[1].startswith("run_id=")]
    return spark.read.schema("product_url string").parquet(*runs).select("product_url").distinct() if runs else None


#: Columns of a batch's rows that keep values as they were before ``standardize``.
RAW = {"_url": "product_url", "_style": "style_id", "_color": "color_name"}
#: Rows of a file that a batch writes.
FILE_ROWS = 50_000


#: Rows of a task that lands pages in lanes.
LAND_ROWS = 50_000
#: Streams of one run at most: their batches are planned by one driver.
MOST_LANES = 8


def lanes_for(spark: SparkSession) -> int:
    """Lanes that keep the session's cores busy."""
    return max(1, min(MOST_LANES, spark.sparkContext.defaultParallelism))


#: Every batch is planned anew, and filters inferred from other columns are no use to its plan.
PLAN_CONF = {"spark.sql.constraintPropagation.enabled": "false"}


def _start(writer, spark: SparkSession, checkpoint: str, share: int = 1):
    """Starts a stream. The ``share`` streams of a run have a partition of state per
    core together, at most: each is read and committed by every batch, however few
    rows that has. On a local disk, whose renames are atomic, checkpoint files are
    renamed through ``FileSystem``: ``FileContext`` asks for links by child processes."""
    cores = spark.sparkContext.defaultParallelism
    own = {"spark.sql.shuffle.partitions": str(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), cores // share))), **PLAN_CONF}
    if _hadoop(spark, checkpoint)[1].getScheme() == "file":
        own["spark.sql.streaming.checkpointFileManagerClass"] = (
            "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)  # the stream takes a copy of the settings as it starts
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _lane_folders(spark: SparkSession, landing: str) -> list[str]:
    """Names of the lanes that pages have landed in, in order."""
    folder, fs = _hadoop(spark, landing)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n for n in names if n.startswith("lane="))


def land_pages(pages: DataFrame, landing: str, pages_per_file: int = 25, lanes: int = 1) -> None:
    """Write pages as files of at most ``pages_per_file`` rows (what a fetcher
    would drop into the landing folder); with ``lanes`` each URL's pages into
    the folder ``lane=<k>-of-<lanes>`` that its hash gives, always the same."""
    pages = pages.select("page_id", "url", "html")
    if lanes == 1:
        pages.write.mode("append").option("maxRecordsPerFile", pages_per_file).parquet(landing)
        return
    if other := [n for n in _lane_folders(pages.sparkSession, landing) if not n.endswith(f"-of-{lanes}")]:
        raise ValueError(f"{landing} has lanes of another number: {other[0]}")
    # a multiple of the lanes: a task's rows are of one lane, and its files full
    tasks = lanes * max(1, -(-pages.count() // (lanes * LAND_ROWS)))
    lane = F.concat(F.pmod(F.hash("url"), F.lit(lanes)).cast("string"), F.lit(f"-of-{lanes}"))
    (pages.repartition(tasks, "url").withColumn("lane", lane).write.mode("append").partitionBy("lane")
     .option("maxRecordsPerFile", pages_per_file).parquet(landing))


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The last fetch of a URL in this batch, if its checksum is not the one in the state."""
    last = None
    for frame in frames:
        row = frame.sort_values(["page_id", "checksum"], na_position="first").iloc[[-1]]
        if last is None or _later(row, last):
            last = row
    checksum = last["checksum"].iloc[0]
    if not state.exists or state.get[0] != checksum:
        state.update((checksum,))
        yield last.drop(columns="checksum")


def _later(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    def place(x):
        return (not pd.isna(x["page_id"].iloc[0]), 0 if pd.isna(x["page_id"].iloc[0]) else x["page_id"].iloc[0], x["checksum"].iloc[0] or "")

    return place(a) > place(b)


def changed_stream(pages: DataFrame) -> DataFrame:
    """Pages whose content is new or differs from the last fetch of their URL.

    Keyed state holds one checksum a URL (checkpointed; use the RocksDB state
    store for large URL sets), so it grows with the URLs and not with the
    fetches. Of several fetches in one batch the one with the largest
    ``page_id`` counts. A replayed batch finds the state as it was before it.
    Frames must be streaming ones; ``changed_pages`` is the batch form.
    """
    hashed = pages.withColumn("checksum", F.md5(F.coalesce("html", F.lit(""))))
    return hashed.groupBy("url").applyInPandasWithState(_changed, pages.schema, "checksum string", "append", GroupStateTimeout.NoTimeout)


def stream_catalog(spark: SparkSession, landing: str, sink: str, checkpoint: str, site: Site,
                   files_per_trigger: int = 1, skip_done: bool = True, dedupe: str = "state",
                   schema: str = PAGES_SCHEMA, event_time: str | None = None, delay: str = "7 days",
                   run: str | None = None, lane: int = 0, lanes: int = 1):
    """Start the stream (``availableNow``: drain what has landed, then stop).

    ``dedupe``: ``"state"`` keeps every URL seen in the checkpointed state
    (exact; use the RocksDB state store for large URL sets), ``"changes"`` keeps
    the checksum of each URL's last fetch and lets changed pages pass (one
    checkpoint a sink), ``"watermark"`` drops repeats within ``delay`` of ``event_time`` (bounded state), ``"none"``
    relies on the sink anti join only. With ``lanes`` the
    stream is number ``lane`` of the ``run`` (``stream_lanes``), and its batch b
    is the run's batch b * lanes + lane.
    """
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(landing)
    if dedupe == "state":
        pages = pages.dropDuplicates(["url"])
    elif dedupe == "changes":
        pages, skip_done = changed_stream(pages), False  # a saved URL comes again when it has changed
    elif dedupe == "watermark":
        if not event_time:
            raise ValueError("dedupe='watermark' needs event_time")
        pages = pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
    rows = catalog_rows(pages, site)
    # standardised here, where columns are built once and not for every batch; beside them the values as they were, for the keys
    rows = standardize(rows.withColumns({k: F.col(c) for k, c in RAW.items()}), passthrough=("page_id", "pos", *RAW))

    own = run or run_id(spark, checkpoint)

    url = F.col("_url").alias("product_url")

    def save(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(folder)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session, part = batch.sparkSession, f"run_id={own}/batch_id={batch_id * lanes + lane}"
        batch = batch.persist()  # two writes read it; the pages are parsed and the state is updated once
        try:
            files, todo = 1 + batch.count() // FILE_ROWS, batch
            # within a run the stream itself drops repeats, and a replayed batch must find its own URLs unsaved
            if skip_done and (done := _saved_by_others(session, sink, own)) is not None:
                todo = todo.join(done, todo["_url"] == done["product_url"], "left_anti")
            todo = todo.coalesce(files)  # the rows of one file are de-duplicated in its task, without a shuffle
            # into the batch's own folder: a value of a column would be compiled anew for every batch
            save(dedup_first(todo, ["_style", "_color"], ["page_id", "pos"]).drop(*RAW).coalesce(files), f"{sink.rstrip('/')}/{part}")
            # listed last: a URL is only skipped once its rows are saved
            save(todo.select(url).distinct().coalesce(files), f"{keys_path(sink)}/{part}")
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _start(writer, spark, checkpoint, lanes)


def stream_lanes(spark: SparkSession, landing: str, sink: str, checkpoint: str, site: Site, **options) -> list:
    """A ``stream_catalog`` for each lane of a landing folder (``land_pages`` with
    ``lanes``), all at once; one run, with a checkpoint a lane in the folder ``checkpoint``."""
    folders = _lane_folders(spark, landing)
    if not folders:
        return [stream_catalog(spark, landing, sink, checkpoint, site, **options)]
    run, streams = run_id(spark, checkpoint), []
    for folder in folders:
        lane, lanes = (int(x) for x in folder.split("=")[1].split("-of-"))
        streams.append(stream_catalog(spark, f"{landing.rstrip('/')}/{folder}", sink, f"{checkpoint.rstrip('/')}/{folder}", site,
                                      run=run, lane=lane, lanes=lanes, **options))
    return streams


def await_all(streams: list) -> None:
    """Waits for streams that run side by side; when one fails, the others are stopped and its error is raised."""
    try:
        left = list(streams)
        while left:
            left = [q for q in left if not q.awaitTermination(1)]  # raises the error of a stream that failed
    except BaseException:
        for q in streams:
            q.stop()
        raise


def read_sink(spark: SparkSession, sink: str, latest: bool = False) -> DataFrame:
    """All appended rows merged: first row per (style_id, color_name) in page
    order; with ``latest`` only rows of the last content of each page take part."""
    df = spark.read.parquet(sink)
    if latest:
        runs = [r.run_id for r in df.select("run_id").distinct().limit(2).collect()]
        if len(runs) > 1:
            raise ValueError(f"{sink}: batches of several checkpoints have no common order")
        last = df.groupBy(F.col("product_url").alias("_url")).agg(F.max(F.struct("batch_id", "page_id")).alias("_last"))
        df = df.join(last, F.col("product_url").eqNullSafe(F.col("_url")) & (F.struct("batch_id", "page_id") == F.col("_last")), "left_semi")
    return dedup_first(df, ["style_id", "color_name"], ["page_id", "pos"]).select(*CATALOG_COLUMNS)


def batch_progress(spark: SparkSession, sink: str) -> DataFrame:
    """Rows saved per micro-batch (the incremental-save log)."""
    return spark.read.parquet(sink).groupBy("run_id", "batch_id").agg(F.count(F.lit(1)).alias("rows"),
                                                            F.count_distinct("page_id").alias("pages"))
