"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and U+0009..U+000D; this is
#: what ``bytes.split()`` separates by, so SQL and Python sides agree.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="drapery-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Files per core of a table of keys, however many partitions its shuffle has.
KEY_FILES = 4


def materialize(df: DataFrame, name: str, keys_only: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors. Tables of keys go into a few files per core: where
    Hadoop has no native library, each file starts processes that set its mode."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if keys_only:
        df = df.coalesce(KEY_FILES * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes too, as texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df.mapInArrow(function, schema)


def up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if a count finds at most ``rows`` rows; otherwise the planner decides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
