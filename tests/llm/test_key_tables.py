"""Tables of keys are written in a few files per core, and a row is never lost by it."""

from pyspark.sql import functions as F

from drapery.llm import minhash
from drapery.llm.common import KEY_FILES, materialize


def test_links_of_many_partitions_go_into_few_files(spark, monkeypatch):
    written = []

    def counted(df, name, keys_only=False):
        out = materialize(df, name, keys_only)
        written.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    most = KEY_FILES * spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * most))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # chains of four nodes: 10k, 10k + 1, 10k + 2, 10k + 3
        links = spark.range(500).select(F.explode(F.array(*[F.struct((F.col("id") * 10 + i).alias("a"), (F.col("id") * 10 + i + 1).alias("b"))
                                                            for i in range(3)])).alias("l")).select("l.*")
        rows = minhash.merged(None, links).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.node, r.comp) for r in rows) == [(k * 10 + i, k * 10) for k in range(500) for i in range(4)]
    assert written and max(n for _, n in written) <= most, (most, written)
