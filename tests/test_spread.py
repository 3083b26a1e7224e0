"""Page views over a ``part`` of one row group are built and parsed by many tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from drapery.plans.catalog import styles_pages
from drapery.sources.sites import SITES
from drapery.sources.tables import SPREAD_ROWS, view

ROWS = 3 * SPREAD_ROWS + 1


def wide_part(spark, tmp_path, sf):
    """A folder whose ``part`` has ``ROWS`` rows in one row group."""
    part = spark.read.parquet(f"{sf}/part.parquet").limit(100)
    ids = spark.range(ROWS).withColumn("k", F.col("id") % part.count())
    part = ids.join(part.withColumn("k", F.row_number().over(Window.orderBy("p_partkey")) - 1), "k")
    part = part.withColumn("p_partkey", F.col("id")).drop("k", "id")
    part.coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    return str(tmp_path)


def test_page_views_are_dealt_over_tasks_with_the_same_rows(spark, sf, tmp_path):
    folder = wide_part(spark, tmp_path, sf)
    for name in ("pt", "pp", "sp", "pv"):
        df = view(spark, folder, name)
        rows = df.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == ROWS
        assert len(rows) == 4 and max(r["count"] for r in rows) <= SPREAD_ROWS, name
    ids = [r.page_id for r in view(spark, folder, "pp").select("page_id").collect()]
    assert sorted(ids) == list(range(ROWS))


def test_filters_on_pages_stay_above_the_shuffle(spark, sf, tmp_path):
    pages = styles_pages(view(spark, wide_part(spark, tmp_path, sf), "sp"), SITES["store"])
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    dealt = next(i for i, line in enumerate(plan.splitlines()) if "Repartition" in line)
    below = "\n".join(plan.splitlines()[dealt:])
    assert "from_json" not in below and "regexp" not in below


def test_small_tables_are_read_as_they_are(spark, sf):
    assert "Repartition" not in view(spark, sf, "pp")._jdf.queryExecution().optimizedPlan().toString()
