"""Property tests: column functions against Python's own string methods,
and the streaming plan against the batch plan."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drapery.functions import text as T

WORDS = st.text(alphabet=st.sampled_from(list("abcXYZ éÉ-'1 \t\n ")), max_size=20)


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", fn("v").alias("r")).orderBy("i").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=80))
def test_title_case_matches_python(spark, values):
    assert _apply(spark, T.title_case, values) == [v.title() for v in values]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=80))
def test_strip_and_clean_match_python(spark, values):
    assert _apply(spark, T.strip, values) == [v.strip() for v in values]
    assert _apply(spark, T.clean_text, values) == [" ".join(v.split()) for v in values]


def test_stream_equals_batch(spark, sf):
    from drapery.plans.catalog import catalog_shopify
    from drapery.sources.catalog_io import scratch_path
    from drapery.sources.sites import SITES
    from drapery.sources.tables import view
    from drapery.streaming import stream_catalog as S
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("landing", "sink", "ckpt"))
    S.land_pages(view(spark, sf, "pp"), landing, 40)
    S.stream_catalog(spark, landing, sink, ckpt, SITES["shop"], files_per_trigger=2).awaitTermination()
    stream = S.read_sink(spark, sink)
    batch = catalog_shopify(view(spark, sf, "pp"), SITES["shop"])
    cols = ["style_id", "color_name", "price", "image_url", "fabric_breakdown_pretty"]
    assert sorted(map(tuple, stream.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    # re-running over the same landing folder adds nothing (checkpoint + URL skip)
    S.stream_catalog(spark, landing, sink, ckpt, SITES["shop"]).awaitTermination()
    assert S.read_sink(spark, sink).count() == batch.count()
    assert S.batch_progress(spark, sink).agg(F.sum("rows")).first()[0] == batch.count()
