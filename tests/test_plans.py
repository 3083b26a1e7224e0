"""One-pass plans: mixed sites, the run summary, the product cascade, large rule tables, nearest colours."""

import random

import pytest
from pyspark.sql import functions as F

from drapery.functions import color as C
from drapery.functions import rules as R
from drapery.operators import reports as REP
from drapery.operators.extract import with_product
from drapery.plans.catalog import catalog_rows, catalog_shopify, page_keys
from drapery.plans.catalog_mixed import catalog_mixed, mixed_rows, routed, with_entries
from drapery.sources.sites import SITES
from drapery.sources.tables import view

LD = '<script type="application/ld+json">{"@type":"Product","name":"%s","offers":{"price":"5.00"}}</script>'
MAP = '<script>window.gap.properties.styles = {"k1":{"displayName":"Navy"},"k2":{"displayName":"Red"}};</script>'


def pages_of(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_strategies_are_tried_in_the_order_of_the_layout(spark):
    shop, store = "https://shop.example.com/products/", "https://store.example.org/browse/product.do?pid="
    pages = pages_of(spark, (shop + "a", LD % "A" + MAP), (store + "1", LD % "B" + MAP), (shop + "b", MAP), (store + "2", LD % "C"),
                     ("https://unknown.example/products/x", LD % "D"), (shop + "c", "<p>nothing</p>"), (None, LD % "E"), (shop + "d", None))
    got = {r.page_id: (r.strategy, len(r.entries)) for r in with_entries(routed(pages)).collect()}
    assert got == {0: ("product", 1), 1: ("styles", 2), 2: ("styles", 2), 3: ("product", 1)}
    rows = sorted((r.page_id, r.pos, r.color_name, r.brand_name) for r in mixed_rows(pages).collect())
    assert [r[0] for r in rows if r[0] in (1, 2)] == [1, 1, 2, 2]
    assert {r[3] for r in rows if r[0] in (1, 3)} <= {"Example Store"} and {r[3] for r in rows if r[0] in (0, 2)} <= {"Example Shop"}


def test_mixed_catalog_scans_once_and_agrees(spark, sf):
    pages = view(spark, sf, "pp").select("page_id", "url", "html")
    out = catalog_mixed(pages)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    own = catalog_shopify(view(spark, sf, "pp"), SITES["shop"])
    assert sorted(map(str, out.select(*own.columns).collect())) == sorted(map(str, own.collect()))


def test_cascade_is_evaluated_once(spark, sf):
    plan = catalog_rows(view(spark, sf, "pp"), SITES["shop"]).select("style_id", "color_name", "price", "product_title")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    once = with_product(view(spark, sf, "pp")).select("product")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ShopifyAnalytics") == once.count("ShopifyAnalytics")


def test_summary_of_one_pass(spark):
    shop = "https://shop.example.com/products/"
    pages = pages_of(spark, (shop + "a", LD % "A"), (shop + "a?x", LD % "A again"), (shop + "b", "<p>"), (shop + "c", None), (shop + "d", LD % "D"), (shop + "b", "<p>"),
                     (shop + "e", "<p>"), (shop + "e", LD % "E"))
    existing = spark.createDataFrame([(shop + "d",), (shop + "b",), (shop + "b",)], "url string")
    keys = page_keys(pages)
    assert keys.filter("first").count() == 8
    r = REP.page_summary(keys, existing).first()
    rows = catalog_rows(pages, SITES["shop"])
    old = REP.run_summary(pages, catalog_shopify(pages, SITES["shop"]), rows, pages.join(existing.distinct(), "url", "left_semi")).first()
    assert r.asDict() == old.asDict() and (r.failed_products, r.skipped) == (3, 3)
    assert REP.page_summary(page_keys(pages.limit(0))).first().asDict() == {"total_variants": 0, "unique_products": 0, "failed_products": 0, "skipped": 0}


@pytest.mark.parametrize("max_rules", [1000, 7])
def test_rules_by_index_equal_the_array_form(spark, max_rules):
    rng = random.Random(4)
    letters = "abcdeé "
    word = lambda n: "".join(rng.choices(letters, k=n))
    rules = [(rng.randint(1, 30), rng.choice("xyz"), word(rng.randint(2, 5)).upper()) for _ in range(80)] + [(31, "all", "")]
    texts = [(i, word(rng.randint(0, 40))) for i in range(300)] + [(300, None), (301, "")]
    for table in (rules, rules[:-1], []):
        r = spark.createDataFrame(table, "rank int, label string, keyword string")
        df = spark.createDataFrame(texts, "i int, t string")
        a = R.classify_by_table(df, "t", r, "none", "label") if table else df.withColumn("label", F.lit("none"))
        b = R.classify_by_index(df, "t", r, "none", "label", max_rules=max_rules)
        assert sorted(map(str, a.select("i", "label").collect())) == sorted(map(str, b.select("i", "label").collect()))


def test_twenty_thousand_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rules = spark.range(20_000).select(F.col("id").cast("int").alias("rank"), F.concat(F.lit("l"), F.col("id") % 7).alias("label"),
                                       F.substring(F.md5(F.col("id").cast("string")), 1, 4).alias("keyword"))
    words = docs.select(F.explode(F.split("text", " ")).alias("keyword")).filter("length(keyword) > 6").distinct().limit(5)
    rules = rules.unionByName(words.select(F.lit(30_000).alias("rank"), F.lit("word").alias("label"), "keyword"))
    got = R.classify_by_index(docs, "text", rules, "none", "label")
    assert got.count() == docs.count() and got.filter("label = 'word'").count() > 0


def test_nearest_colour_is_the_nearest(spark):
    rng = random.Random(9)
    colours = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(3000)]
    colours += [(r, g, b) for r in (0, 31, 32, 255) for g in (0, 127, 128, 255) for b in (0, 31, 224, 255)]
    palette = C._palette()
    df = spark.createDataFrame([("#%02x%02x%02x" % c, *c) for c in colours], "h string, r int, g int, b int")
    for r in df.withColumn("name", C.css_color_nearest("h")).collect():
        best = min(range(len(palette)), key=lambda i: sum((x - y) ** 2 for x, y in zip(palette[i][1], (r.r, r.g, r.b))))
        assert r.name == palette[best][0]
    assert [r.n for r in spark.createDataFrame([(None,), ("",), ("xyz",)], "h string").select(C.css_color_nearest("h").alias("n")).collect()] == ["Default"] * 3
