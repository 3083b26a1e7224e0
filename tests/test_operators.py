"""DataFrame operators: properties from SURVEY §5 (c)."""

import datetime as dt

from pyspark.sql import functions as F

from drapery.operators import crawl as CR
from drapery.operators import incremental as INC
from drapery.operators.elements import html_elements, select, text_of
from drapery.operators.records import dedup_first, standardize, CATALOG_COLUMNS


def test_dedup_first_keeps_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(1, 0, "s", "black", "a"), (1, 2, "s", "black", "b"), (2, 0, "s", "black", "c"),
                                (2, 1, "s", "navy", "d")], "page_id int, pos int, style_id string, color_name string, v string")
    once = dedup_first(df, ["style_id", "color_name"], ["page_id", "pos"])
    twice = dedup_first(once, ["style_id", "color_name"], ["page_id", "pos"])
    assert sorted(r.v for r in once.collect()) == ["a", "d"]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_standardize_total(spark):
    df = spark.createDataFrame([("x", "False", "12.5")], "color_name string, is_apparel string, price string")
    r = standardize(df).first()
    assert list(r.asDict()) == CATALOG_COLUMNS
    assert r.color_name == "X" and r.is_apparel is False and r.price == 12.5 and r.price_raw == "$12.50"
    assert r.schema_version == 3 and r.sku == ""


def test_changed_pages_twice_is_empty(spark):
    pages = spark.createDataFrame([("u1", "<p>a</p>"), ("u2", "<p>b</p>")], "url string, html string")
    state = spark.createDataFrame([], "url string, checksum string, last_scraped timestamp")
    now = dt.datetime(2024, 1, 15)
    ch = INC.changed_pages(pages, state, now)
    assert ch.filter("is_changed").count() == 2
    state2 = INC.upsert_state(state, ch)
    assert INC.changed_pages(pages, state2, now).filter("is_changed").count() == 0


def test_robots(spark):
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private/\nAllow: /")],
                                   "host string, robots_txt string")
    urls = spark.createDataFrame([("https://a.com/private/x",), ("https://a.com/ok",), ("https://b.com/private/x",)],
                                 "url string")
    out = {r.url: r.allowed for r in CR.robots_filter(urls, CR.robots_rules(robots)).collect()}
    assert out == {"https://a.com/private/x": False, "https://a.com/ok": True, "https://b.com/private/x": True}


def test_global_index(spark):
    df = spark.createDataFrame([(u,) for u in ["c", "a", "b", "d"]], "product_url string")
    r = [(x.product_url, x.i, x.total) for x in CR.sorted_urls(df).orderBy("i").collect()]
    assert r == [("a", 1, 4), ("b", 2, 4), ("c", 3, 4), ("d", 4, 4)]


def test_elements_and_selectors(spark):
    html = ('<html><body><div class="product__media"><img src="/a.jpg"><img data-src="/b.jpg"></div>'
            '<nav><a href="/x">x</a></nav><p>one <b>two</b></p><script>var s="<p>";</script></body></html>')
    df = html_elements(spark.createDataFrame([(1, html)], "page_id int, html string"))
    r = df.select(F.size(select("elements", "div.product__media img")).alias("imgs"),
                  F.size(select("elements", "nav a, p")).alias("n"),
                  text_of(F.get(select("elements", "p"), 0)).alias("pt")).first()
    assert (r.imgs, r.n, r.pt) == (2, 2, "one two")


def test_registry_runs_sites(spark, sf):
    from drapery.registry import register_site, run_sites, site_transform
    from drapery.sources.tables import view
    out = run_sites({"shop": view(spark, sf, "pp"), "store": view(spark, sf, "sp")})
    assert set(r.brand_name for r in out.select("brand_name").distinct().collect()) == {"Example Shop", "Example Store"}
    register_site("noop", lambda df: df.limit(0))
    assert site_transform("noop")(view(spark, sf, "pp")).count() == 0


def test_write_catalog_skips_empty(spark):
    from drapery.sources import catalog_io as IO
    path = IO.scratch_path(spark, "empty")
    empty = spark.createDataFrame([], "style_id string, color_name string")
    IO.write_catalog(empty, path)
    assert IO.read_catalog(spark, path).count() == 0   # missing file -> empty frame


def test_v1_element_operators_on_literal_html(spark):
    from drapery.plans import catalog_v1 as V
    pages = spark.createDataFrame([
        (1, '<div data-colorname="">swatch</div><span class="product-price">$1,299.00</span>'
            '<ul class="product-information-item__list"><li>ab</li><li>70% wool, 30% silk</li></ul>'),
        (2, '<span class="colorName">$19.99</span><span class="price">Sold out</span><p>Soft wool blend</p>'),
        (3, '<button data-colorname="Olive">o</button><button data-colorname="Olive">o</button>'),
    ], "page_id int, html string")
    el = html_elements(pages)
    r = {x.page_id: x for x in el.select(
        "page_id", V.page_color_name("elements").alias("color"), V.price_from_elements("elements").alias("p"),
        V.info_list_materials("elements").alias("m"),
        F.transform(V.swatch_colors("elements"), lambda s: s["color_name"]).alias("sw")).collect()}
    assert r[1].color == "swatch" and r[1].p.price_raw == "$1299.00" and r[1].m == "70% wool, 30% silk"
    assert r[2].color == "Default" and r[2].p.price_raw == "Sold out" and r[2].m == "Soft wool blend"
    assert r[3].sw == ["Olive"] and r[2].sw == ["Default"]
