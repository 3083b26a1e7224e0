"""Cases beyond the fixture views: damaged JSON, grouped robots files, unclosed
markup, attribute order, page gaps, doubled state, streaming across runs."""

import datetime as dt
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from drapery.functions import html as H
from drapery.operators import crawl as CR
from drapery.operators import elements as E
from drapery.operators import extract as X
from drapery.operators import incremental as INC
from drapery.operators import reports as REP
from drapery.sources import catalog_io as IO
from drapery.sources.sites import SITES
from drapery.streaming import stream_catalog as S

LD = '<script type="application/ld+json">{"@type":"Product","name":"%s","offers":{"price":"19.99"}}</script>'


@pytest.mark.parametrize("broken", ['{"id":1,"title":"x","variants":[{"id":', "{}", " { } ", "[1]", "nonsense", ""])
def test_json_cascade_moves_on(spark, broken):
    html = f'<script id="ProductJson-1" type="application/json">{broken}</script>' + LD % "Valid"
    df = spark.createDataFrame([(1, "https://s/products/v", html)], "page_id int, url string, html string")
    p = df.withColumn("product", X.product_json("html", "url"))
    assert p.first().product.title == "Valid"
    assert X.explode_variants(p).count() == 1
    second = html.replace(LD % "Valid", "") + '<script id="ProductJson-2" type="application/json">{"title":"Second","variants":[]}</script>'
    df = spark.createDataFrame([(1, "u", second)], "page_id int, url string, html string")
    assert df.select(X.json_script_by_id("html").alias("j")).first().j.title == "Second"


ROBOTS = ["User-agent: *\nUser-agent: foo\nDisallow: /a/\nAllow: /", "User-agent: *\n\nDisallow: /", "User-agent: *\nDisallow: /%61/\nDisallow: /c%3Cd",
          "# note\nUser-agent: foo\nDisallow: /\nUser-agent: *\nDisallow:\n", "Disallow: /\nUser-agent: *\nAllow: /a/b\nDisallow: /a/ # tail\n\nUser-agent: *\nDisallow: /b",
          "User-agent: *\r\nDisallow: /b+c\r\nnonsense\r\nSitemap: x", "", "User-agent: foo\nDisallow: /a/"]
PATHS = ["", "/", "/a/", "/a/b/c", "/b", "/b+c", "/c%3cd", "/c<d", "/%61/x", "/a?x=/a/"]


def test_robots_agree_with_the_standard_parser(spark):
    robots = spark.createDataFrame([(f"h{i}.com", t) for i, t in enumerate(ROBOTS)], "host string, robots_txt string")
    urls = [f"https://h{i}.com{p}" for i in range(len(ROBOTS)) for p in PATHS] + ["https://other.com/a/"]
    out = CR.robots_filter(spark.createDataFrame([(u,) for u in urls], "url string"), CR.robots_rules(robots))
    got = {r.url: r.allowed for r in out.collect()}
    assert got.pop("https://other.com/a/")
    for i, text in enumerate(ROBOTS):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        parser.modified()
        for p in PATHS:
            u = f"https://h{i}.com{p}"
            assert got[u] == parser.can_fetch("*", u), (text, p)


def _texts(html, selector, spark):
    df = E.html_elements(spark.createDataFrame([(html,)], "html string"))
    return df.select(F.transform(E.select("elements", selector), lambda e: E.text_of(e)).alias("t")).first().t


def test_unclosed_markup(spark):
    assert _texts("<ul><li>one<li>two<li>three</ul>", "li", spark) == ["one", "two", "three"]
    assert _texts("<p>a<p>b<div>c</div>d", "p", spark) == ["a", "b"]
    assert _texts("<select><option>S<option>M</select>", "option", spark) == ["S", "M"]
    assert _texts("<table><tr><td>1<td>2<tr><td>3</table>", "tr", spark) == ["1 2", "3"]
    assert _texts("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul ul li", spark) == ["b"]
    assert _texts("<div class=x><p>i</div><p>o<![foo[x]]>", "div.x p, p", spark) == ["i", "o"]


def test_elements_stay_linear():
    assert all(len(e["attrs"]) == 0 and "ancestors" not in e for e in E.parse_elements("<li>x" * 2000))
    deep = E.parse_elements("<b>" * 1000)
    assert deep[0]["last_id"] == 999 and deep[999]["last_id"] == 999


def test_links_images_and_meta(spark):
    html = ('<a data-href="/track" href="/products/real">r</a><a href=/bare>b</a><a href=\'/single\'>s</a><img class="a" src="/1.jpg">'
            "<img alt=x data-src='/2.jpg'><img src=/3.jpg><meta data-property=\"og:image\" property='og:image' data-content=\"no\" content=\"/og.jpg\">")
    r = spark.createDataFrame([(html,)], "html string").select(
        H.hrefs("html").alias("a"), H.img_urls("html").alias("i"), H.meta_content("html", "og:image").alias("m")).first()
    assert r.a == ["/products/real", "/bare", "/single"]
    assert r.i == ["/1.jpg", "/2.jpg", "/3.jpg"] and r.m == "/og.jpg"


def test_waists_only_from_size_elements(spark):
    html = '<div class="Size-list">30 32</div><p>$45.50</p><script>{"id":31}</script>'
    df = E.html_elements(spark.createDataFrame([(html,)], "html string"))
    assert df.select(H.waist_sizes(E.size_tokens_of("elements"), F.lit("Bottoms")).alias("w")).first().w == ["30", "32"]


def test_photo_blocks_take_any_descendant(spark):
    from drapery.plans.catalog_v1 import gallery_attr_images
    block = '<div class="pdp-photo-single-column-image"%s>%s</div>'
    html = block % (' data-imageurl=""', '<span><img src="/in.jpg"></span>') + block % (' data-imageurl="/at.jpg"', "") + block % ("", "")
    df = E.html_elements(spark.createDataFrame([(html,)], "html string"))
    assert df.select(gallery_attr_images("elements", F.lit("https://s.org")).alias("g")).first().g == ["https://s.org/in.jpg", "https://s.org/at.jpg"]


def test_page_gaps_end_the_prefix(spark):
    rows = [(0, p, 200, 900, f"https://s/products/{p}") for p in (1, 2, 4, 5)]
    df = spark.createDataFrame(rows, "coll_idx int, page_no int, status int, body_len int, product_url string")
    assert sorted(r.page_no for r in CR.pagination_prefix(df, 10).collect()) == [1, 2]
    assert sorted(r.page_no for r in CR.pagination_two_empty(df, 20).collect()) == [1, 2]


def test_doubled_state_and_pages_stay_one_row(spark):
    pages = spark.createDataFrame([(1, "u", "old"), (2, "u", "new")], "page_id int, url string, html string")
    state = spark.sql("SELECT 'u' AS url, md5('x') AS checksum, TIMESTAMP '2024-01-01' AS last_scraped UNION ALL SELECT 'u', md5('new'), TIMESTAMP '2024-01-02'")
    out = INC.changed_pages(pages, state, dt.datetime(2024, 1, 15))
    assert [r.status for r in out.collect()] == ["same"]
    assert INC.upsert_state(state, out).count() == 1
    assert INC.stale_pages(pages.select("url").distinct(), state, dt.datetime(2024, 1, 15)).count() == 1


def test_failed_pages_count_before_deduplication(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id int, url string")
    rows = spark.createDataFrame([("a", "s"), ("b", "s")], "product_url string, style_id string")
    assert [r.url for r in REP.failed_pages(pages, rows).collect()] == ["c"]
    one = REP.run_summary(pages, rows.filter("product_url = 'a'"), rows, pages.limit(0)).first()
    assert (one.total_variants, one.unique_products, one.failed_products, one.skipped) == (1, 1, 1, 0)


def test_older_csv_is_read_by_name(spark, tmp_path):
    path = f"file://{tmp_path}/old"
    spark.createDataFrame([("Navy", "id1", "7.5", "gone")], "color_name string, style_id string, price string, dropped string").write.option("header", True).csv(path)
    r = IO.read_catalog(spark, path).first()
    assert (r.color_name, r.style_id, r.price, r.color_name_normalized, r.dominant_hex) == ("Navy", "id1", 7.5, "", "")


def test_upsert_keeps_saved_rows(spark, tmp_path):
    path = f"file://{tmp_path}/cat"

    def rows(*x):
        return spark.createDataFrame(list(x), "style_id string, color_name string, price double, audience string, subcategory string")
    assert IO.upsert_catalog(rows(("a", "Red", 1.0, "Women", "Tops"), ("b", "Red", 2.0, "", "")), path) == {"rows": 2, "invalid": 1}
    IO.upsert_catalog(rows(("a", "Red", 3.0, "Women", "Tops"), ("c", "Red", 4.0, "Men", "Tops")), path)
    IO.upsert_catalog(rows().limit(0), path)
    got = IO.read_catalog(spark, path, fmt="parquet")
    assert {(r.style_id, r.price) for r in got.collect()} == {("a", 3.0), ("b", 2.0), ("c", 4.0)}


def _page(i):
    return (i, f"https://shop.example.com/products/p{i}", LD % f"Item {i}")


def test_stream_runs_keep_each_others_rows(spark, tmp_path):
    site, sink = SITES["shop"], f"file://{tmp_path}/sink"
    for run, ids in (("1", range(5)), ("2", range(3, 7))):
        landing = f"file://{tmp_path}/landing{run}"
        S.land_pages(spark.createDataFrame([_page(i) for i in ids], S.PAGES_SCHEMA), landing, 2)
        S.stream_catalog(spark, landing, sink, f"file://{tmp_path}/checkpoint{run}", site).awaitTermination()
    assert S.read_sink(spark, sink).count() == 7
    assert spark.read.parquet(sink).count() == 7
    assert S.batch_progress(spark, sink).select("run_id").distinct().count() == 2


def test_stream_replay_overwrites_only_its_batch(spark, tmp_path):
    """A batch whose commit is lost is run again with the same id: its own URLs must not count as saved."""
    site, sink, ckpt, landing = SITES["shop"], f"file://{tmp_path}/sink", tmp_path / "checkpoint", f"file://{tmp_path}/landing"
    S.land_pages(spark.createDataFrame([_page(i) for i in range(4)], S.PAGES_SCHEMA).coalesce(1), landing, 2)
    S.stream_catalog(spark, landing, sink, f"file://{ckpt}", site).awaitTermination()
    commits = sorted((p for p in (ckpt / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for name in (commits[-1].name, f".{commits[-1].name}.crc"):
        (ckpt / "commits" / name).unlink(missing_ok=True)
    S.stream_catalog(spark, landing, sink, f"file://{ckpt}", site).awaitTermination()
    assert spark.read.parquet(sink).count() == 4
