"""Character references, URL resolution and the global index against the standard library."""

import html
import random
from html.entities import html5
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from drapery.functions import html as H
from drapery.functions import keys as K
from drapery.functions.fabric import fabric_summary
from drapery.operators import crawl as CR


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def reference_texts():
    rng = random.Random(11)
    names = rng.sample(sorted(html5), 150)
    texts = ["", "&", "&&amp;&", "a & b", "&amp;lt;", "&#8211;", "&#x2013;x", "&#X2013", "&#0;", "&#128;", "&#x81;", "&#xD800;", "&#1114112;", "&#99999999999999999999;",
             "&#xFFFFFFFFFFFF;", "&#1;&#11;&#127;&#xFDD0;&#x1FFFF;", "&#13;&#9;", "&#;&#x;&;", "&notit;", "&not it", "&copy=1", "&copy2", "&ampere", "&AMP", "&unknown;",
             "&CounterClockwiseContourIntegral;", "&#0000000000065;", "100% Organic Cotton &#8211; Your new favorite hoodie", "55% hemp &ndash; soft", "😀&#128512;&NotEqualTilde;"]
    for n in names:
        texts += [f"x&{n}y", f"&{n} &{n}=", f"&{n};;"]
    alphabet = ["&", "#", "x", "1", "65", "amp", "lt", ";", "=", " ", "not", "in", "copy", "é", "A"]
    return texts + ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(300)]


def test_references_in_text(spark):
    texts = reference_texts()
    got = values(spark, texts, H.unescape)
    assert [(t, g) for t, g, e in zip(texts, got, map(html.unescape, texts)) if g != e] == []
    assert values(spark, [None], H.unescape) == [None]


def test_references_in_attributes(spark):
    texts = ["/a?x=1&copy=2", "/a?x&amp;y", "&copy;=1", "&copy 1", "&copy2", "&notit;", "&#65=&#x42;", "&lt", "&eacute;t&eacute", "&amp&lt=&gt"]
    want = ["/a?x=1&copy=2", "/a?x&y", "©=1", "© 1", "&copy2", "&notit;", "A=B", "<", "été", "&&lt=>"]
    assert values(spark, texts, lambda c: H.unescape(c, attribute=True)) == want


def test_references_in_fabrics(spark):
    df = spark.createDataFrame([("<p>100% Organic Cotton &#8211; Your new favorite hoodie</p>",), ("55% hemp &ndash; soft",)], "h string")
    got = df.select(fabric_summary(H.html_to_text("h")).alias("f")).collect()
    assert [r.f.breakdown for r in got] == ["100% Organic Cotton", "55% hemp"]


RFC = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g",
       "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/./y", "g;x=1/../y", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x",
       "g:h", "mailto:a@b", "a//b", "/a//b", "a//../b", "../x/./y", "/a/./b/../c/.", "   g  "]
BASES = ["http://a/b/c/d;p?q", "https://a.com/b/c/d", "https://a.com", "https://a.com/", "https://a.com/b//c/", "https://a.com/x?y=1/../2#f", "https://a.com/a/../b/./c"]


def test_resolve_like_the_standard(spark):
    rng = random.Random(2)
    hrefs = RFC + ["/".join(rng.choices(["..", ".", "a", "b", ""], k=rng.randint(1, 6))) for _ in range(120)]
    hrefs = [h for h in hrefs if not h.startswith("//") or h == "//g"]
    df = spark.createDataFrame([(b, h) for b in BASES for h in hrefs], "b string, h string")
    got = df.select("b", "h", K.resolve_url("h", "b").alias("u")).collect()
    bad = [(r.b, r.h, r.u, urljoin(r.b, r.h.strip())) for r in got if r.u != urljoin(r.b, r.h.strip())]
    assert bad[:6] == []
    assert df.limit(1).select(K.resolve_url(F.lit(None).cast("string"), "b").alias("u")).first().u is None


def test_global_index_with_more_columns(spark):
    n = 300_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(F.lit("x"), F.repeat(F.lit("y"), (F.col("id") % 40).cast("int"))).alias("other"))
    out = CR.with_global_index(df, "k", partitions=13)
    r = out.agg(F.count_distinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("z"), F.max("total").alias("t")).first()
    assert (r.d, r.a, r.z, r.t) == (n, 1, n, n)
    pairs = out.alias("a").join(out.alias("b"), F.col("a.i") + 1 == F.col("b.i"))
    assert pairs.filter(F.col("a.k") > F.col("b.k")).count() == 0 and set(out.columns) == {"k", "other", "i", "total"}


@pytest.mark.parametrize("rows", [[], [("a", 1)] * 500 + [(None, 2), ("b", 3)]])
def test_global_index_ties_and_nothing(spark, rows):
    out = CR.with_global_index(spark.createDataFrame(rows, "k string, v int"), ["k", "v"], partitions=4)
    got = sorted((r.i, r.k is not None, r.k) for r in out.collect())
    assert [g[0] for g in got] == list(range(1, len(rows) + 1)) and [g[1] for g in got] == sorted(g[1] for g in got)
