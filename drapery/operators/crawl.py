"""Crawl-frontier planning over fetched collection pages.

Input rows: ``(coll_idx, page_no, status, body_len, product_url)`` - one
row per product link seen on a collection page. All ordered "stop at the
first ..." loops of the reference become windows over a collection's
pages (a handful of rows per group) or over one row per collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import resolve_url
from ..session import scratch_path


def url_union(links: DataFrame, url: str = "product_url") -> DataFrame:
    return links.select(url).distinct()


def first_seen(links: DataFrame, by, url: str = "product_url") -> DataFrame:
    """First position (``by`` columns, lexicographic) at which each URL appears."""
    by = [by] if isinstance(by, str) else list(by)
    return links.groupBy(url).agg(F.min(F.struct(*by)).alias("_first")).select(url, *[F.col(f"_first.{c}").alias(c) for c in by])


def frontier_limit(links: DataFrame, limit: int, url: str = "product_url", coll: str = "coll_idx",
                   site: str | None = None) -> DataFrame:
    """URLs of the collections taken before the distinct-URL total reached
    ``limit`` (checked after each collection, so it may overshoot). The
    limit is the operator: there is no default.

    New URLs per collection come from a partial aggregation (first-seen
    collection per URL); the running total runs over one row per
    collection (per site), never over URLs.
    """
    keys = [site] if site else []
    fs = links.groupBy(*keys, url).agg(F.min(coll).alias(coll))
    # collections without a new URL add nothing to the total and contribute no
    # URL, so the running sum only needs collections that appear in ``fs``
    per_coll = fs.groupBy(*keys, coll).agg(F.count(F.lit(1)).alias("n_new"))
    if not keys:
        # each of them adds a URL, so none beyond the first ``limit`` can be taken
        per_coll = per_coll.orderBy(coll).limit(limit)
    w = Window.partitionBy(*keys).orderBy(coll).rowsBetween(Window.unboundedPreceding, -1)
    per_coll = per_coll.withColumn("before", F.coalesce(F.sum("n_new").over(w), F.lit(0)))
    taken = per_coll.filter(F.col("before") < limit).select(*keys, coll)
    return fs.join(taken, keys + [coll], "left_semi")


def with_global_index(df: DataFrame, order, partitions: int | None = None) -> DataFrame:
    """Dense 1-based position ``i`` in ``order`` (one column or several) plus
    the ``total``, without a single-partition window.

    The sorted ranges are written once, to the shared folder, and everything
    after reads what was written: borders of a range exchange are sampled anew
    whenever it runs, so counting one run and numbering another would not fit.
    ``monotonically_increasing_id`` holds the written partition in its upper
    bits and the row's place in the lower ones; each partition's offset comes
    from one count per partition, a table bounded by their number and
    therefore broadcast. Rows equal in ``order`` are dealt over ranges as well.
    """
    spark, order = df.sparkSession, [order] if isinstance(order, str) else list(order)
    keys = [*order, "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(partitions, *keys) if partitions else tied.repartitionByRange(*keys)
    path = scratch_path(spark, "ranges")
    ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()).drop("_tie").write.parquet(path)
    ranged = spark.read.parquet(path).withColumn("_pid", F.shiftright("_mid", 33))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", (F.coalesce(F.sum("_n").over(wo), F.lit(0)) - F.col("_first")).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("total"))
    out = ranged.join(F.broadcast(offsets), "_pid")
    return out.withColumn("i", (F.col("_mid") + F.col("_off") + 1).cast("bigint")).drop("_pid", "_off", "_mid")


def sorted_urls(urls: DataFrame, url: str = "product_url") -> DataFrame:
    """Lexicographic processing order with ``i`` of ``total``."""
    return with_global_index(urls.select(url).distinct(), url).select(url, "i", "total")


def expand_collection(collections: DataFrame, max_pages: int, url: str = "collection_url",
                      query_page_hosts=("shop.example.com",)) -> DataFrame:
    """Candidate page URLs 2..max_pages per collection URL.

    Hosts in ``query_page_hosts`` use ``?page=n`` (query dropped); other URLs
    with a query get ``page=n`` set among their parameters; the rest get a
    ``/page/n`` path suffix.
    """
    u = F.col(url)
    on_host = F.lit(False)
    for h in query_page_hosts:
        on_host = on_host | (F.instr(u, h) > 0)
    n = F.col("page_no").cast("string")
    base = F.substring_index(u, "?", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("page="))
    had_page = F.exists(F.split(query, "&"), lambda p: p.startswith("page="))
    new_query = F.when(had_page, F.array_join(F.transform(F.split(query, "&"), lambda p: F.when(
        p.startswith("page="), F.concat(F.lit("page="), n)).otherwise(p)), "&")).otherwise(
        F.array_join(F.concat(params, F.array(F.concat(F.lit("page="), n))), "&"))
    expanded = (F.when(on_host, F.concat(base, F.lit("?page="), n))
                .when(F.instr(u, "?") > 0, F.concat(base, F.lit("?"), new_query))
                .otherwise(F.concat(F.regexp_replace(u, "/+$", ""), F.lit("/page/"), n)))
    # v1 rule: replace an existing ``?page=N``, else append ``?page=n`` to the URL
    v1 = F.when(u.rlike(r"\?page=\d+"), F.regexp_replace(u, r"\?page=\d+", F.concat(F.lit("?page="), n))) \
        .otherwise(F.concat(u, F.lit("?page="), n))
    return (collections.withColumn("page_no", F.explode(F.sequence(F.lit(2), F.lit(max_pages))))
            .withColumns({"page_url": expanded, "page_url_v1": v1}))


def pagination_prefix(pages: DataFrame, max_pages: int, coll: str = "coll_idx") -> DataFrame:
    """Pages 2..max_pages kept until the first one that fails (status 200,
    body > 500 chars, holds a product link) or was never fetched; page 1 is
    the collection itself.

    ``max_pages`` is the rule's own bound: pages beyond it can never be kept,
    so each window partition holds at most ``max_pages`` rows.
    """
    ok = ((F.col("status") == 200) & (F.col("body_len") > 500)
          & F.coalesce(F.instr("product_url", "/products/") > 0, F.lit(False))).cast("int")
    per_page = pages.filter(F.col("page_no") <= max_pages).groupBy(coll, "page_no").agg(F.max(ok).alias("ok"))
    w = Window.partitionBy(coll).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    # the k-th page from 2 on must be page k + 1: a gap ends the prefix
    seen = F.count(F.when(F.col("page_no") >= 2, 1)).over(w)
    per_page = per_page.withColumn("ok", F.when((F.col("page_no") >= 2) & (seen + 1 == F.col("page_no")), F.col("ok"))
                                   .when(F.col("page_no") < 2, F.lit(1)).otherwise(F.lit(0)))
    per_page = per_page.withColumn("all_ok", F.min("ok").over(w))
    return per_page.filter((F.col("page_no") == 1) | (F.col("all_ok") == 1)).select(coll, "page_no")


def pagination_two_empty(pages: DataFrame, max_pages: int, coll: str = "coll_idx") -> DataFrame:
    """v1 pagination: stop at a failed or missing fetch, or after two consecutive
    pages adding no new product URL; at most ``max_pages`` pages (the rule's bound).

    Later pages cannot change which of the first ``max_pages`` are kept, so
    they are dropped first; windows then see at most ``max_pages`` rows per
    collection.
    """
    pages = pages.filter(F.col("page_no") <= max_pages)
    fs = pages.groupBy(coll, "product_url").agg(F.min("page_no").alias("first_page"))
    new_per_page = fs.groupBy(coll, F.col("first_page").alias("page_no")).agg(F.count(F.lit(1)).alias("n_new"))
    per_page = (pages.groupBy(coll, "page_no").agg(F.max((F.col("status") == 200).cast("int")).alias("ok"))
                .join(new_per_page, [coll, "page_no"], "left").fillna(0, ["n_new"]))
    w = Window.partitionBy(coll).orderBy("page_no")
    # page k must be the k-th: after a page that was never fetched nothing follows
    per_page = per_page.withColumn("ok", F.when(F.row_number().over(w) == F.col("page_no"), F.col("ok")).otherwise(F.lit(0)))
    wall = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_page = per_page.withColumn("two_empty", (F.col("n_new") == 0) & (F.lag("n_new").over(w) == 0))
    per_page = per_page.withColumn("stop_at", F.min(F.when(F.col("two_empty"), F.col("page_no"))).over(wall))
    per_page = per_page.withColumn("fail_at", F.min(F.when(F.col("ok") == 0, F.col("page_no"))).over(wall))
    keep = ((F.col("fail_at").isNull() | (F.col("page_no") < F.col("fail_at")))
            & (F.col("stop_at").isNull() | (F.col("page_no") <= F.col("stop_at")))
            & (F.col("page_no") <= max_pages))
    return per_page.filter(keep).select(coll, "page_no", "n_new")


def is_product_url(urls: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """Flag URLs containing any product pattern of their site.

    ``sites`` has one row per configured site; the planner sees its size.
    """
    host = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    s = sites.select(F.col("source_site").alias("_host"), "product_url_patterns")
    j = urls.withColumn("_host", host).join(s, "_host", "left")
    flag = F.coalesce(F.exists("product_url_patterns", lambda p: F.instr(F.col(url), p) > 0), F.lit(False))
    return j.withColumn("is_product", flag).drop("_host", "product_url_patterns")


def first_nonempty_source(records: DataFrame, priority: str = "strategy", site: str | None = None) -> DataFrame:
    """Rows of the highest-priority strategy that produced any row (per site)."""
    keys = [site] if site else []
    best = records.groupBy(*keys).agg(F.min(priority).alias(priority))
    return records.join(best, keys + [priority], "left_semi")


RULES = "array<struct<allow:boolean,path:string>>"


def unquoted(c) -> Column:
    """Percent-decoded text ('+' stays; text that can't be decoded stays whole)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def robots_rules(robots: DataFrame, host: str = "host", text: str = "robots_txt") -> DataFrame:
    """``(host, rules)``: the ordered rules that hold for any agent.

    One fold over a file's lines: consecutive ``User-agent`` lines share a
    group, the next ``User-agent`` line after a rule or a blank line after
    anything ends it, and a group whose agents have no rules yet at a blank
    line is dropped. The first group that names ``*`` counts. An empty
    ``Disallow`` allows everything.
    """
    lines = F.transform(F.split(F.col(text), r"\r\n|\r|\n"), lambda x: F.struct(
        (x == "").alias("blank"), F.trim(F.regexp_replace(x, "#.*$", "")).alias("line")))
    lines = F.transform(lines, lambda x: F.struct(
        x["blank"].alias("blank"), F.lower(F.trim(F.substring_index(x["line"], ":", 1))).alias("key"),
        F.when(F.instr(x["line"], ":") > 0, unquoted(F.trim(F.regexp_replace(x["line"], r"^[^:]*:", "")))).alias("value")))
    none = F.array().cast(RULES)

    def state(stage, star, rules, found, kept):
        return F.struct(stage.alias("stage"), star.alias("star"), rules.alias("rules"), found.alias("found"), kept.alias("kept"))

    def closed(s):  # what is kept once the group ends
        keep = (s["stage"] == 2) & s["star"] & ~s["found"]
        return s["found"] | keep, F.when(keep, s["rules"]).otherwise(s["kept"])

    def step(s, x):
        found, kept = closed(s)
        agent, rule = x["key"] == "user-agent", x["key"].isin("allow", "disallow")
        star = F.coalesce(x["value"] == "*", F.lit(False))
        one = F.array(F.struct(((x["key"] == "allow") | (x["value"] == "")).alias("allow"), x["value"].alias("path"))).cast(RULES)
        return (F.when(x["blank"], state(F.lit(0), F.lit(False), none, found, kept))
                .when(x["value"].isNull(), s)
                .when(agent & (s["stage"] == 2), state(F.lit(1), star, none, found, kept))
                .when(agent, state(F.lit(1), s["star"] | star, s["rules"], s["found"], s["kept"]))
                .when(rule & (s["stage"] > 0), state(F.lit(2), s["star"], F.concat(s["rules"], one), s["found"], s["kept"]))
                .otherwise(s))

    start = state(F.lit(0), F.lit(False), none, F.lit(False), none)
    return robots.select(host, F.aggregate(lines, start, step, lambda s: closed(s)[1]).alias("rules"))


def robots_filter(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Flag URLs by their host's rules: the first rule (in file order) whose path
    prefixes the URL's decides; hosts without rules allow everything. One join
    on the host, one row per host; the rules are tested inside the URL's row."""
    host = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(unquoted(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    u = urls.select(url, host.alias("host"), F.when(path == "", F.lit("/")).otherwise(path).alias("_path"))
    hit = F.get(F.filter("rules", lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])), 0)
    return u.join(rules.select("host", "rules"), "host", "left").select(url, "host", F.coalesce(hit["allow"], F.lit(True)).alias("allowed"))


def resolve_links(hrefs: DataFrame, href: str, base) -> DataFrame:
    return hrefs.withColumn("abs_url", resolve_url(href, base))
