"""URL filters as of the time of capture (built on DataFrame functions).

Dated list entries (add or remove a pattern) become validity intervals: an
added pattern is active from its entry to the next entry of the same pattern
in the same list. An as-of join then evaluates every capture against the
entries active when it was fetched. A capture looks up its host, the domains
above it, and its path's directories, so patterns are matched by equality.

For the as-of join, intervals are cut at the borders of periods of
``period_days``; captures and pieces meet on (kind, pattern, period), and the
exact times are compared within the period. A popular host's captures are
spread over the periods, adaptive execution splits what is still large, and a
pattern with many entries costs each capture only those of its period.

A capture is rejected if a blocking entry is active for it and no allowing one
is. Defined results: null or unparsable URLs and null times match nothing and
pass; of entries of one pattern and list at one time a removal counts last;
entries with a null field are ignored; repeated rows get equal results; with
empty lists all captures pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    h = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(h != "", h)


def intervals(entries: DataFrame) -> DataFrame:
    """``list, verdict, kind, pattern, valid_from, valid_to`` (null: still valid) of the added patterns."""
    e = entries.select("list", "verdict", "kind", "pattern", "action", "at").dropna()
    order = W.partitionBy("list", "kind", "pattern").orderBy("at", "action")  # 'add' before 'remove'
    return (e.withColumn("valid_to", F.lead("at").over(order)).filter("action = 'add'")
             .filter("valid_to IS NULL OR valid_to > at").withColumnRenamed("at", "valid_from").drop("action"))


def _period(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(time) / seconds)


def _lookups(url: Column, host: Column) -> Column:
    """What a capture may be listed as: array of (kind, pattern)."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("pattern")))
    steps = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(
        F.lit("prefix").alias("kind"), F.concat_ws("/", host, F.slice(steps, F.lit(1), i)).alias("pattern"))))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.concat(own, domains, F.coalesce(paths, F.filter(own, lambda x: F.lit(False))))


def filter_captures(captures: DataFrame, entries: DataFrame, period_days: int = 30, url_col: str = "url", time_col: str = "fetch_time") -> DataFrame:
    """All rows of ``captures`` with ``host``, ``n_active``, ``lists`` (sorted names of the lists with an active
    entry, joined by commas) and ``rejected``."""
    seconds = period_days * 86400
    carry = [c for c in captures.columns if c.lower() not in ("host", "n_active", "lists", "rejected")]
    c = captures.select(F.struct(*carry).alias("row"), F.col(url_col).alias("url"), F.col(time_col).alias("time"))
    asked = c.select("url", "time").dropna().distinct().withColumn("host", host_of(F.col("url"))).filter("host IS NOT NULL")
    asked = (asked.withColumn("period", _period(F.col("time"), seconds))
             .select("url", "time", "period", F.explode(_lookups(F.col("url"), F.col("host"))).alias("l"))
             .select("url", "time", "period", "l.kind", "l.pattern"))
    first, last = c.agg(F.min(_period(F.col("time"), seconds)), F.max(_period(F.col("time"), seconds))).first()
    begin = F.greatest(_period(F.col("valid_from"), seconds), F.lit(first).cast("long"))
    stop = F.least(F.coalesce(_period(F.col("valid_to"), seconds), F.lit(last).cast("long")), F.lit(last).cast("long"))
    pieces = (intervals(entries).withColumn("begin", begin).withColumn("stop", stop).filter("begin <= stop")
              .withColumn("period", F.explode(F.sequence("begin", "stop"))).drop("begin", "stop"))
    active = (asked.join(pieces, ["kind", "pattern", "period"])
              .filter("time >= valid_from AND (valid_to IS NULL OR time < valid_to)")
              .groupBy("url", "time").agg(
                  F.count("*").alias("n_active"), F.concat_ws(",", F.array_sort(F.collect_set("list"))).alias("lists"),
                  (F.max(F.col("verdict") == "block") & ~F.max(F.col("verdict") == "allow")).alias("rejected")))
    out = c.join(active, ["url", "time"], "left")
    return out.select("row.*", host_of(F.col("url")).alias("host"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
                      F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("rejected", F.lit(False)).alias("rejected"))


#: The tables have neither fetch times nor lists, so both are derived from ``pages``: the captures' times from their
#: ids, the entries from the hosts, domains and first directories that occur.
ENTRY_RULES = (
    # list, verdict, kind, pattern, days from 2024-01-01 of: added, removed, added again; one in so many patterns
    ("ads", "block", "host", "host", 1, 100, 200, 1),
    ("malware", "block", "domain", "domain", 150, 220, 420, 3),
    ("partners", "allow", "prefix", "prefix", 60, 300, 500, 2),
)


def derived_captures(pages: DataFrame) -> DataFrame:
    hours = F.pmod(F.col("page_id") * 7919, F.lit(24 * 600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + hours * 3600).alias("fetch_time"))


def derived_entries(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    first_dir = F.element_at(F.split(F.regexp_extract("url", PATH, 1), "/"), 2)
    p = pages.select(host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
                     F.concat_ws("/", host, first_dir).alias("prefix")).filter("host IS NOT NULL").distinct()
    out = None
    for name, verdict, kind, column, added, removed, again, one_in in ENTRY_RULES:
        h = F.conv(F.substring(F.md5(F.concat(F.lit(name), F.col("pattern")).cast("binary")), 1, 4), 16, 10).cast("int")
        each = (p.select(F.col(column).alias("pattern")).distinct().withColumn("h", h).filter(F.col("h") % one_in == 0)
                .select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), "pattern", "h", F.explode(F.array(*[
                    F.struct(F.lit(a).alias("action"), F.lit(d).alias("day")) for a, d in (("add", added), ("remove", removed), ("add", again))])).alias("e"))
                .select("list", "verdict", "kind", "pattern", "e.action",
                        F.timestamp_seconds(F.lit(1704067200) + (F.col("e.day") + F.col("h") % 90) * 86400).alias("at")))
        out = each if out is None else out.unionByName(each)
    return out


def _oracle() -> str:
    host = r"nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"
    path = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    rules = []
    for name, verdict, kind, column, added, removed, again, one_in in ENTRY_RULES:
        for action, day in (("add", added), ("remove", removed), ("add", again)):
            rules.append(f"""SELECT '{name}' AS list, '{verdict}' AS verdict, '{kind}' AS kind, pattern, '{action}' AS action,
    TIMESTAMP '2024-01-01' + to_days(CAST({day} + h % 90 AS INTEGER)) AS entry_time
    FROM (SELECT pattern, CAST(('0x' || substr(md5('{name}' || pattern), 1, 4)) AS INTEGER) AS h FROM (SELECT DISTINCT {column} AS pattern FROM p WHERE host IS NOT NULL))
    WHERE h % {one_in} = 0""")
    return f"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id * 7919 % 14400 AS INTEGER)) AS fetch_time, {host} AS host, {path} AS path FROM pages),
p AS (SELECT host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, host || coalesce('/' || split_part(path, '/', 2), '') AS prefix
    FROM c),
e AS ({" UNION ALL ".join(rules)}),
i AS (SELECT *, lead(entry_time) OVER (PARTITION BY list, kind, pattern ORDER BY entry_time, action) AS valid_to FROM e),
m AS (SELECT c.page_id, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
        bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS rejected
    FROM c JOIN i ON action = 'add' AND fetch_time >= entry_time AND (valid_to IS NULL OR fetch_time < valid_to) AND CASE kind
        WHEN 'host' THEN pattern = host WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
        ELSE starts_with(host || path || '/', pattern || '/') END GROUP BY c.page_id)
SELECT c.page_id, host, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(rejected, FALSE) AS rejected
FROM c LEFT JOIN m ON c.page_id = m.page_id
"""


ORACLE = _oracle()
