"""URL filters by a temporal list join: dated list entries become validity intervals, and an as-of join evaluates every
capture against the entries that were active when it was fetched.

A capture is looked up under its host, each parent domain, and each leading part of its path. Captures of one key and time
are combined before the join, so a common host costs a row for each distinct time and task; decisions go back to the
captures by join. Times and intervals of a key are put in one order and gone through once, each time taking the last interval
that has begun. A key with more than TIMES of both has its time range cut into slices, its intervals being cut at their
borders, and is gone through slice by slice, so it is spread over tasks; all other keys have one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, stored, table

#: Distinct times and intervals of a key in one slice, about.
TIMES = 10_000


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _keys(url: Column, most: int) -> Column:
    """Host, parent domains of at least two labels, and host with the leading parts of the path, at most `most` parts."""
    labels = F.split(_host(url), r"\.")
    parts = F.filter(F.split(_path(url), "/"), lambda x: x != "")
    n, m = F.size(labels), F.least(F.size(parts), F.lit(most))
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(_host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, paths))


def validity(entries: DataFrame) -> DataFrame:
    """entries(key, at, action) -> intervals (key, action, valid_from, valid_to), valid_to null while it still holds.

    The actions "block" and "allow" hold from their time until the key's next entry; "remove" ends what holds. Of several
    entries of a key at one time, remove gives way to block and block to allow. Rows without a key or time are left out.
    """
    rank = F.expr("CASE action WHEN 'allow' THEN 3 WHEN 'block' THEN 2 WHEN 'remove' THEN 1 END")
    one = entries.where("key IS NOT NULL AND at IS NOT NULL").withColumn("rank", rank).where("rank IS NOT NULL").groupBy("key", "at").agg(F.max("rank").alias("rank"))
    next_at = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return one.withColumn("valid_to", next_at).where("rank > 1").select("key", F.when(F.col("rank") == 3, "allow").otherwise("block").alias("action"), F.col("at").alias("valid_from"), "valid_to")


def temporal_filter(captures: DataFrame, entries: DataFrame, per_slice: int = TIMES) -> DataFrame:
    """captures(page_id, url, fetched) and entries(key, at, action) -> one row per capture: page_id, url, fetched,
    decision ("block", "allow" by an entry, or "none"), matched (the key of the deciding entry) and valid_from (its time; -1
    for none).

    Of the entries active at the fetch time, valid_from <= fetched < valid_to, the longest key decides. Keys are hosts or
    domains such as "a.example.com", which hold for all hosts under them, or a host with leading path parts. Null urls,
    urls without a host, and captures without a time match nothing. Repeated captures are decided each for itself. Very
    long urls are looked up by no more path parts than an entry has. An empty capture table gives no rows, an empty list "none" for all; other columns are ignored.
    """
    spans = stored(validity(entries), "url-entries")
    most = spans.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0  # no entry has more parts of a path
    rows = captures.select(F.xxhash64("url").alias("u"), "page_id", "url", F.col("fetched").cast("long").alias("fetched"))
    asked = rows.where("url IS NOT NULL AND fetched IS NOT NULL").select("url", "fetched", F.explode(_keys(F.col("url"), most)).alias("key")).where("key <> ''")
    times = stored(asked.select("key", "fetched").distinct(), "url-times")
    both = times.unionByName(spans.select("key", F.col("valid_from").cast("long").alias("fetched")))
    hot = both.groupBy("key").agg(F.count("*").alias("n"), F.min("fetched").alias("low"), F.max("fetched").alias("high")).where(F.col("n") > per_slice)
    hot = by_size(stored(hot.select("key", "low", F.greatest((F.col("high") - F.col("low")) / F.ceil(F.col("n") / per_slice), F.lit(1e-9)).alias("length"), F.ceil(F.col("n") / per_slice).alias("slices")), "url-hot"))

    def slice_of(time) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("slices") - 1, F.floor((time - F.col("low")) / F.col("length"))))

    asked_at = times.join(hot, "key", "left").withColumn("slice", F.coalesce(slice_of(F.col("fetched")), F.lit(0))).select("key", "fetched", "slice")
    cut = spans.join(hot, "key", "left").withColumn("first", F.coalesce(slice_of(F.col("valid_from")), F.lit(0))).withColumn("last", F.coalesce(F.when(F.col("valid_to").isNull(), F.col("slices") - 1).otherwise(slice_of(F.col("valid_to"))), F.lit(0)))
    cut = cut.withColumn("slice", F.explode(F.sequence("first", "last"))).select("key", "slice", "action", "valid_from", "valid_to")
    span = "struct<action:string,valid_from:bigint,valid_to:bigint>"
    # Intervals of a key do not overlap, so the last one that has begun is the only one that may hold.
    begun = cut.select("key", "slice", F.col("valid_from").cast("long").alias("time"), F.lit(0).alias("asks"), F.struct("action", "valid_from", "valid_to").cast(span).alias("span"))
    asks = asked_at.select("key", "slice", F.col("fetched").alias("time"), F.lit(1).alias("asks"), F.lit(None).cast(span).alias("span"))
    order = Window.partitionBy("key", "slice").orderBy("time", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = begun.unionByName(asks).withColumn("span", F.last("span", ignorenulls=True).over(order)).where("asks = 1").select("key", F.col("time").alias("fetched"), "span.*")
    met = stored(met.where("valid_from IS NOT NULL AND (valid_to IS NULL OR fetched < valid_to)").select("key", "fetched", "action", "valid_from"), "url-matches")
    best = asked.join(met, ["key", "fetched"]).groupBy("url", "fetched").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "valid_from")).alias("best"))
    out = rows.join(best, ["url", "fetched"], "left")
    return out.select("page_id", "url", "fetched", F.coalesce("best.action", F.lit("none")).alias("decision"), F.col("best.key").alias("matched"), F.coalesce("best.valid_from", F.lit(-1)).alias("valid_from"))


#: Days over which the derived captures and entries lie.
DAYS = 2000


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of pages. The tables have no fetch times and no list, so both are derived from the page number: page p was
    fetched on day 37 p mod DAYS; every page whose number divides by 8 brings a report, dated day 101 p mod DAYS, on its
    host (p / 8 odd) or on its host and first path part: block, allow and remove in turn by p / 8 mod 5."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(DAYS)).alias("fetched"))
    turn = F.floor(F.col("page_id") / 8).cast("long")
    first = F.regexp_extract(_path(F.col("url")), r"^/+([^/]+)", 1)
    key = F.when((turn % 2 == 0) & (first != ""), F.concat(_host(F.col("url")), F.lit("/"), first)).otherwise(_host(F.col("url")))
    entries = pages.where(F.col("page_id") % 8 == 0).select(key.alias("key"), F.pmod(F.col("page_id") * 101, F.lit(DAYS)).alias("at"), F.expr("CASE pmod(floor(page_id / 8), 5) WHEN 0 THEN 'allow' WHEN 1 THEN 'remove' ELSE 'block' END").alias("action"))
    return temporal_filter(captures, entries)


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, (page_id * 37) % 2000 AS fetched,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
e AS (
  SELECT CASE WHEN (page_id // 8) % 2 = 0 AND regexp_extract(path, '^/+([^/]+)', 1) <> '' THEN host || '/' || regexp_extract(path, '^/+([^/]+)', 1) ELSE host END AS key,
    (page_id * 101) % 2000 AS at_day, CASE (page_id // 8) % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS rank
  FROM p WHERE page_id % 8 = 0),
o AS (SELECT key, at_day, max(rank) AS rank FROM e WHERE key <> '' GROUP BY key, at_day),
v AS (SELECT key, CASE rank WHEN 3 THEN 'allow' ELSE 'block' END AS action, rank, at_day AS valid_from, lead(at_day) OVER (PARTITION BY key ORDER BY at_day) AS valid_to FROM o),
l AS (SELECT page_id, fetched, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p WHERE host <> ''),
k AS (
  SELECT DISTINCT page_id, fetched, key FROM (
    SELECT page_id, fetched, array_to_string(labels[i:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM l)
    UNION ALL
    SELECT page_id, fetched, host || '/' || array_to_string(parts[1:i], '/') FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l))),
b AS (
  SELECT k.page_id, v.key, v.action, v.valid_from, row_number() OVER (PARTITION BY k.page_id ORDER BY length(v.key) DESC, v.key DESC) AS r
  FROM k JOIN v ON k.key = v.key AND v.rank > 1 AND v.valid_from <= k.fetched AND (v.valid_to IS NULL OR k.fetched < v.valid_to))
SELECT p.page_id, p.url, p.fetched, coalesce(b.action, 'none') AS decision, b.key AS matched, coalesce(b.valid_from, -1) AS valid_from FROM p LEFT JOIN b ON b.page_id = p.page_id AND b.r = 1
"""
