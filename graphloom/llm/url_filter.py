"""URL filters that know time: dated list entries become validity intervals, captures are joined as of their fetch time.

An entry adds or removes a pattern of a category at a time. Kinds of patterns: ``host`` (exact host), ``domain`` (the
host or any host below it) and ``prefix`` (host and leading path segments). Entries of a (kind, pattern, category) in
order of time give intervals [add, next entry); of entries at one time the add counts. A capture is looked up under all
patterns it can match, by an equi join with the interval as a residual; that join is a broadcast only if the intervals
are measured to be small.

Nulls and edge cases: a null or unparsable url matches nothing; a null fetch time matches nothing; entries with a null
pattern or time are ignored, and repeated entries count once; repeated captures each give a row; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def lookup_keys(url: Column, longest: int) -> Column:
    """All (kind, pattern) under which a capture of the url can be listed, if prefixes have at most ``longest`` path segments."""
    host, segments = host_of(url), path_segments(url)
    labels = F.split(host, "[.]", -1)
    n = F.size(labels)
    key = lambda kind, p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern"))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: key("domain", F.array_join(F.slice(labels, i, n), ".")))
    depth = F.least(F.size(segments), F.lit(longest))
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(steps, lambda i: key("prefix", F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    return F.when(host == "", none).otherwise(F.concat(F.array(key("host", host)), domains, prefixes))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, valid_from, valid_to (null: still listed) from entries (kind, pattern, category, action, at)."""
    known = entries.select("kind", F.lower("pattern").alias("pattern"), "category", "action", "at").where("pattern is not null and at is not null").distinct()
    order = Window.partitionBy("kind", "pattern", "category").orderBy("at", F.desc("action"))
    return (
        known.withColumn("valid_to", F.lead("at").over(order))
        .where("action = 'add' and (valid_to is null or valid_to > at)")
        .select("kind", "pattern", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, n_active (active entries that match), categories (sorted, comma-joined), blocked."""
    spans = materialize(validity_intervals(entries), "url-intervals")
    longest = spans.where("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/", -1)) - 1)).first()[0] or 0
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched", lookup_keys(F.col("url"), longest).alias("keys"), F.monotonically_increasing_id().alias("row"))
    keyed = rows.select("page_id", "host", "fetched", "row", F.explode_outer("keys").alias("k"))
    found = keyed.join(
        maybe_broadcast(spans, spans.count(), 160),
        (F.col("k.kind") == spans["kind"]) & (F.lower(F.col("k.pattern")) == spans["pattern"])
        & (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))),
        "left",
    )
    out = found.groupBy("row", "page_id", "host", "fetched").agg(F.count("valid_from").alias("n_active"), F.collect_set("category").alias("c"))
    return out.select("page_id", "host", "fetched", "n_active", F.array_join(F.array_sort("c"), ",").alias("categories"), (F.col("n_active") > 0).alias("blocked"))


def stand_in_fetch_day(page_id: Column) -> Column:
    """The tables carry no fetch times: a day from 0 to 364 that follows from the id."""
    return F.pmod(page_id * 7919, F.lit(365)).cast("int")


def stand_in_entries(pages: DataFrame) -> DataFrame:
    """The tables carry no list: dated entries for hosts, domains and prefixes that occur, drawn by MD5."""
    h = host_of(F.col("url"))
    seg = F.get(path_segments(F.col("url")), 0)
    named = pages.select(h.alias("host"), F.lower(F.concat(h, F.lit("/"), seg)).alias("prefix")).where("host <> ''").distinct()
    draw = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    hosts = named.select(F.col("host").alias("p")).distinct().withColumn("m", draw(F.col("p")))
    domains = named.select(F.regexp_extract("host", r"([^.]+[.][^.]+)$", 1).alias("p")).where("p <> ''").distinct().withColumn("m", draw(F.col("p")))
    prefixes = named.select(F.col("prefix").alias("p")).where("p is not null").distinct().withColumn("m", draw(F.col("p")))

    def entry(df: DataFrame, when: str, kind: str, category: str, action: str, at: str) -> DataFrame:
        return df.where(when).select(F.lit(kind).alias("kind"), F.col("p").alias("pattern"), F.lit(category).alias("category"), F.lit(action).alias("action"), F.expr(at).cast("int").alias("at"))

    return (
        entry(hosts, "m % 3 = 0", "host", "spam", "add", "m % 200")
        .union(entry(hosts, "m % 3 = 0", "host", "spam", "remove", "m % 200 + 60"))
        .union(entry(hosts, "m % 15 = 0", "host", "spam", "add", "m % 200 + 120"))
        .union(entry(domains, "m % 4 = 1", "domain", "adult", "add", "m % 300"))
        .union(entry(prefixes, "m % 6 = 2", "prefix", "malware", "add", "m % 250"))
        .union(entry(prefixes, "m % 12 = 2", "prefix", "malware", "remove", "m % 250 + 30"))
    )


SQL = r"""
WITH p AS (
  SELECT page_id, (page_id * 7919) % 365 AS fetched,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages),
named AS (SELECT DISTINCT host, CASE WHEN len(seg) > 0 THEN lower(host || '/' || seg[1]) END AS prefix FROM p WHERE host <> ''),
hosts AS (SELECT DISTINCT host AS p, ('0x' || substr(md5(host), 1, 6))::INT AS m FROM named),
doms AS (SELECT p, ('0x' || substr(md5(p), 1, 6))::INT AS m FROM (SELECT DISTINCT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS p FROM named) WHERE p <> ''),
prefs AS (SELECT p, ('0x' || substr(md5(p), 1, 6))::INT AS m FROM (SELECT DISTINCT prefix AS p FROM named WHERE prefix IS NOT NULL)),
entries AS (
  SELECT 'host' AS kind, p AS pattern, 'spam' AS category, 'add' AS action, m % 200 AS dy FROM hosts WHERE m % 3 = 0
  UNION SELECT 'host', p, 'spam', 'remove', m % 200 + 60 FROM hosts WHERE m % 3 = 0
  UNION SELECT 'host', p, 'spam', 'add', m % 200 + 120 FROM hosts WHERE m % 15 = 0
  UNION SELECT 'domain', p, 'adult', 'add', m % 300 FROM doms WHERE m % 4 = 1
  UNION SELECT 'prefix', p, 'malware', 'add', m % 250 FROM prefs WHERE m % 6 = 2
  UNION SELECT 'prefix', p, 'malware', 'remove', m % 250 + 30 FROM prefs WHERE m % 12 = 2),
spans AS (
  SELECT * FROM (SELECT *, lead(dy) OVER (PARTITION BY kind, pattern, category ORDER BY dy, action DESC) AS until FROM entries)
  WHERE action = 'add' AND (until IS NULL OR until > dy)),
keys AS (
  SELECT page_id, fetched, 'host' AS kind, host AS pattern FROM p WHERE host <> ''
  UNION ALL SELECT page_id, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
    FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(i) WHERE host <> ''
  UNION ALL SELECT page_id, fetched, 'prefix', lower(host || '/' || array_to_string(list_slice(seg, 1, i), '/'))
    FROM p, unnest(range(1, least(len(seg), 8) + 1)) AS u(i) WHERE host <> ''),
hits AS (
  SELECT page_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c
  FROM keys k JOIN spans s ON k.kind = s.kind AND k.pattern = s.pattern AND k.fetched >= s.dy AND (s.until IS NULL OR k.fetched < s.until)
  GROUP BY page_id)
SELECT page_id, host, fetched::INT AS fetched, coalesce(n, 0) AS n_active, coalesce(c, '') AS categories, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN hits USING (page_id)
"""
