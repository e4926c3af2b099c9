"""Joins that the graph needs beyond equality: interval, forward as-of, longest prefix, wildcard routes, RPC names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import ascii_lower, trimmed
from graphloom.functions.text import is_generic_route

TOLERANCE = 12
#: Lines of a bin: the range joins have an equality on it, so a file of many spans is no single group.
BIN_LINES = 64


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BIN_LINES), F.greatest(F.floor(first / BIN_LINES), F.floor(last / BIN_LINES)))).alias("__bin")


def enclosing(points: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Points (key, line) with ``enclosing``: the span (key, id, start, end, seq) around the line that starts last."""
    s = spans.where("start <= end").select(*key, F.col("id").alias("__id"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("seq").alias("__q"), _bins(F.col("start"), F.col("end")))
    at = points.select(*key, "line").distinct().withColumn("__bin", F.floor(F.col("line") / BIN_LINES))
    best = at.join(s, [*key, "__bin"]).where("line between __s and __e").groupBy(*key, "line").agg(F.max_by("__id", F.struct("__s", "__q")).alias("enclosing"))
    return points.join(best, [*key, "line"], "left")


def following(points: DataFrame, spans: DataFrame, key: list[str], tolerance: int = TOLERANCE) -> DataFrame:
    """Points (key, line) with ``following``: the span that starts first within ``tolerance`` lines from the point on."""
    s = spans.select(*key, F.col("id").alias("__id"), F.col("start").alias("__s"), F.col("seq").alias("__q"), F.floor(F.col("start") / BIN_LINES).alias("__bin"))
    at = points.select(*key, "line").distinct().select(*key, "line", _bins(F.col("line"), F.col("line") + tolerance))
    hit = at.join(s, [*key, "__bin"]).where(F.col("__s").between(F.col("line"), F.col("line") + tolerance))
    best = hit.groupBy(*key, "line").agg(F.min_by("__id", F.struct("__s", "__q")).alias("following"))
    return points.join(best, [*key, "line"], "left")


def resolve_handlers(points: DataFrame, spans: DataFrame, key: list[str], forward: bool = True) -> DataFrame:
    """Points (key, line, hint) with ``handler``: by name, else the enclosing span, else the following one."""
    named = spans.groupBy(*key, F.col("name").alias("hint")).agg(F.min_by("id", "seq").alias("by_name"))
    out = enclosing(points, spans, key).join(named, [*key, "hint"], "left")
    out = following(out, spans, key) if forward else out.withColumn("following", F.lit(None).cast("string"))
    return out.withColumn("handler", F.coalesce("by_name", "enclosing", "following")).drop("by_name", "enclosing", "following")


def resolve_calls(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """Calls (file, container, callee) with ``target``: the definition in the same container, else the first of that name.

    ``resolved`` is local, or unresolved where the target is null.
    """
    d = defs.select("file", F.col("name").alias("callee"), F.col("container").alias("__c"), "id", "seq")
    hit = calls.join(d, ["file", "callee"], "left")
    pick = F.min_by("id", F.when(F.col("id").isNotNull(), F.struct((~F.col("__c").eqNullSafe(F.col("container"))).cast("int"), F.col("seq"))))
    return hit.groupBy("file", "container", "callee").agg(pick.alias("target")).withColumn("resolved", F.when(F.col("target").isNull(), "unresolved").otherwise("local"))


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: the value of the longest prefix (prefix, value) of a text that ends at a boundary, in any case.

    A boundary is the end of the text, a slash, question mark, hash or colon. A prefix is cut into host-like head and
    rest so that the join has an equality; ties go to the smaller prefix.
    """
    plain = lambda c: ascii_lower(trimmed(c))
    head = lambda c: F.regexp_extract(c, r"^((?:[a-z][a-z0-9+.-]*://)?[^/?#:]*)", 1)
    p = prefixes.select(plain(F.col("prefix")).alias("__p"), F.col("prefix").alias("__own"), F.col("value").alias("__v")).where("__p <> ''").withColumn("__h", head(F.col("__p")))
    keyed = rows.select(text).distinct().withColumn("__t", plain(F.col(text))).withColumn("__h", head(F.col("__t")))
    rest = F.substring(F.col("__t"), F.length("__p") + 1, F.lit(1))
    ok = F.startswith(F.col("__t"), F.col("__p")) & rest.isin("", "/", "?", "#", ":")
    best = keyed.join(p, "__h").where(ok).groupBy(text).agg(F.min_by("__v", F.struct(-F.length("__p"), F.col("__own"))).alias(out))
    return rows.join(best, text, "left")


def match_routes(left: DataFrame, right: DataFrame, key: list[str], generic: bool = False) -> DataFrame:
    """The pairs (key, l, r) of distinct routes (key, route) that match segment by segment.

    A route's mask tells where it has wildcards. For each pair of masks that meet under a key and a number of segments,
    both sides are keyed by the segments that neither mask covers: an equi join whose rows all match, so no pair is looked
    at in vain whatever segment is frequent. ``generic`` lets generic routes take part.
    """
    def masked(df: DataFrame, r: str) -> DataFrame:
        df = df if generic else df.where(~is_generic_route(F.col("route")))
        segs = F.filter(F.split("route", "/", -1), lambda s: s != "")
        df = df.select(*key, F.col("route").alias(r), segs.alias(f"{r}_s")).distinct()
        return df.withColumn("__n", F.size(f"{r}_s")).withColumn(f"{r}_m", F.array_join(F.transform(f"{r}_s", lambda s: F.when(s == "*", "1").otherwise("0")), ""))

    a, b = masked(left, "l"), masked(right, "r")
    ma, mb = a.select(*key, "__n", "l_m").distinct(), b.select(*key, "__n", "r_m").distinct()

    def keyed(df: DataFrame, masks: DataFrame, r: str) -> DataFrame:
        open_ = lambda s, i: F.when((F.substring(F.col("l_m"), i + 1, F.lit(1)) == "1") | (F.substring(F.col("r_m"), i + 1, F.lit(1)) == "1"), "*").otherwise(s)
        return df.join(masks, [*key, "__n"]).select(*key, "__n", "l_m", "r_m", r, F.array_join(F.transform(f"{r}_s", open_), "/").alias("__k"))

    both = keyed(a, mb, "l").join(keyed(b, ma, "r"), [*key, "__n", "l_m", "r_m", "__k"])
    return both.select(*key, "l", "r")


def route_matches(consumes: DataFrame, provides: DataFrame) -> DataFrame:
    """cid, pid of consumed and provided routes of one mechanism that match; generic and empty routes never do."""
    pairs = match_routes(consumes.select("mechanism", "route"), provides.select("mechanism", "route"), ["mechanism"])
    c, p = consumes.select("cid", "mechanism", F.col("route").alias("l")), provides.select("pid", "mechanism", F.col("route").alias("r"))
    return pairs.join(c, ["mechanism", "l"]).join(p, ["mechanism", "r"]).select("cid", "pid").distinct()


def rpc_matches(consumes: DataFrame, provides: DataFrame) -> DataFrame:
    """cid, pid of gRPC contracts: one method; services empty, equal, or one a suffix of the other at a dot.

    Each case is an equi join: a service is looked up among all suffixes of the other one.
    """
    c = consumes.where("method <> ''").select("cid", "method", F.coalesce("service", F.lit("")).alias("cs"))
    p = provides.where("method <> ''").select("pid", "method", F.coalesce("service", F.lit("")).alias("ps"))

    def endings(name: str) -> Column:
        parts = F.split(name, "[.]", -1)
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))

    of_p = p.where("ps <> ''").select("pid", "method", endings("ps").alias("cs"))
    of_c = c.where("cs <> ''").select("cid", "method", "cs", endings("cs").alias("ps")).where("ps <> cs and ps <> ''").drop("cs")
    hits = c.where("cs <> ''").join(of_p, ["method", "cs"]).select("cid", "pid").union(of_c.join(p.where("ps <> ''"), ["method", "ps"]).select("cid", "pid"))
    hits = hits.union(c.where("cs = ''").join(p, "method").select("cid", "pid")).union(c.where("cs <> ''").join(p.where("ps = ''"), "method").select("cid", "pid"))
    return hits.distinct()


def jsonrpc_matches(consumes: DataFrame, provides: DataFrame) -> DataFrame:
    """cid, pid of JSON-RPC contracts: one method, and where both name a route the same one; generic routes never match."""
    ok = lambda df, i, r: df.where("method <> ''").select(i, "method", F.coalesce("route", F.lit("")).alias(r)).where((F.col(r) == "") | ~is_generic_route(F.col(r)))
    c, p = ok(consumes, "cid", "cr"), ok(provides, "pid", "pr")
    same = c.where("cr <> ''").join(p.where("pr <> ''").withColumnRenamed("pr", "cr"), ["method", "cr"]).select("cid", "pid")
    return same.union(c.where("cr = ''").join(p, "method").select("cid", "pid")).union(c.where("cr <> ''").join(p.where("pr = ''"), "method").select("cid", "pid")).distinct()


def lookup_ci(rows: DataFrame, key: str, table: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: value of the exact key, else of the first key in order that differs in case only."""
    exact = table.groupBy(F.col("key").alias(key)).agg(F.min("value").alias("__e"))
    loose = table.groupBy(ascii_lower(F.col("key")).alias("__k")).agg(F.min_by("value", "key").alias("__l"))
    got = rows.join(exact, key, "left").withColumn("__k", ascii_lower(F.col(key))).join(loose, "__k", "left")
    return got.withColumn(out, F.coalesce("__e", "__l")).drop("__e", "__l", "__k")
