"""The link pass: contracts of many repositories become edges between them, topic hubs and resources.

Contracts carry repo_id and branch, which name an input. Order of arrival is the order of (repo_id, branch, seq). A link
edge has kind, src, dst, properties (map), evidence (array of kind and detail) and branch_pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import ascii_lower, resource_id, topic_id, trimmed
from graphloom.functions.text import (
    RESOURCE_TYPES, broker_mechanism, has_template, infer_channel_type, is_generic_route, normalize_identity, normalize_route, resource_edge_kind,
)
from graphloom.operators.joins import jsonrpc_matches, longest_prefix, lookup_ci, match_routes, route_matches, rpc_matches

ROUTE_MECHANISMS = ("rest", "websocket", "sse")
RANKS = ("low", "medium", "high")
#: Verbs that may stand before a route in evidence.
HTTP_METHODS = ("get", "put", "post", "delete", "patch", "head", "options", "trace")
PROPS, EVIDENCE = "map<string,string>", "array<struct<kind:string,detail:string>>"


@dataclass
class LinkSet:
    """edges (kind, src, dst, properties, evidence, branch_pairs), topics and resources (id, .., commits)."""

    edges: DataFrame
    topics: DataFrame
    resources: DataFrame

    def ordered(self) -> LinkSet:
        return LinkSet(self.edges.orderBy("kind", "src", "dst"), self.topics.orderBy("id"), self.resources.orderBy("id"))


def rank_of(confidence: Column) -> Column:
    """1 to 3; an unknown confidence counts as medium."""
    r = F.array_position(F.array(*map(F.lit, RANKS)), confidence)
    return F.when(F.coalesce(r, F.lit(0)) == 0, 2).otherwise(r)


def label(repo: str, branch: str) -> Column:
    return F.concat_ws("@", repo, branch)


def _filled(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is known and not empty."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def _seen(kind: str | Column, detail: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), detail.alias("detail"))


def service_matches(consumes: DataFrame, provides: DataFrame, cross_repo_only: bool = False) -> DataFrame:
    """cid, pid over all mechanisms; contracts of one input (repo and branch) never match each other."""
    r = lambda df: df.where(F.col("mechanism").isin(*ROUTE_MECHANISMS))
    g = lambda df, m: df.where(F.col("mechanism") == m)
    hits = route_matches(r(consumes), r(provides)).union(rpc_matches(g(consumes, "grpc"), g(provides, "grpc"))).union(jsonrpc_matches(g(consumes, "json_rpc"), g(provides, "json_rpc")))
    c = consumes.select("cid", F.col("repo_id").alias("c_repo"), F.col("branch").alias("c_branch"))
    p = provides.select("pid", F.col("repo_id").alias("p_repo"), F.col("branch").alias("p_branch"))
    other = F.col("c_repo") != F.col("p_repo")
    return hits.join(c, "cid").join(p, "pid").where(other if cross_repo_only else other | (F.col("c_branch") != F.col("p_branch")))


def base_url_constraints(consumes: DataFrame, base_urls: DataFrame) -> DataFrame:
    """cid, seq, kind, detail, repos from the longest configured base URL (prefix, value) of a target hint."""
    got = longest_prefix(consumes.select("cid", "target_hint").where("target_hint is not null"), "target_hint", base_urls, "repo")
    return got.where("repo is not null").select("cid", F.lit(-1).cast("long").alias("seq"), F.lit("target_hint").alias("kind"), trimmed(F.col("target_hint")).alias("detail"), F.array("repo").alias("repos"))


def evidence_route(value: Column) -> Column:
    """The route that evidence names: without a verb before it and without scheme and host; empty if none is left."""
    v = trimmed(value)
    v = F.when(ascii_lower(F.substring_index(v, " ", 1)).isin(*HTTP_METHODS) & v.contains(" "), trimmed(F.regexp_extract(v, r"(?s)^[^ ]* (.*)$", 1))).otherwise(v)
    return F.when(v.contains("://"), F.regexp_extract(v, r"(?s)://[^/]*(/.*)$", 1)).otherwise(v)


def evidence_constraints(consumes: DataFrame, evidence: DataFrame) -> DataFrame:
    """cid, seq, kind, detail, repos from API descriptions and configuration of the same input whose route matches."""
    e = evidence.where(F.upper("kind").isin("OPENAPI", "CONFIG") & (trimmed(F.coalesce("target_repo", F.lit(""))) != ""))
    e = e.select("repo_id", "branch", "seq", F.lower("kind").alias("kind"), F.col("value").alias("detail"), trimmed(F.col("target_repo")).alias("repo"), evidence_route(F.col("value")).alias("path"))
    e = e.where("path <> ''").withColumn("route", normalize_route(F.col("path")))
    c = consumes.where(trimmed(F.coalesce("route", F.lit(""))) != "").select("cid", "repo_id", "branch", "route")
    pairs = match_routes(c, e, ["repo_id", "branch"], generic=True)
    hit = pairs.join(c.withColumnRenamed("route", "l"), ["repo_id", "branch", "l"]).join(e.withColumnRenamed("route", "r"), ["repo_id", "branch", "r"])
    return hit.select("cid", F.col("seq").cast("long").alias("seq"), "kind", "detail", F.array("repo").alias("repos"))


def restrict(matches: DataFrame, constraints: DataFrame) -> DataFrame:
    """Matches with ``restricted`` and ``reasons``; constraints (cid, seq, repos ..) are intersected, an empty intersection means the first."""
    if "kind" not in constraints.columns:
        constraints = constraints.withColumn("kind", F.lit("")).withColumn("detail", F.lit(""))
    both = constraints.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("seq", "repos", "kind", "detail"))).alias("l"))
    meet = F.aggregate(F.col("l"), F.get("l", 0)["repos"], lambda a, x: F.array_intersect(a, x["repos"]))
    reasons = F.array_distinct(F.transform("l", lambda x: _seen(x["kind"], x["detail"])))
    both = both.select("cid", F.when(F.size(meet) == 0, F.get("l", 0)["repos"]).otherwise(meet).alias("allowed"), reasons.alias("reasons"))
    out = matches.join(both, "cid", "left").withColumn("restricted", F.col("allowed").isNotNull())
    return out.where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("p_repo"))).drop("allowed")


def confidence(matches: DataFrame) -> DataFrame:
    """Matches with a confidence: low for several provider repositories, high for a restricted one, else medium.

    A column ``ceiling`` caps it, as a gRPC match can't be better than its services tell.
    """
    n = matches.groupBy("cid").agg(F.array_sort(F.collect_set("p_repo")).alias("p_repos"))
    base = F.when(F.size("p_repos") > 1, "low").when(F.col("restricted"), "high").otherwise("medium")
    if "ceiling" in matches.columns:
        base = F.when(rank_of(base) > rank_of(F.col("ceiling")), F.col("ceiling")).otherwise(base)
    return matches.join(n, "cid").withColumn("confidence", base)


def rpc_ceiling(mechanism: Column, consumed: Column, provided: Column) -> Column:
    """The best confidence that a match can have: gRPC without a service low, with both medium."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(mechanism == "grpc", F.when(blank(consumed) | blank(provided), "low").otherwise("medium")).otherwise("high")


def baseline_evidence(c: str = "") -> Column:
    """What a match rests on: the call of a gRPC contract, else the route."""
    call = F.when(F.coalesce(f"{c}service", F.lit("")) == "", F.col(f"{c}method")).otherwise(F.concat_ws("/", f"{c}service", f"{c}method"))
    rpc = F.col(f"{c}mechanism") == "grpc"
    return _seen(F.when(rpc, "rpc").otherwise("route"), F.when(rpc, call).otherwise(normalize_route(F.coalesce(f"{c}route", F.lit("")))))


def link_properties(c: str, p: str) -> Column:
    """Properties of a matched edge by mechanism: verb (the consumer's, else the provider's), route, method, service."""
    m = F.col(f"{c}mechanism")
    either = lambda f: F.coalesce(F.nullif(trimmed(F.col(f"{c}{f}")), F.lit("")), trimmed(F.col(f"{p}{f}")))
    route = normalize_route(F.coalesce(f"{c}route", F.lit("")))
    return _filled(
        ("mechanism", m), ("confidence", F.col("confidence")), ("http_method", F.when(m == "rest", F.upper(either("http_method")))), ("route", F.when(m != "grpc", route)),
        ("method", F.when(m.isin("grpc", "json_rpc"), F.col(f"{c}method"))), ("service", F.when(m == "grpc", either("service"))),
    )


def api_identity_of(hint: Column, route: Column) -> Column:
    """What an unmatched consume calls: the hint's host, else a route that is not generic; null if neither is there."""
    low = ascii_lower(trimmed(F.coalesce(hint, F.lit(""))))
    host = F.when(low.rlike("^https?://"), F.regexp_extract(low, r"^https?://([^/?#]*)", 1)).otherwise(trimmed(F.regexp_extract(low, r"^([^/?#]*)", 1)))
    bare = F.coalesce(route, F.lit(""))
    return F.coalesce(F.nullif(host, F.lit("")), F.when((trimmed(bare) != "") & ~is_generic_route(normalize_route(bare)), normalize_route(bare)))


def external_api_id(hint: Column, route: Column) -> Column:
    return resource_id(F.lit("api"), api_identity_of(hint, route))


def _arrival(repo: str, branch: str, first: Column, repo2: Column | None = None, branch2: Column | None = None, second: Column | None = None) -> Column:
    none, zero = F.lit(""), F.lit(0).cast("long")
    return F.struct(F.col(repo).alias("r"), F.col(branch).alias("b"), first.cast("long").alias("i"), (none if repo2 is None else repo2).alias("r2"), (none if branch2 is None else branch2).alias("b2"), (zero if second is None else second.cast("long")).alias("j"))


def merge_links(links: DataFrame) -> DataFrame:
    """One row a (kind, src, dst) from links (properties, evidence, branch_pair, arrival): sorted union of the branch pairs,

    union of the evidence in order of arrival, properties of the highest confidence (of equal ones the first).
    """
    key = ["kind", "src", "dst"]
    rank = -rank_of(F.col("properties")["confidence"])
    best = links.groupBy(*key).agg(F.min_by("properties", F.struct(rank, "arrival")).alias("properties"), F.array_sort(F.collect_set("branch_pair")).alias("branch_pairs"))
    e = links.select(*key, "arrival", F.posexplode("evidence").alias("at", "e")).groupBy(*key, "e").agg(F.min(F.struct("arrival", "at")).alias("first"))
    e = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "e"))).alias("l")).select(*key, F.transform("l", lambda x: x["e"]).alias("evidence"))
    return best.join(e, key, "left").select(*key, "properties", F.coalesce("evidence", F.array().cast(EVIDENCE)).alias("evidence"), "branch_pairs")


def matched_services(consumes: DataFrame, provides: DataFrame, base_urls: DataFrame, evidence: DataFrame | None = None, cross_repo_only: bool = False) -> DataFrame:
    """All matches that restrictions leave, with reasons, confidence and the provider repositories of each consume."""
    limits = base_url_constraints(consumes, base_urls)
    if evidence is not None:
        limits = limits.union(evidence_constraints(consumes, evidence))
    m = restrict(service_matches(consumes, provides, cross_repo_only), limits)
    of_c = consumes.select("cid", "mechanism", F.col("service").alias("cs"))
    m = m.join(of_c, "cid").join(provides.select("pid", F.col("service").alias("ps")), "pid")
    return confidence(m.withColumn("ceiling", rpc_ceiling(F.col("mechanism"), F.col("cs"), F.col("ps")))).drop("mechanism", "cs", "ps", "ceiling")


_CONTRACT = ("mechanism", "http_method", "route", "service", "method")


def _given(df: DataFrame, prefix: str, *names: str) -> list[Column]:
    return [(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(f"{prefix}{n}") for n in names]


def service_links(consumes: DataFrame, provides: DataFrame, base_urls: DataFrame, evidence: DataFrame | None = None, cross_repo_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(CALLS_API links before merging, resources of unmatched routes: id, resource_type, identity, mechanism, arrival, repo_id, branch)."""
    m = matched_services(consumes, provides, base_urls, evidence, cross_repo_only)
    c = consumes.select("cid", F.col("caller_id"), *_given(consumes, "c_", *_CONTRACT))
    p = provides.select("pid", F.col("handler_id"), *_given(provides, "p_", *_CONTRACT))
    rows = m.join(c, "cid").join(p, "pid").where("coalesce(caller_id, '') <> '' and coalesce(handler_id, '') <> ''")
    more = F.when(F.size("p_repos") > 1, F.array(_seen("candidates", F.array_join("p_repos", ",")))).otherwise(F.array().cast(EVIDENCE))
    proof = F.array_distinct(F.concat(F.array(baseline_evidence("c_")), F.coalesce("reasons", F.array().cast(EVIDENCE)), more))
    pair = F.concat(label("c_repo", "c_branch"), F.lit(" -> "), label("p_repo", "p_branch"))
    hit = rows.select(
        F.lit("CALLS_API").alias("kind"), F.col("caller_id").alias("src"), F.col("handler_id").alias("dst"), link_properties("c_", "p_").alias("properties"), proof.alias("evidence"),
        pair.alias("branch_pair"), _arrival("c_repo", "c_branch", F.col("cid"), F.col("p_repo"), F.col("p_branch"), F.col("pid")).alias("arrival"),
    )
    lone = consumes.where(F.col("mechanism").isin(*ROUTE_MECHANISMS) & (F.coalesce("caller_id", F.lit("")) != "")).join(m.select("cid"), "cid", "left_anti")
    lone = lone.withColumn("identity", api_identity_of(F.col("target_hint"), F.col("route"))).where("identity is not null").withColumn("arrival", _arrival("repo_id", "branch", F.col("cid")))
    route = F.when(trimmed(F.coalesce("route", F.lit(""))) != "", normalize_route(F.col("route")))
    rest = lone.select(
        F.lit("CALLS_API").alias("kind"), F.col("caller_id").alias("src"), resource_id(F.lit("api"), F.col("identity")).alias("dst"),
        _filled(("mechanism", F.col("mechanism")), ("confidence", F.lit("low")), ("resource_type", F.lit("api")), ("route", route)).alias("properties"),
        F.array(_seen("unmatched", F.col("identity"))).alias("evidence"), label("repo_id", "branch").alias("branch_pair"), "arrival",
    )
    found = lone.select(resource_id(F.lit("api"), F.col("identity")).alias("id"), F.lit("api").alias("resource_type"), "identity", "mechanism", "arrival", "repo_id", "branch")
    return hit.union(rest), found


def call_edges(consumes: DataFrame, provides: DataFrame, base_urls: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """CALLS_API edges, merged: to handlers, and for unmatched routes to a Resource(api)."""
    return merge_links(service_links(consumes, provides, base_urls, evidence)[0])


def with_commits(rows: DataFrame, heads: DataFrame | None) -> DataFrame:
    """Rows (repo_id, branch) with the commit of their head; without heads or one for the input it is null."""
    if heads is None:
        return rows.withColumn("commit_id", F.lit(None).cast("string"))
    return rows.join(heads.select("repo_id", "branch", "commit_id"), ["repo_id", "branch"], "left")


def channel_links(channels: DataFrame, brokers: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(topics: id, broker, channel, channel_type, publishers, subscribers, commits) and (links before merging).

    A configured broker (key, value) of a channel, in any case, stands before the contract's own one and makes the link
    high. Attributes of a topic come from its first contract.
    """
    if "seq" not in channels.columns:
        channels = channels.withColumn("seq", F.lit(0))
    for c in ("repo_id", "branch", "channel_type"):
        if c not in channels.columns:
            channels = channels.withColumn(c, F.lit(""))
    c = channels.withColumn("channel", trimmed(F.col("channel"))).where("channel <> ''").where(~has_template(F.col("channel")))
    c = lookup_ci(c, "channel", brokers, "configured").withColumn("broker", ascii_lower(trimmed(F.coalesce("configured", "broker", F.lit("")))))
    c = c.withColumn("channel_type", F.coalesce(F.nullif(trimmed(F.col("channel_type")), F.lit("")), infer_channel_type(F.col("broker"))))
    c = with_commits(c.withColumn("id", topic_id(F.col("broker"), F.col("channel"))), heads).withColumn("arrival", _arrival("repo_id", "branch", F.col("seq")))
    one = lambda d: F.count_if(F.col("direction") == d)
    first = lambda x: F.min_by(x, "arrival").alias(x)
    topics = c.groupBy("id").agg(first("broker"), first("channel"), first("channel_type"), one("publish").alias("publishers"), one("subscribe").alias("subscribers"), F.array_sort(F.collect_set("commit_id")).alias("commits"))
    kind = F.when(F.col("direction") == "publish", "PUBLISH_TO").otherwise("CONSUME_FROM")
    sure = F.when(F.col("configured").isNotNull(), "high").otherwise("medium")
    props = _filled(("mechanism", broker_mechanism(F.col("broker"))), ("confidence", sure), ("broker", F.col("broker")), ("channel", F.col("channel")), ("channel_type", F.col("channel_type")))
    links = c.where("coalesce(node_id, '') <> ''").select(
        kind.alias("kind"), F.col("node_id").alias("src"), F.col("id").alias("dst"), props.alias("properties"), F.array(_seen("channel", F.col("channel"))).alias("evidence"),
        label("repo_id", "branch").alias("branch_pair"), "arrival",
    )
    return topics, links


def topic_hubs(channels: DataFrame, brokers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics) and (edges PUBLISH_TO, CONSUME_FROM: kind, src, dst)."""
    topics, links = channel_links(channels, brokers)
    return topics, links.select("kind", "src", "dst").distinct()


def resolve_resources(resources: DataFrame, registry: DataFrame, evidence: DataFrame) -> DataFrame:
    """References with resource_type, identity, confidence and evidence; those that resolve to nothing are left out.

    A registry entry (key, value) of the target, in any case, comes first; its value may begin with another class and a
    colon. Then targets with templates are dropped. ``env:NAME`` takes the first evidence (repo_id, branch, file, value,
    detail, seq) of its own input whose key is the name; a value that can't be normalised leaves the reference unresolved;
    without evidence it stands for itself, low. Anything else is normalised: high if it is a URL or ARN, else medium.
    """
    r = resources.withColumn("resource_type", ascii_lower(trimmed(F.col("resource_type")))).withColumn("raw_target", trimmed(F.col("raw_target"))).where("resource_type <> '' and raw_target <> ''")
    r = lookup_ci(r, "raw_target", registry, "__reg").withColumn("__reg", F.nullif(trimmed(F.col("__reg")), F.lit("")))
    head, tail = ascii_lower(trimmed(F.substring_index("__reg", ":", 1))), trimmed(F.regexp_extract("__reg", r"(?s)^[^:]*:(.*)$", 1))
    typed = head.isin(*RESOURCE_TYPES) & (tail != "") & F.col("__reg").contains(":")
    kind = F.when(F.col("__reg").isNotNull() & typed, head).otherwise(F.col("resource_type"))
    value = F.when(typed, tail).otherwise(F.col("__reg"))
    var = F.when(F.col("raw_target").rlike("^(?:env|ENV):"), trimmed(F.regexp_extract("raw_target", r"(?s)^...:(.*)$", 1)))
    r = r.withColumn("__kind", kind).withColumn("__value", value).withColumn("__var", var).withColumn("__up", F.upper("__var"))
    key = F.upper(trimmed(F.regexp_extract(trimmed(F.coalesce("detail", F.lit(""))), r"^([^=:]*)", 1)))
    usable = evidence.where((trimmed(F.col("value")) != "") & ~F.col("value").rlike(r"\$\{|\$\("))
    first = usable.groupBy("repo_id", "branch", key.alias("__up")).agg(F.min_by(F.struct(trimmed(F.col("value")).alias("v"), F.col("file").alias("f")), "seq").alias("__e"))
    r = r.join(first, ["repo_id", "branch", "__up"], "left")
    by_registry, by_env, alias = F.col("__reg").isNotNull(), F.col("__var").isNotNull() & F.col("__e").isNotNull(), F.col("__var").isNotNull()
    normal = lambda k, v: normalize_identity(k, v)
    identity = (
        F.when(by_registry, F.coalesce(normal(F.col("__kind"), F.col("__value")), F.col("__value"))).when(has_template(F.col("raw_target")) | (F.col("__var") == ""), F.lit(None))
        .when(by_env, normal(F.col("resource_type"), F.col("__e.v"))).when(alias, F.concat(F.lit("env:"), F.col("__var"))).otherwise(normal(F.col("resource_type"), F.col("raw_target")))
    )
    literal = F.lower("raw_target").rlike("://|^arn:|^jdbc:")
    sure = F.when(by_registry, "high").when(by_env, "medium").when(alias, "low").when(literal, "high").otherwise("medium")
    proof = (
        F.when(by_registry, F.array(_seen("registry", F.col("raw_target")))).when(by_env, F.array(_seen("env", F.col("__var")), _seen("evidence", F.col("__e.f"))))
        .when(alias, F.array(_seen("env", F.col("__var")))).otherwise(F.array(_seen("resource", F.col("identity"))))
    )
    out = r.withColumn("identity", identity).where("identity is not null").withColumn("confidence", sure).withColumn("evidence", proof).withColumn("resource_type", F.col("__kind"))
    return out.drop("__reg", "__kind", "__value", "__var", "__up", "__e")


def resource_refs(resources: DataFrame, registry: DataFrame, evidence: DataFrame, heads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved references with id and arrival) and (links before merging)."""
    if "seq" not in resources.columns:
        resources = resources.withColumn("seq", F.lit(0))
    r = resolve_resources(resources, registry, evidence).withColumn("id", resource_id(F.col("resource_type"), F.col("identity"))).withColumn("arrival", _arrival("repo_id", "branch", F.col("seq")))
    kind = resource_edge_kind(F.col("access"))
    props = _filled(("mechanism", F.col("mechanism")), ("confidence", F.col("confidence")), ("resource_type", F.col("resource_type")), ("access", F.col("access")))
    links = r.where("coalesce(node_id, '') <> ''").where(kind.isNotNull()).select(
        kind.alias("kind"), F.col("node_id").alias("src"), F.col("id").alias("dst"), props.alias("properties"), "evidence", label("repo_id", "branch").alias("branch_pair"), "arrival"
    )
    return r.select("id", "resource_type", "identity", "mechanism", "arrival", "repo_id", "branch"), links


def resource_states(found: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One row a resource: attributes of its first reference, the first mechanism that is named, all commits, sorted."""
    f = with_commits(found, heads)
    first = lambda x: F.min_by(x, "arrival").alias(x)
    named = F.min_by("mechanism", F.when(F.coalesce("mechanism", F.lit("")) != "", F.col("arrival")))
    return f.groupBy("id").agg(first("resource_type"), first("identity"), F.coalesce(named, F.lit("")).alias("mechanism"), F.array_sort(F.collect_set("commit_id")).alias("commits"))


def resource_links(resources: DataFrame, registry: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resources) and (edges: kind, src, dst)."""
    found, links = resource_refs(resources, registry, evidence)
    return resource_states(found), links.select("kind", "src", "dst").distinct()


def compute_links(heads: DataFrame, provides: DataFrame, consumes: DataFrame, channels: DataFrame, resources: DataFrame, evidence: DataFrame, base_urls: DataFrame, brokers: DataFrame, registry: DataFrame, cross_repo_only: bool = False) -> LinkSet:
    """The link set of all indexed heads (repo_id, branch, commit_id) from their contracts and the configured links."""
    calls, apis = service_links(consumes, provides, base_urls, evidence, cross_repo_only)
    topics, tied = channel_links(channels, brokers, heads)
    found, used = resource_refs(resources, registry, evidence, heads)
    edges = merge_links(calls.unionByName(tied).unionByName(used))
    # Unmatched calls come before all references, as their pass runs first.
    first = lambda df, n: df.withColumn("arrival", F.struct(F.lit(n).alias("pass"), "arrival"))
    return LinkSet(edges, topics, resource_states(first(apis, 0).unionByName(first(found, 1)), heads))


def content_hash_of(properties: Column, evidence: Column) -> Column:
    """Hash of a link's properties and evidence; branch pairs don't count."""
    return F.sha2(F.concat(F.to_json(F.array_sort(F.map_entries(properties))), F.to_json(evidence)), 256)


def graph_edges(edges: DataFrame) -> DataFrame:
    """Link edges as edges of the graph: with a content hash, all else in the properties."""
    props = F.map_concat(F.col("properties"), F.create_map(F.lit("evidence"), F.to_json("evidence"), F.lit("branch_pairs"), F.to_json("branch_pairs")))
    return edges.select("kind", "src", "dst", content_hash_of(F.col("properties"), F.col("evidence")).alias("content_hash"), props.alias("properties"), "branch_pairs")


def topic_nodes(topics: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("broker", F.lit("")) == "", F.col("channel")).otherwise(F.concat_ws("/", "broker", "channel"))
    return topics.select("id", F.lit("TOPIC").alias("kind"), F.col("channel").alias("name"), name.alias("qualified_name"), _filled(*[(c, F.col(c)) for c in ("channel", "broker", "channel_type")]).alias("properties"))


def resource_nodes(resources: DataFrame) -> DataFrame:
    name = F.concat_ws(":", "resource_type", "identity")
    return resources.select("id", F.lit("RESOURCE").alias("kind"), F.col("identity").alias("name"), name.alias("qualified_name"), _filled(*[(c, F.col(c)) for c in ("resource_type", "mechanism")]).alias("properties"))


def contains_pairs(links: LinkSet) -> DataFrame:
    """commit, id of every topic and resource that a commit holds."""
    one = lambda df: df.select(F.explode("commits").alias("commit"), "id")
    return one(links.topics).union(one(links.resources)).distinct()


def link_states(links: LinkSet) -> DataFrame:
    """entity, key, state of all that a link set puts into the graph; a change of the state is an update."""
    row = lambda df, entity, key, state: df.select(F.lit(entity).alias("entity"), key.alias("key"), state.alias("state"))
    text = lambda *c: F.concat_ws("\x1f", *c)
    edge = F.concat(content_hash_of(F.col("properties"), F.col("evidence")), F.array_join("branch_pairs", "\x1f"))
    return (
        row(links.topics, "TOPIC", F.col("id"), text("broker", "channel_type", "channel"))
        .union(row(links.resources, "RESOURCE", F.col("id"), text("resource_type", "identity", "mechanism")))
        .union(row(links.edges, "EDGE", text("kind", "src", "dst"), edge))
        .union(row(contains_pairs(links), "CONTAINS", text("commit", "id"), F.lit("")))
    )


def diff_link_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """phase, op, entity, key of the changes between two link sets (entity TOPIC, RESOURCE, EDGE or CONTAINS; key; state).

    Creations come before edges, deletions after them: topics 0 and 1, resources 2 and 3, edges 4 and 5, containment 6
    and 7, deleted topics 8, deleted resources 9.
    """
    both = old.select("entity", "key", F.col("state").alias("o"), F.lit(1).alias("a")).join(new.select("entity", "key", F.col("state").alias("n"), F.lit(1).alias("b")), ["entity", "key"], "full_outer")
    op = F.when(F.col("a").isNull(), "CREATE").when(F.col("b").isNull(), "DELETE").when(~F.col("o").eqNullSafe(F.col("n")), "UPDATE")
    e = F.col("entity")
    phase = (
        F.when((e == "TOPIC") & (op == "CREATE"), 0).when((e == "TOPIC") & (op == "UPDATE"), 1).when((e == "RESOURCE") & (op == "CREATE"), 2).when((e == "RESOURCE") & (op == "UPDATE"), 3)
        .when((e == "EDGE") & (op != "DELETE"), 4).when(e == "EDGE", 5).when((e == "CONTAINS") & (op != "DELETE"), 6).when(e == "CONTAINS", 7).when(e == "TOPIC", 8).otherwise(9)
    )
    return both.where(op.isNotNull()).select(phase.alias("phase"), op.alias("op"), "entity", "key")


def link_delta(old: LinkSet, new: LinkSet) -> DataFrame:
    return diff_link_sets(link_states(old), link_states(new))
