"""One query for each operator family over the bridged graph, each with SQL that DuckDB can run."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import ids, text
from graphloom.model import DEPENDENCY_KINDS
from graphloom.operators import analytics, deploy, joins, links, snapshot, traverse
from graphloom.operators.api import Budget, GraphApi
from graphloom.plans import bridge
from graphloom.plans.storage import stored

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = bridge.oracle(sql)
        return f

    return add


RANK = """CASE kind WHEN 'DEPENDS_ON' THEN 1 WHEN 'IMPORTS' THEN 2 WHEN 'CALLS_API' THEN 3 WHEN 'PUBLISH_TO' THEN 4 WHEN 'CONSUME_FROM' THEN 5 WHEN 'READS_FROM' THEN 6
  WHEN 'WRITES_TO' THEN 7 WHEN 'INVOKES' THEN 8 WHEN 'CONNECTS_TO' THEN 9 WHEN 'QUERIES' THEN 10 END"""
ROOT = "(SELECT id FROM parts WHERE p_partkey = 1)"


def _root(spark, sf):
    return bridge.view(spark, sf, "parts").where("p_partkey = 1").select("id")


def _root_id(spark, sf) -> str:
    return _root(spark, sf).first()[0]


def _walk_sql(near: str, far: str, rel: str, depth: int) -> str:
    return f"""RECURSIVE WITH r(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1
      UNION SELECT e.{far}, r.depth + 1 FROM r JOIN {rel} e ON e.{near} = r.id WHERE r.depth < {depth})
    SELECT id, min(depth) AS depth FROM r GROUP BY id"""


@query(f"""RECURSIVE WITH r(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1
  UNION SELECT e.src, r.depth + 1 FROM r JOIN dep e ON e.dst = r.id WHERE r.depth < 3)
SELECT id, min(depth) AS distance FROM r WHERE id <> {ROOT} GROUP BY id""")
def n2_blast_radius(spark, sf):
    edges = bridge.view(spark, sf, "edges")
    return analytics.blast_radius(edges, _root(spark, sf), 3).select("id", "distance")


@query(_walk_sql("dst", "src", "calls", 3))
def g5_callers(spark, sf):
    return traverse.bfs(bridge.view(spark, sf, "edges"), _root(spark, sf), 3, ("CALLS",), inbound=True)[1].select("id", "depth")


@query(_walk_sql("src", "dst", "calls", 3))
def g6_callees(spark, sf):
    return traverse.bfs(bridge.view(spark, sf, "edges"), _root(spark, sf), 3, ("CALLS",))[1].select("id", "depth")


@query("""RECURSIVE WITH both_ways AS (SELECT src AS near, dst AS far FROM edges UNION SELECT dst, src FROM edges),
  r(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1 UNION SELECT e.far, r.depth + 1 FROM r JOIN both_ways e ON e.near = r.id WHERE r.depth < 2)
SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def g2_undirected_bfs(spark, sf):
    root = bridge.view(spark, sf, "function_keys").where("id = 8")  # part 1
    _, reached = traverse.bfs(bridge.view(spark, sf, "edge_keys"), root, 2, None, both=True, with_edges=False)
    return reached.select(F.col("id").alias("k"), "depth").join(bridge.view(spark, sf, "id_keys"), "k").select("id", "depth")


@query("""RECURSIVE WITH r(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1 UNION SELECT e.src, r.depth + 1 FROM r JOIN dep e ON e.dst = r.id WHERE r.depth < 2),
  m AS (SELECT id, min(depth) AS d FROM r GROUP BY id)
SELECT e.kind, e.src, e.dst, m.d + 1 AS depth FROM dep e JOIN m ON e.dst = m.id WHERE m.d < 2""")
def g1_edges_met(spark, sf):
    return traverse.bfs(bridge.view(spark, sf, "edges"), _root(spark, sf), 2, DEPENDENCY_KINDS, inbound=True)[0].drop("root")


@query(f"""SELECT node, kind, other, rank FROM (SELECT dst AS node, kind, src AS other, row_number() OVER (PARTITION BY dst ORDER BY {RANK}, src) AS rank FROM dep) WHERE rank <= 50""")
def g12_dependents_top50(spark, sf):
    return traverse.top_neighbours(bridge.view(spark, sf, "edges"), DEPENDENCY_KINDS, True, 50)


@query(f"""SELECT node, kind, other, rank FROM (SELECT src AS node, kind, dst AS other, row_number() OVER (PARTITION BY src ORDER BY {RANK}, dst) AS rank FROM dep) WHERE rank <= 10""")
def g11_dependencies_top10(spark, sf):
    return traverse.top_neighbours(bridge.view(spark, sf, "edges"), DEPENDENCY_KINDS, False, 10)


def _api(spark, sf, **budget) -> GraphApi:
    return GraphApi(*bridge.graph(spark, sf), Budget(**budget))


@query("SELECT id, kind, name FROM nodes WHERE contains(lower(name), 'ring') ORDER BY id LIMIT 50")
def g3_find_symbol(spark, sf):
    return _api(spark, sf).find_symbol("Ring").rows.select("id", "kind", "name")


@query(f"SELECT id, kind, name, qualified_name, language FROM nodes WHERE id = {ROOT}")
def g4_get_symbol(spark, sf):
    return _api(spark, sf).get_symbol(_root_id(spark, sf)).rows.select("id", "kind", "name", "qualified_name", "language")


@query(f"SELECT kind, src, dst FROM dep WHERE dst = {ROOT} ORDER BY {RANK}, src LIMIT 20")
def g12_get_dependents(spark, sf):
    return _api(spark, sf).get_dependents(_root_id(spark, sf), 20).rows.select("kind", "src", "dst")


@query("""SELECT DISTINCT e.dst AS node_id, h.branch_id, h.branch FROM heads h JOIN edges e ON e.kind = 'CONTAINS_STATE_OF' AND e.src = h.commit_id""")
def p2_branch_members(spark, sf):
    return traverse.branch_members(*reversed(bridge.graph(spark, sf)))


_STATE = "SELECT n.* FROM heads h JOIN holds e ON e.src = h.commit_id JOIN nodes n ON n.id = e.dst WHERE h.repo = 'NATION_7' AND h.branch = '{}'"


@query(f"SELECT id, name FROM ({_STATE.format('F')}) ORDER BY id LIMIT 50")
def g14_branch_context(spark, sf):
    return _api(spark, sf).get_branch_context("NATION_7", "F").rows.select("id", "name")


@query(f"""WITH a AS (SELECT DISTINCT name FROM ({_STATE.format('F')})), b AS (SELECT DISTINCT name FROM ({_STATE.format('O')}))
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'only_a' WHEN a.name IS NULL THEN 'only_b' ELSE 'common' END AS side FROM a FULL JOIN b ON a.name = b.name""")
def g19_compare_branch_state(spark, sf):
    return _api(spark, sf).compare_branch_state("NATION_7", "F", "O").rows


@query("SELECT DISTINCT commit_sha, status, deployed_at, release FROM deployments WHERE repository = 'NATION_7' AND environment = '1-URGENT'")
def g16_deployment_state(spark, sf):
    return deploy.deployment_state(bridge.view(spark, sf, "deployments"), "NATION_7", "1-URGENT")


@query("""SELECT repository, environment, commit_sha, status, deployed_at, n AS deployments FROM (
  SELECT *, row_number() OVER (PARTITION BY repository, environment ORDER BY deployed_at DESC, commit_sha DESC, status DESC) AS i, count(*) OVER (PARTITION BY repository, environment) AS n FROM deployments) WHERE i = 1""")
def d6_current_deployments(spark, sf):
    return deploy.current_deployments(bridge.view(spark, sf, "deployments"))


@query("""SELECT DISTINCT 'DEPLOYED_TO' AS kind, sha256(repository || '::commit::' || commit_sha) AS src, sha256('deployment-environment::' || environment) AS dst, environment, repository, commit_sha, status, deployed_at, release FROM deployments""")
def d7_deployment_edges(spark, sf):
    return deploy.deployment_facts(bridge.view(spark, sf, "deployments"))[1]


@query("SELECT n.id, n.name, CAST(count(e.src) AS DOUBLE) AS score FROM nodes n LEFT JOIN dep e ON e.dst = n.id WHERE n.kind = 'RESOURCE' GROUP BY n.id, n.name")
def n6_resource_degree(spark, sf):
    return analytics.in_degree(*bridge.graph(spark, sf))


def _pagerank_sql(n: int) -> str:
    steps = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT n.id, 0.15 + coalesce(g.s, 0) AS score FROM ids n LEFT JOIN (SELECT l.dst, sum(r.score * l.w) AS s FROM lk l JOIN r{i - 1} r ON r.id = l.src GROUP BY l.dst) g ON g.dst = n.id)"
        for i in range(1, n + 1)
    )
    return f"""WITH ids AS MATERIALIZED (SELECT id, kind FROM nodes), d2 AS MATERIALIZED (SELECT * FROM dep), dg AS (SELECT src, count(*) AS deg FROM d2 GROUP BY src),
    lk AS MATERIALIZED (SELECT d2.src, d2.dst, sum(0.85::DOUBLE / deg) AS w FROM d2 JOIN dg ON dg.src = d2.src GROUP BY d2.src, d2.dst),
    r0 AS (SELECT id, 0.15::DOUBLE AS score FROM ids), {steps} SELECT r{n}.id, round(score, 6) AS score FROM r{n} JOIN ids ON ids.id = r{n}.id WHERE ids.kind = 'RESOURCE'"""


@query(_pagerank_sql(20))
def n5_pagerank(spark, sf):
    nodes, edges = bridge.graph(spark, sf)
    rank = analytics.pagerank(nodes, edges, 20)
    return rank.join(nodes.where("kind = 'RESOURCE'").select("id"), "id", "left_semi").select("id", F.round("score", 6).alias("score"))


@query("""RECURSIVE WITH e2 AS MATERIALIZED (SELECT src AS a, dst AS b FROM dep UNION SELECT dst, src FROM dep),
  cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION (SELECT e2.a, min(u.comp) FROM e2 JOIN cc u ON u.id = e2.b JOIN recurring.cc v ON v.id = e2.a WHERE u.comp < v.comp GROUP BY e2.a))
SELECT id, comp AS component, count(*) OVER (PARTITION BY comp) AS size FROM cc""")
def n8_components(spark, sf):
    return analytics.components(*bridge.graph(spark, sf))


@query()
def n7_betweenness(spark, sf):
    """Over all sources and shortest paths of any length."""
    got = analytics.betweenness(bridge.view(spark, sf, "edge_keys"), max_depth=None)
    return got.withColumnRenamed("id", "k").join(bridge.view(spark, sf, "id_keys"), "k").select("id", F.round("score", 6).alias("score"))


OLD_NEW = "(SELECT p.id, count(*) AS n FROM lineitem l JOIN parts p ON p.p_partkey = l.l_partkey {} GROUP BY p.id)"
CUTS = ("WHERE l.l_shipdate < DATE '1995-06-01' AND l.l_suppkey % 7 <> 0", "WHERE l.l_shipdate < DATE '1996-01-01' AND l.l_suppkey % 5 <> 0")


def _snapshot(spark, sf, i):
    t = bridge.tables(spark, sf)
    l = t["lineitem"].alias("l").where(CUTS[i][6:])
    return l.join(bridge.view(spark, sf, "parts"), F.col("l.l_partkey") == F.col("p_partkey")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT CASE WHEN o.id IS NULL THEN 'CREATE' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, coalesce(o.id, n.id) AS id
FROM {OLD_NEW.format(CUTS[0])} o FULL JOIN {OLD_NEW.format(CUTS[1])} n ON o.id = n.id WHERE o.n IS DISTINCT FROM n.n""")
def d1_snapshot_diff(spark, sf):
    return snapshot.diff(_snapshot(spark, sf, 0), _snapshot(spark, sf, 1), ["id"], ["n"])


# A delta made against an older base than the graph it meets: it creates nodes that are there, deletes nodes that are
# not or that a commit holds, and ties edges to nodes that are missing.
_K1 = f"""WITH o AS {OLD_NEW.format(CUTS[0])}, n AS {OLD_NEW.format(CUTS[1])},
base AS (SELECT o.id, o.n FROM o JOIN parts p ON p.id = o.id WHERE p.p_partkey % 3 <> 0), ghosts AS (SELECT id || 'x' AS id FROM parts WHERE p_partkey % 50 = 0),
nop AS (SELECT CASE WHEN b.id IS NULL THEN 'CREATE' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, coalesce(b.id, n.id) AS id FROM base b FULL JOIN n ON b.id = n.id WHERE b.n IS DISTINCT FROM n.n
  UNION ALL SELECT 'DELETE', id FROM ghosts),
olde AS (SELECT src, dst FROM imports WHERE src < dst), newe AS (SELECT src, dst FROM imports WHERE dst < src OR src LIKE 'a%'),
eop AS (SELECT CASE WHEN a.src IS NULL THEN 'CREATE' ELSE 'DELETE' END AS op, coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst FROM olde a FULL JOIN newe b ON a.src = b.src AND a.dst = b.dst WHERE a.src IS NULL OR b.src IS NULL),
there AS (SELECT id FROM o UNION SELECT id FROM n UNION SELECT src FROM holds), held AS (SELECT DISTINCT dst AS id FROM holds WHERE src LIKE '0%' OR src LIKE '8%')"""


@query(_K1 + """
SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN op = 'CREATE' AND id NOT IN (SELECT id FROM o) THEN 'created_nodes' ELSE 'updated_nodes' END AS outcome FROM nop WHERE op <> 'DELETE'
  UNION ALL SELECT CASE WHEN id IN (SELECT id FROM held) THEN 'nodes_retained' ELSE 'deleted_nodes' END FROM nop WHERE op = 'DELETE' AND id IN (SELECT id FROM there)
  UNION ALL SELECT 'errors' FROM eop WHERE op = 'CREATE' AND NOT (src IN (SELECT id FROM there) AND dst IN (SELECT id FROM there))
  UNION ALL SELECT 'created_rels' FROM eop WHERE op = 'CREATE' AND src IN (SELECT id FROM there) AND dst IN (SELECT id FROM there)
  UNION ALL SELECT 'deleted_rels' FROM eop WHERE op = 'DELETE') GROUP BY outcome""")
def k1_apply_delta(spark, sf):
    return _applied(spark, sf)[2]


def _applied(spark, sf):
    old, new = stored(_snapshot(spark, sf, 0)), stored(_snapshot(spark, sf, 1))
    parts = stored(bridge.view(spark, sf, "parts"))
    base = old.join(parts.where("p_partkey % 3 <> 0").select("id"), "id", "left_semi")
    held = stored(bridge.view(spark, sf, "edges").where("kind = 'CONTAINS_STATE_OF'"))
    ties = stored(bridge.view(spark, sf, "edges").where("kind = 'IMPORTS'"))
    before, after = ties.where("src < dst"), ties.where("dst < src or src like 'a%'")
    ops = snapshot.graph_delta(base, before, new, after, ["n"], ["kind"])
    ghosts = parts.where("p_partkey % 50 = 0").selectExpr("3 AS phase", "'DELETE' AS op", "'node' AS entity", "CAST(NULL AS STRING) AS kind", "id || 'x' AS a", "CAST(NULL AS STRING) AS b")
    commits = held.select(F.col("src").alias("id")).distinct().withColumn("n", F.lit(0).cast("long"))
    graph = stored(old.union(commits)), stored(before.union(held.where("src like '0%' or src like '8%'")))
    return snapshot.apply_delta(*graph, new, after, stored(ops.union(ghosts)))


@query(_K1 + """
SELECT 'node' AS entity, id AS a, '' AS b FROM (SELECT id FROM o UNION SELECT id FROM n UNION SELECT DISTINCT src FROM holds EXCEPT (SELECT id FROM nop WHERE op = 'DELETE' AND id NOT IN (SELECT id FROM held)))
UNION ALL SELECT 'edge', src, dst FROM (SELECT src, dst FROM olde UNION SELECT src, dst FROM eop WHERE op = 'CREATE' AND src IN (SELECT id FROM there) AND dst IN (SELECT id FROM there) EXCEPT SELECT src, dst FROM eop WHERE op = 'DELETE')
WHERE src NOT IN (SELECT id FROM nop WHERE op = 'DELETE' AND id NOT IN (SELECT id FROM held)) AND dst NOT IN (SELECT id FROM nop WHERE op = 'DELETE' AND id NOT IN (SELECT id FROM held))""")
def k2_graph_after_delta(spark, sf):
    """Nodes and edges (without containment) after the delta."""
    nodes, edges, _ = _applied(spark, sf)
    ties = edges.where("kind = 'IMPORTS'").select(F.lit("edge").alias("entity"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return nodes.select(F.lit("node").alias("entity"), F.col("id").alias("a"), F.lit("").alias("b")).union(ties)


@query("""SELECT e.kind, e.src, e.dst FROM edges e WHERE e.src IN (SELECT id FROM parts WHERE p_partkey % 3 <> 0) AND e.dst IN (SELECT id FROM parts WHERE p_partkey % 3 <> 0)""")
def p12_drop_dangling(spark, sf):
    nodes = bridge.view(spark, sf, "parts").where("p_partkey % 3 <> 0")
    return snapshot.drop_dangling(nodes, bridge.view(spark, sf, "edges"))[0].select("kind", "src", "dst")


@query("""WITH f AS (SELECT l_partkey AS id, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq,
  CASE l_returnflag WHEN 'A' THEN 'JOERN' WHEN 'N' THEN 'SCIP' ELSE 'TREE' END AS source, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS p, l_linestatus AS kind,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS content_hash FROM lineitem),
g AS (SELECT *, p > coalesce(max(p) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS above FROM f)
SELECT id, arg_max(kind, p * 1000000000 - seq) AS kind, coalesce(arg_max(content_hash, seq) FILTER (above AND content_hash IS NOT NULL), arg_min(content_hash, seq) FILTER (content_hash IS NOT NULL)) AS content_hash FROM g GROUP BY id""")
def a1_merge_facts(spark, sf):
    from pyspark.sql import Window

    l = bridge.tables(spark, sf)["lineitem"]
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    source = F.when(F.col("l_returnflag") == "A", "JOERN").when(F.col("l_returnflag") == "N", "SCIP").otherwise("TREE")
    facts = l.select(
        F.col("l_partkey").alias("id"), F.row_number().over(order).alias("seq"), source.alias("source"), F.col("l_linestatus").alias("kind"), F.lit(None).cast("string").alias("language"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit(None)).otherwise(F.col("l_suppkey").cast("string")).alias("content_hash"), F.create_map(F.lit("q"), F.col("l_quantity").cast("string")).alias("properties"),
    )
    return snapshot.merge_facts(facts, ["id"], ["kind"]).select("id", "kind", "content_hash")


# Contracts: every page consumes its raw path; it provides the path too, with its number as a placeholder on every other page.
_C = "(SELECT page_id AS cid, repo_id, branch, '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> ''), '/') AS route FROM contracts)"
_P = r"(SELECT page_id AS pid, repo_id, branch, '/' || array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN page_id % 2 = 0 AND regexp_matches(s, '[0-9]') THEN '*' ELSE s END), '/') AS route FROM contracts)"


def _contracts(spark, sf):
    c = stored(bridge.view(spark, sf, "contracts"))
    none = F.lit(None).cast("string")
    base = c.select("page_id", "repo_id", "branch", "path", F.lit("rest").alias("mechanism"), none.alias("method"), none.alias("service"), none.alias("http_method"))
    consumes = base.withColumn("cid", F.col("page_id")).withColumn("route", text.normalize_route(F.col("path")))
    raw = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("path", "[^/]*[0-9][^/]*", "{id}")).otherwise(F.col("path"))
    provides = base.withColumn("pid", F.col("page_id")).withColumn("route", text.normalize_route(raw))
    return consumes.drop("page_id", "path"), provides.drop("page_id", "path")


_MATCH = f"""SELECT DISTINCT c.cid, p.pid, c.repo_id AS c_repo, c.branch AS c_branch, p.repo_id AS p_repo, p.branch AS p_branch FROM {_C} c JOIN {_P} p
ON len(string_split(c.route, '/')) = len(string_split(p.route, '/')) AND c.route <> '/' AND p.route <> '/'
AND len(list_filter(list_zip(string_split(c.route, '/'), string_split(p.route, '/')), lambda z: z[1] <> z[2] AND z[1] <> '*' AND z[2] <> '*')) = 0
WHERE c.repo_id <> p.repo_id OR c.branch <> p.branch"""


@query(_MATCH)
def j1_route_join(spark, sf):
    return links.service_matches(*_contracts(spark, sf))


@query(f"SELECT c.cid, c.route FROM {_C} c WHERE c.cid NOT IN (SELECT cid FROM ({_MATCH}))")
def j9_unmatched_consumes(spark, sf):
    consumes, provides = _contracts(spark, sf)
    return consumes.join(links.service_matches(consumes, provides), "cid", "left_anti").select("cid", "route")


@query(f"""WITH m AS ({_MATCH}) SELECT cid, pid, CASE WHEN count(DISTINCT p_repo) OVER (PARTITION BY cid) > 1 THEN 'low' ELSE 'medium' END AS confidence FROM m""")
def a7_link_confidence(spark, sf):
    consumes, provides = _contracts(spark, sf)
    return links.matched_services(consumes.withColumn("target_hint", F.lit(None).cast("string")), provides, _pairs(spark, "prefix")).select("cid", "pid", "confidence")


def _pairs(spark, key: str):
    return spark.createDataFrame([], f"{key} string, value string")


@query("""SELECT c.page_id AS cid, p.page_id AS pid FROM pages c JOIN pages p ON c.page_id % 50 = p.page_id % 50
WHERE (CASE c.page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Cart' ELSE 'shop.Cart' END) IN ('', CASE p.page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Cart' ELSE 'shop.Cart' END)
OR p.page_id % 3 = 0 OR (c.page_id % 3 = 1 AND p.page_id % 3 = 2) OR (c.page_id % 3 = 2 AND p.page_id % 3 = 1)""")
def j3_rpc_join(spark, sf):
    service = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "Cart").otherwise("shop.Cart")
    p = bridge.tables(spark, sf)["pages"].select("page_id", (F.col("page_id") % 50).cast("string").alias("method"), service.alias("service"))
    return joins.rpc_matches(p.withColumnRenamed("page_id", "cid"), p.withColumnRenamed("page_id", "pid"))


@query(r"""WITH pre AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+/[^/?#]*)', 1) AS prefix FROM pages WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) FROM pages WHERE page_id % 2 = 0)
SELECT p.page_id, arg_max(x.prefix, length(x.prefix)) AS best FROM pages p LEFT JOIN pre x ON starts_with(p.url, x.prefix) AND x.prefix <> '' AND substr(p.url, length(x.prefix) + 1, 1) IN ('', '/', '?', '#', ':') GROUP BY p.page_id""")
def j7_longest_prefix(spark, sf):
    p = bridge.tables(spark, sf)["pages"]
    one = p.where("page_id % 3 = 0").select(F.regexp_extract("url", r"^([a-z]+://[^/?#]+/[^/?#]*)", 1).alias("prefix"))
    two = p.where("page_id % 2 = 0").select(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("prefix"))
    pre = one.union(two).where("prefix <> ''").distinct().withColumn("value", F.col("prefix"))
    return joins.longest_prefix(p.select("page_id", "url"), "url", pre, "best").select("page_id", "best")


_SPANS = "(SELECT o_orderkey % 100 AS file, CAST(o_orderkey AS STRING) AS id, CAST(o_custkey % 300 AS INT) AS s, CAST(o_custkey % 300 + o_orderkey % 17 AS INT) AS e, o_orderkey AS seq FROM orders)"
_POINTS = "(SELECT DISTINCT l_orderkey % 100 AS file, CAST(l_partkey % 320 AS INT) AS line FROM lineitem)"


def _spans(spark, sf):
    t = bridge.tables(spark, sf)
    o = t["orders"].selectExpr("o_orderkey % 100 AS file", "CAST(o_orderkey AS STRING) AS id", "CAST(o_custkey % 300 AS INT) AS start", "CAST(o_custkey % 300 + o_orderkey % 17 AS INT) AS end", "o_orderkey AS seq")
    return t["lineitem"].selectExpr("l_orderkey % 100 AS file", "CAST(l_partkey % 320 AS INT) AS line").distinct(), o


@query(f"SELECT p.file, p.line, arg_max(s.id, CAST(s.s AS BIGINT) * 10000000 + s.seq) AS enclosing FROM {_POINTS} p LEFT JOIN {_SPANS} s ON p.file = s.file AND p.line BETWEEN s.s AND s.e GROUP BY p.file, p.line")
def j15_enclosing(spark, sf):
    return joins.enclosing(*_spans(spark, sf), ["file"])


@query(f"SELECT p.file, p.line, arg_min(s.id, CAST(s.s AS BIGINT) * 10000000 + s.seq) AS following FROM {_POINTS} p LEFT JOIN {_SPANS} s ON p.file = s.file AND s.s BETWEEN p.line AND p.line + 12 GROUP BY p.file, p.line")
def j16_following(spark, sf):
    return joins.following(*_spans(spark, sf), ["file"])


@query("""SELECT sha256('topic::' || (CASE WHEN event_type < 'm' THEN 'kafka' ELSE 'sqs' END) || '::' || event_type) AS id, min(CASE WHEN event_type < 'm' THEN 'kafka' ELSE 'sqs' END) AS broker, event_type AS channel,
count(*) FILTER (event_id % 2 = 0) AS publishers, count(*) FILTER (event_id % 2 = 1) AS subscribers FROM events GROUP BY event_type""")
def j10_topic_hubs(spark, sf):
    e = bridge.tables(spark, sf)["events"]
    direction = F.when(F.col("event_id") % 2 == 0, "publish").otherwise("subscribe")
    channels = e.select(F.col("event_type").alias("channel"), F.lit("sqs").alias("broker"), direction.alias("direction"), F.col("user_id").cast("string").alias("node_id"))
    brokers = e.select(F.upper("event_type").alias("key"), F.lit("kafka").alias("value")).where("lower(key) < 'm'").distinct()
    return links.topic_hubs(channels, brokers)[0].select("id", "broker", "channel", "publishers", "subscribers")


# References of each page to its address: bare, by a variable that evidence names, by one that none names, by a template,
# and by a name that the registry gives another class.
_REF = r"""(SELECT page_id, page_id % 5 AS k, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, url FROM pages)"""


@query(f"""SELECT page_id, CASE k WHEN 4 THEN 'bucket' ELSE 'api' END AS resource_type, CASE k WHEN 0 THEN host WHEN 1 THEN host WHEN 2 THEN 'env:NONE_' || page_id ELSE 'held-' || page_id END AS identity,
CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'high' END AS confidence,
sha256('resource::' || CASE k WHEN 4 THEN 'bucket' ELSE 'api' END || '::' || lower(CASE k WHEN 0 THEN host WHEN 1 THEN host WHEN 2 THEN 'env:NONE_' || page_id ELSE 'held-' || page_id END)) AS id FROM {_REF} WHERE k <> 3""")
def j12_resource_identities(spark, sf):
    return _resolved(spark, sf)[0]


def _resolved(spark, sf):
    p = bridge.tables(spark, sf)["pages"]
    k, n = F.col("page_id") % 5, F.col("page_id").cast("string")
    target = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("env:p_"), n)).when(k == 2, F.concat(F.lit("env:NONE_"), n)).when(k == 3, F.lit("https://${HOST}/x")).otherwise(F.concat(F.lit("Named-"), n))
    refs = p.select("page_id", F.lit("h").alias("repo_id"), F.lit("main").alias("branch"), F.lit("api").alias("resource_type"), F.lit("http").alias("mechanism"), F.lit("read").alias("access"), target.alias("raw_target"), n.alias("node_id"), F.col("page_id").alias("seq"))
    registry = p.select(F.concat(F.lit("named-"), n).alias("key"), F.concat(F.lit("bucket: held-"), n).alias("value"))
    env = p.select(F.lit("h").alias("repo_id"), F.lit("main").alias("branch"), F.lit(".env").alias("file"), F.concat(F.lit("P_"), n, F.lit("="), F.col("url")).alias("detail"), F.col("url").alias("value"), F.lit(2).alias("seq"))
    blank = env.withColumn("value", F.lit("${LATER}")).withColumn("seq", F.lit(1))
    got = links.resolve_resources(refs, registry, env.union(blank))
    return got.select("page_id", "resource_type", "identity", "confidence", links.resource_id(F.col("resource_type"), F.col("identity")).alias("id")), (refs, registry, env)


@query(f"""SELECT DISTINCT 'READS_FROM' AS kind, CAST(page_id AS STRING) AS src, sha256('resource::' || CASE k WHEN 4 THEN 'bucket' ELSE 'api' END || '::' || lower(CASE k WHEN 0 THEN host WHEN 1 THEN host WHEN 2 THEN 'env:NONE_' || page_id ELSE 'held-' || page_id END)) AS dst FROM {_REF} WHERE k <> 3""")
def j12_resource_links(spark, sf):
    return links.resource_links(*_resolved(spark, sf)[1])[1]


@query("""WITH o AS (SELECT 'EDGE' AS entity, src || dst AS key, kind AS state FROM deps WHERE kind <> 'INVOKES'), n AS (SELECT 'EDGE' AS entity, src || dst AS key, kind AS state FROM deps WHERE kind <> 'QUERIES'),
o1 AS (SELECT entity, key, min(state) AS state FROM o GROUP BY 1, 2), n1 AS (SELECT entity, key, min(state) AS state FROM n GROUP BY 1, 2)
SELECT CASE WHEN n1.key IS NULL THEN 5 ELSE 4 END AS phase, CASE WHEN o1.key IS NULL THEN 'CREATE' WHEN n1.key IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, 'EDGE' AS entity, coalesce(o1.key, n1.key) AS key
FROM o1 FULL JOIN n1 ON o1.key = n1.key WHERE o1.state IS DISTINCT FROM n1.state""")
def l4_diff_link_sets(spark, sf):
    d = stored(bridge.view(spark, sf, "deps"))
    state = lambda k: d.where(F.col("kind") != k).groupBy(F.lit("EDGE").alias("entity"), F.concat("src", "dst").alias("key")).agg(F.min("kind").alias("state"))
    return links.diff_link_sets(state("INVOKES"), state("QUERIES"))


@query(r"""SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/'), lambda s: s <> ''), lambda s: s), '/') AS route,
lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]+)', 1)) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS tail, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM pages""")
def f1_routes(spark, sf):
    u = F.col("url")
    return bridge.tables(spark, sf)["pages"].select("page_id", text.normalize_route(u).alias("route"), text.url_host(u).alias("host"), text.tail_segment(F.regexp_replace(u, "[?#].*$", "")).alias("tail"), text.safe_segment(u).alias("safe"))


@query(r"""SELECT page_id, len(q) AS n_quoted, CAST(coalesce(sum_len, 0) AS BIGINT) AS quoted_chars FROM (SELECT page_id, q, list_sum(list_transform(q, lambda s: length(s) - 2)) AS sum_len FROM (SELECT page_id, regexp_extract_all(html, '("(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`)') AS q FROM pages))""")
def f12_quoted_strings(spark, sf):
    q = text.quoted_strings(F.col("html"))
    return bridge.tables(spark, sf)["pages"].select("page_id", q.alias("q")).select("page_id", F.size("q").cast("long").alias("n_quoted"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("quoted_chars"))


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(https?://[^\s"''`<>)\]},]+)'), lambda u: regexp_replace(u, '[.;:]+$', '')), ' ') AS urls FROM pages""")
def f19_find_urls(spark, sf):
    return bridge.tables(spark, sf)["pages"].select("page_id", F.array_join(text.find_urls(F.col("html")), " ").alias("urls"))


@query("SELECT p_partkey, sha256('topic::' || lower(p_brand) || '::' || lower(p_type)) AS topic, sha256('resource::table::' || lower(p_name)) AS resource, sha256(p_brand || '::' || p_name) AS symbol FROM part")
def f0_identities(spark, sf):
    p = bridge.tables(spark, sf)["part"]
    none = F.lit(None).cast("string")
    return p.select("p_partkey", ids.topic_id(F.col("p_brand"), F.col("p_type")).alias("topic"), ids.resource_id(F.lit("table"), F.col("p_name")).alias("resource"), ids.symbol_id(F.col("p_brand"), none, none, F.lit(""), F.col("p_name"), none).alias("symbol"))


@query("""WITH o AS (SELECT CAST(p_partkey AS STRING) AS path, p_brand || p_size AS hash FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT CAST(p_partkey AS STRING) AS path, p_brand || (CASE WHEN p_partkey % 11 = 0 THEN p_size + 100 ELSE p_size END) AS hash FROM part WHERE p_partkey % 5 <> 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.path IS NULL THEN 'in' WHEN n.path IS NULL THEN 'out' ELSE 'M' END AS status FROM o FULL JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash) GROUP BY status""")
def s7_file_changes(spark, sf):
    """Changes by status: additions and renames arrive (in), deletions and renames leave (out)."""
    p = bridge.tables(spark, sf)["part"]
    old = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_brand", F.col("p_size").cast("string")).alias("hash"))
    size = F.when(F.col("p_partkey") % 11 == 0, F.col("p_size") + 100).otherwise(F.col("p_size"))
    new = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.concat("p_brand", size.cast("string")).alias("hash"))
    c = snapshot.file_changes(old, new)
    both = F.when(F.col("status") == "R", F.array(F.lit("in"), F.lit("out"))).when(F.col("status") == "A", F.array(F.lit("in"))).when(F.col("status") == "D", F.array(F.lit("out"))).otherwise(F.array(F.lit("M")))
    return c.select(F.explode(both).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""RECURSIVE WITH d(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1 UNION SELECT e.src, d.depth + 1 FROM d JOIN dep e ON e.dst = d.id WHERE d.depth < 2),
  c(id, depth) AS (SELECT id, 0 FROM parts WHERE p_partkey = 1 UNION SELECT e.src, c.depth + 1 FROM c JOIN calls e ON e.dst = c.id WHERE c.depth < 2)
SELECT id, min(depth) AS depth FROM (SELECT * FROM d UNION ALL SELECT * FROM c) WHERE id <> {ROOT} GROUP BY id""")
def g15_change_impact(spark, sf):
    return _api(spark, sf, max_results=10_000_000).get_change_impact(_root_id(spark, sf), 2).rows


@query("""SELECT v.branch, bool_or(h.commit_id IS NOT NULL) AS indexed, count(*) FILTER (WHERE contains(lower(n.name), 'ring')) > 0 AS found, count(*) FILTER (WHERE contains(lower(n.name), 'ring')) AS matches
FROM (VALUES ('F'), ('O'), ('P'), ('none')) v(branch) LEFT JOIN heads h ON h.branch = v.branch AND h.repo = 'NATION_7' LEFT JOIN holds e ON e.src = h.commit_id LEFT JOIN nodes n ON n.id = e.dst GROUP BY v.branch""")
def g17_implementation_status(spark, sf):
    return _api(spark, sf).get_implementation_status("NATION_7", "Ring", ["F", "O", "P", "none"]).rows


@query(f"""SELECT id, kind, name FROM nodes WHERE id <> {ROOT} AND id IN (SELECT dst FROM edges WHERE src = {ROOT} UNION SELECT src FROM edges WHERE dst = {ROOT})""")
def g20_architecture_context(spark, sf):
    return _api(spark, sf, max_results=10_000_000).get_architecture_context(_root_id(spark, sf), 1).rows.select("id", "kind", "name")


_LINKS = """(SELECT CAST(l_partkey AS STRING) AS src, CAST(l_suppkey AS STRING) AS dst, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'medium' ELSE 'high' END AS confidence,
l_returnflag || l_linestatus AS pair, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq FROM lineitem)"""


@query(f"""WITH l AS {_LINKS}, b AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END DESC, seq) AS i FROM l),
e AS (SELECT src, dst, string_agg(pair, ',' ORDER BY seq) AS evidence FROM (SELECT src, dst, pair, min(seq) AS seq FROM l GROUP BY src, dst, pair) GROUP BY src, dst)
SELECT b.src, b.dst, b.confidence, b.seq AS first_seq, p.pairs, e.evidence FROM b JOIN (SELECT src, dst, string_agg(DISTINCT pair, ',' ORDER BY pair) AS pairs FROM l GROUP BY src, dst) p ON b.src = p.src AND b.dst = p.dst
JOIN e ON b.src = e.src AND b.dst = e.dst WHERE b.i = 1""")
def a4_merge_links(spark, sf):
    """Attributes of the best link (the first of equals), sorted branch pairs, evidence in order of arrival."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    rank = F.when(F.col("l_returnflag") == "A", "low").when(F.col("l_returnflag") == "N", "medium").otherwise("high")
    l = bridge.tables(spark, sf)["lineitem"].withColumn("seq", F.row_number().over(order)).withColumn("pair", F.concat("l_returnflag", "l_linestatus"))  # noqa: E741
    found = l.select(
        F.lit("CALLS_API").alias("kind"), F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"),
        F.create_map(F.lit("confidence"), rank, F.lit("seq"), F.col("seq").cast("string")).alias("properties"), F.array(F.struct(F.lit("pair").alias("kind"), F.col("pair").alias("detail"))).alias("evidence"),
        F.col("pair").alias("branch_pair"), F.col("seq").alias("arrival"),
    )
    out = links.merge_links(found)
    return out.select("src", "dst", F.col("properties.confidence").alias("confidence"), F.col("properties.seq").cast("long").alias("first_seq"), F.array_join("branch_pairs", ",").alias("pairs"), F.array_join(F.transform("evidence", lambda e: e["detail"]), ",").alias("evidence"))


@query("""SELECT c.branch, c.kind, count(*) AS n FROM (SELECT CASE WHEN n.id IN (SELECT dst FROM holds) THEN 'kept' ELSE 'gone' END AS branch, n.kind FROM nodes n WHERE n.kind = 'FUNCTION'
UNION ALL SELECT 'edge', e.kind FROM edges e WHERE NOT (e.src IN (SELECT id FROM parts WHERE id NOT IN (SELECT dst FROM holds)) OR e.dst IN (SELECT id FROM parts WHERE id NOT IN (SELECT dst FROM holds)))) c GROUP BY c.branch, c.kind""")
def k5_guarded_delete(spark, sf):
    # Keys stand for ids: only functions are doomed, and only kinds are counted.
    doomed = bridge.view(spark, sf, "function_keys")
    left, at, kept = snapshot.guarded_delete(doomed, stored(bridge.view(spark, sf, "edge_keys")), doomed)
    gone = doomed.join(left.select("id"), "id", "left_anti")
    one = lambda df, what: df.select(F.lit(what).alias("branch"), "kind")
    return one(doomed.join(kept, "id", "left_semi"), "kept").union(one(gone, "gone")).union(one(at, "edge")).groupBy("branch", "kind").agg(F.count(F.lit(1)).alias("n"))


from graphloom import case_queries  # noqa: E402,F401  the queries of extraction, index run and link pass
