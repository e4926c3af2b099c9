"""Level-synchronous traversals over edges (kind, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from graphloom.plans.storage import small, stored


def _kept(edges: DataFrame, kinds) -> DataFrame:
    e = edges.select("kind", "src", "dst")
    return e.where(F.col("kind").isin(*kinds)) if kinds else e


def _steps(e: DataFrame, inbound: bool, both: bool) -> DataFrame:
    out, back = (F.struct(F.col(x).alias("near"), F.col(y).alias("far")) for x, y in (("src", "dst"), ("dst", "src")))
    if both:  # one pass over the edges for both ways
        return e.select("kind", "src", "dst", F.inline(F.array(out, back)))
    return e.select("kind", "src", "dst", (back if inbound else out).alias("s")).select("kind", "src", "dst", "s.*")


def bfs(edges: DataFrame, starts: DataFrame, depth: int, kinds=None, inbound: bool = False, both: bool = False, members: DataFrame | None = None, with_edges: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(edges met: kind, src, dst, depth) and (nodes reached: root, id, depth; the roots at depth 0).

    ``starts`` has a column id; all roots are walked at once, each with its own visited set. Every node is expanded once
    a root; an edge to a visited node is still met. ``members`` (node_id) restricts the far ends. Without ``with_edges``
    no edge is stored for the first result (None). The edges are read once a level: stored where there are several.
    """
    e = _kept(edges, kinds)
    reached = stored(starts.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct(), "bfs-0")
    frontier, n, met = reached, reached.count(), None
    if n and depth > 1:
        e = stored(e, "bfs-edges")
    steps = _steps(e, inbound, both)
    for d in range(1, depth + 1):
        if not n:
            break
        hop = steps.join(small(frontier.select("root", F.col("id").alias("near")), n), "near")
        if members is not None:
            hop = hop.join(members.select(F.col("node_id").alias("far")), "far", "left_semi")
        if with_edges:
            hop = stored(hop.select("root", "kind", "src", "dst", "far"), f"bfs-hop{d}")
            met = hop.withColumn("depth", F.lit(d)) if met is None else met.union(hop.withColumn("depth", F.lit(d)))
        new = hop.select("root", F.col("far").alias("id")).distinct().join(reached.select("root", "id"), ["root", "id"], "left_anti")
        frontier = stored(new.withColumn("depth", F.lit(d)), f"bfs-{d}")
        n = frontier.count()  # from the files' footers
        reached = reached.union(frontier) if n else reached
    if not with_edges:
        return None, reached
    if met is None:
        met = steps.select(F.lit("").alias("root"), "kind", "src", "dst", "far", F.lit(0).alias("depth")).limit(0)
    met = met.groupBy("root", "kind", "src", "dst").agg(F.min("depth").alias("depth"))
    return met, reached


def traverse(edges: DataFrame, start: str, depth: int, kinds=None, inbound=False, both=False, budget: int = 50, members=None) -> tuple[DataFrame, bool]:
    """(at most ``budget`` edges in the order depth, kind rank, far end; whether more exist or the depth cut a frontier)."""
    starts = edges.sparkSession.createDataFrame([(start,)], "id string")
    met, reached = bfs(edges, starts, depth, kinds, inbound, both, members)
    rank = {k: i for i, k in enumerate(kinds or ())}
    order = [F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("kind")), F.lit(99))] if rank else []
    first = met.orderBy("depth", *order, "kind", "src", "dst").limit(budget + 1)
    n = first.count()
    cut = not reached.where(F.col("depth") == depth).isEmpty()
    return first.limit(budget).drop("root"), n > budget or cut


def field_of(nodes: DataFrame, name: str) -> Column:
    """A node's repository, branch or path: its own column, else that of its location, else the property; null without any."""
    kinds = {f.name: f.dataType for f in nodes.schema}
    found = [F.col(name)] if name in kinds else []
    if isinstance(kinds.get("location"), StructType) and name in kinds["location"].fieldNames():
        found.append(F.col("location")[name])
    if isinstance(kinds.get("properties"), MapType):
        found.append(F.col("properties")[name])
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def in_repository(nodes: DataFrame, repo: str) -> Column:
    """Whether a node's column, location or property names the repository."""
    kinds = {f.name: f.dataType for f in nodes.schema}
    tests = [F.col("repository") == repo] if "repository" in kinds else []
    if isinstance(kinds.get("location"), StructType):
        tests.append(F.col("location")["repository"] == repo)
    if isinstance(kinds.get("properties"), MapType):
        tests.append(F.col("properties")["repository"] == repo)
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def branch_members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, branch_id, branch: what the head commit of each branch contains, and nodes that name a branch themselves (branch_id null)."""
    points = edges.where("kind = 'POINTS_TO'").select(F.col("src").alias("branch_id"), F.col("dst").alias("commit_id"))
    holds = edges.where("kind = 'CONTAINS_STATE_OF'").select(F.col("src").alias("commit_id"), F.col("dst").alias("node_id"))
    names = nodes.where("kind = 'BRANCH'").select(F.col("id").alias("branch_id"), F.col("name").alias("branch"))
    held = points.join(holds, "commit_id").join(names, "branch_id").select("node_id", "branch_id", "branch")
    own = nodes.select(F.col("id").alias("node_id"), F.lit(None).cast("string").alias("branch_id"), field_of(nodes, "branch").alias("branch")).where("branch is not null")
    return held.union(own).distinct()


def edge_branch_gate(edges: DataFrame, branch: str, service_kinds, exact: bool = False) -> DataFrame:
    """Service edges that carry branch_pairs must name the branch: bare, or as either end of ``repo@a -> repo@b``."""
    named = F.array_contains("branch_pairs", branch)
    if not exact:
        named = named | F.exists("branch_pairs", lambda p: F.exists(F.split(p, " -> "), lambda x: F.substring_index(x, "@", -1) == branch))
    return edges.where(~F.col("kind").isin(*service_kinds) | F.col("branch_pairs").isNull() | named)


def edges_at(edges: DataFrame, node: str, inbound: bool, kind: str | None = None) -> DataFrame:
    """The edges that leave or reach a node, of one kind or of all, in a total order."""
    here, other = ("dst", "src") if inbound else ("src", "dst")
    at = edges.where(F.col(here) == node)
    return (at if kind is None else at.where(F.col("kind") == kind)).orderBy("kind", other)


def neighbours(edges: DataFrame, node: str, kinds, inbound: bool, limit: int) -> DataFrame:
    """The first edges at a node in the order of kinds, then of the other end."""
    here, other = ("dst", "src") if inbound else ("src", "dst")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    return edges.where((F.col(here) == node) & F.col("kind").isin(*kinds)).orderBy(rank, other).limit(limit)


def top_neighbours(edges: DataFrame, kinds, inbound: bool, limit: int) -> DataFrame:
    """``neighbours`` of every node at once: node, kind, other, rank."""
    here, other = ("dst", "src") if inbound else ("src", "dst")
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    w = Window.partitionBy(here).orderBy(rank, other)
    rows = edges.where(F.col("kind").isin(*kinds)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return rows.select(F.col(here).alias("node"), "kind", F.col(other).alias("other"), "rank")
