"""The bounded, branch-aware questions of the graph: every one returns rows, a truncation flag and their provenance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import DEPENDENCY_KINDS, SERVICE_KINDS, SYMBOL_KINDS
from graphloom.operators import analytics
from graphloom.operators.traverse import bfs, branch_members, edge_branch_gate, field_of, in_repository, neighbours, traverse


@dataclass
class GraphResult:
    """``rows`` answer the question; ``parts`` hold what belongs to it besides, by name."""

    rows: DataFrame
    truncated: bool = False
    parts: dict[str, DataFrame | bool] = field(default_factory=dict)

    def provenance(self) -> DataFrame | None:
        """Distinct provenance of the rows in the order of its first row, where they carry any."""
        if "provenance" not in self.rows.columns:
            return None
        seen = self.rows.select("id" if "id" in self.rows.columns else F.lit("").alias("id"), F.posexplode("provenance").alias("i", "p"))
        return seen.groupBy("p").agg(F.min(F.struct("id", "i")).alias("first")).orderBy("first").select("p.*")


@dataclass
class Budget:
    max_results: int = 50
    max_depth: int = 3
    branch_set_limit: int = 10_000

    def limit(self, n: int | None) -> int:
        return max(1, min(self.max_results if n is None else n, self.max_results))

    def depth(self, n: int | None) -> int:
        return max(0, min(self.max_depth if n is None else n, self.max_depth))


def _named(value: str | None, what: str) -> str:
    if not value or not value.strip():
        raise ValueError(f"{what} must not be empty")
    return value


class GraphApi:
    """Questions over DataFrames ``nodes`` (id, kind, name, qualified_name, repository, path ..) and ``edges`` (kind, src, dst ..)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, budget: Budget | None = None):
        self.nodes, self.edges, self.budget = nodes, edges, budget or Budget()

    def members(self, branch: str | None, repo: str | None = None) -> DataFrame | None:
        if branch is None:
            return None
        m = branch_members(self.edges, self.nodes).where(F.col("branch") == _named(branch, "branch"))
        if repo is not None:
            own = self.nodes.where((F.col("kind") == "BRANCH") & in_repository(self.nodes, repo)).select(F.col("id").alias("branch_id"))
            m = m.join(own, "branch_id", "left_semi")
        return m.select("node_id").distinct()

    def _on_branch(self, rows: DataFrame, column: str, branch: str | None) -> DataFrame:
        m = self.members(branch)
        return rows if m is None else rows.join(m.withColumnRenamed("node_id", column), column, "left_semi")

    def _cut(self, rows: DataFrame, limit: int) -> GraphResult:
        first = rows.limit(limit + 1)
        return GraphResult(first.limit(limit), first.count() > limit)

    def _ends(self, result: GraphResult, other: str) -> GraphResult:
        """With the nodes at the other ends of the edges: one join for all."""
        result.parts["nodes"] = self.nodes.join(result.rows.select(F.col(other).alias("id")).distinct(), "id", "left_semi")
        return result

    def find_symbol(self, name: str, repo: str | None = None, limit: int | None = None, branch: str | None = None, mode: str = "contains") -> GraphResult:
        _named(name, "name")
        exact = (F.col("name") == name) | (F.col("qualified_name") == name)
        hit = self.nodes.where(exact if mode == "exact" else F.contains(F.lower("name"), F.lit(name.lower())))
        if repo is not None:
            hit = hit.where(in_repository(self.nodes, repo))
        return self._cut(self._on_branch(hit, "id", branch).orderBy("id"), self.budget.limit(limit))

    def get_symbol(self, id: str, branch: str | None = None) -> GraphResult:
        return GraphResult(self._on_branch(self.nodes.where(F.col("id") == _named(id, "id")), "id", branch))

    def _walk(self, node: str, depth, kinds, inbound, branch, both=False, budget=None) -> GraphResult:
        rows, cut = traverse(self.edges, _named(node, "id"), self.budget.depth(depth), kinds, inbound, both, budget or self.budget.max_results, self.members(branch))
        return GraphResult(rows, cut)

    def get_callers(self, id: str, depth: int | None = None, branch: str | None = None) -> GraphResult:
        return self._ends(self._walk(id, depth, ("CALLS",), True, branch), "src")

    def get_callees(self, id: str, depth: int | None = None, branch: str | None = None) -> GraphResult:
        return self._ends(self._walk(id, depth, ("CALLS",), False, branch), "dst")

    def _near(self, node: str, kinds, inbound: bool, limit, branch) -> GraphResult:
        e, other = self.edges, "src" if inbound else "dst"
        if branch is not None:
            if "branch_pairs" in e.columns:
                e = edge_branch_gate(e, branch, SERVICE_KINDS)
            e = self._on_branch(e, other, branch)
        n = self.budget.limit(limit)
        return self._ends(self._cut(neighbours(e, _named(node, "id"), kinds, inbound, n + 1), n), other)

    def get_references(self, id: str, limit: int | None = None, branch: str | None = None) -> GraphResult:
        return self._near(id, ("REFERENCES",), True, limit, branch)

    def get_implementations(self, id: str, limit: int | None = None, branch: str | None = None) -> GraphResult:
        return self._near(id, ("IMPLEMENTS",), True, limit, branch)

    def get_dependencies(self, id: str, limit: int | None = None, branch: str | None = None) -> GraphResult:
        return self._near(id, DEPENDENCY_KINDS, False, limit, branch)

    def get_dependents(self, id: str, limit: int | None = None, branch: str | None = None) -> GraphResult:
        return self._near(id, DEPENDENCY_KINDS, True, limit, branch)

    def heads(self, repo: str) -> DataFrame:
        """repo_id, branch_id, branch, commit_id of all branches of a repository."""
        r = self.nodes.where((F.col("kind") == "REPOSITORY") & (F.col("name") == _named(repo, "repo"))).select(F.col("id").alias("repo_id"))
        b = self.nodes.where("kind = 'BRANCH'").select(F.col("id").alias("branch_id"), F.col("name").alias("branch"))
        has = self.edges.where("kind = 'HAS_BRANCH'").select(F.col("src").alias("repo_id"), F.col("dst").alias("branch_id"))
        at = self.edges.where("kind = 'POINTS_TO'").select(F.col("src").alias("branch_id"), F.col("dst").alias("commit_id"))
        return r.join(has, "repo_id").join(b, "branch_id").join(at, "branch_id").select("repo_id", "branch_id", "branch", "commit_id")

    def head(self, repo: str, branch: str) -> DataFrame:
        """repo_id, branch_id, branch, commit_id of a branch that is indexed; no rows otherwise."""
        return self.heads(repo).where(F.col("branch") == _named(branch, "branch"))

    def _held(self, heads: DataFrame) -> DataFrame:
        holds = self.edges.where("kind = 'CONTAINS_STATE_OF'").select(F.col("src").alias("commit_id"), F.col("dst").alias("id"))
        return heads.join(holds, "commit_id")

    def _state(self, repo: str, branch: str) -> DataFrame:
        return self._held(self.head(repo, branch)).select("id").distinct().join(self.nodes, "id")

    def get_branch_context(self, repo: str, branch: str) -> GraphResult:
        """Nodes of the branch's state; parts: head, and whether the branch is indexed."""
        at = self.head(repo, branch)
        out = self._cut(self._state(repo, branch).orderBy("id"), self.budget.max_results)
        out.parts |= {"head": at, "indexed": not at.isEmpty()}
        return out

    def branch_symbols(self, repo: str, branch: str) -> DataFrame:
        return self._state(repo, branch).where(F.col("kind").isin(*SYMBOL_KINDS)).select("name").distinct()

    def compare_branch_state(self, repo: str, branch_a: str, branch_b: str) -> GraphResult:
        """name, side: common, only_a or only_b, by name, of the first names of each branch up to the set limit; parts: which are indexed."""
        n = self.budget.branch_set_limit
        names = {x: self.branch_symbols(repo, b).orderBy("name").limit(n + 1) for x, b in (("a", branch_a), ("b", branch_b))}
        more = any(df.count() > n for df in names.values())
        left, right = (names[x].limit(n).withColumn(f"in_{x}", F.lit(True)) for x in "ab")
        both = left.join(right, "name", "full_outer")
        side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("common")
        indexed = {f"indexed_{x}": not self.head(repo, b).isEmpty() for x, b in (("a", branch_a), ("b", branch_b))}
        return GraphResult(both.select("name", side.alias("side")).orderBy("name"), more, indexed)

    def get_change_impact(self, id: str, depth: int | None = None, branch: str | None = None) -> GraphResult:
        """id, depth of what calls or depends on a node, nearest first; parts: the callers' and the dependents' edges."""
        calls = self._walk(id, depth, ("CALLS",), True, branch)
        left = self.budget.max_results - calls.rows.count()
        deps = self._walk(id, depth, DEPENDENCY_KINDS, True, branch, budget=left) if left > 0 else GraphResult(calls.rows.limit(0))
        rows = calls.rows.unionByName(deps.rows).where(F.col("src") != id).groupBy(F.col("src").alias("id")).agg(F.min("depth").alias("depth"))
        return GraphResult(rows.orderBy("depth", "id"), calls.truncated or deps.truncated, {"callers": calls.rows, "dependents": deps.rows})

    def get_deployment_state(self, repo: str, env: str) -> GraphResult:
        e = self.edges.where("kind = 'DEPLOYED_TO'")
        at = self.nodes.where((F.col("kind") == "DEPLOYMENT_ENVIRONMENT") & (F.col("name") == env)).select(F.col("id").alias("dst"))
        own = self.nodes.where((F.col("kind") == "COMMIT") & in_repository(self.nodes, repo)).select(F.col("id").alias("src"), F.col("name").alias("commit"))
        return self._cut(e.join(at, "dst").join(own, "src").orderBy("src", "dst"), self.budget.max_results)

    def get_implementation_status(self, repo: str, capability: str, branches: list[str]) -> GraphResult:
        """branch, indexed, found, matches: whether symbols that match the capability are in the state of each branch; one plan for all."""
        if not branches:
            raise ValueError("branches must not be empty")
        named = F.contains(F.lower("name"), F.lit(_named(capability, "capability").lower()))
        hit = self.nodes.where(named).where(in_repository(self.nodes, repo) | field_of(self.nodes, "repository").isNull()).select("id")
        asked = self.nodes.sparkSession.createDataFrame([(b,) for b in dict.fromkeys(branches)], "branch string")
        heads = self.heads(repo).join(asked, "branch", "left_semi")
        found = self._held(heads).join(hit, "id", "left_semi").groupBy("branch").agg(F.count_distinct("id").alias("matches"))
        known = heads.groupBy("branch").agg(F.lit(True).alias("indexed"))
        rows = asked.join(known, "branch", "left").join(found, "branch", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
        return GraphResult(rows.select("branch", F.coalesce("indexed", F.lit(False)).alias("indexed"), (F.col("matches") > 0).alias("found"), "matches"))

    def get_architecture_context(self, id: str, depth: int | None = None, branch: str | None = None) -> GraphResult:
        """The nodes around a node over edges of all kinds; parts: those edges."""
        e = self._walk(id, depth, None, False, branch, both=True)
        ids = e.rows.select(F.explode(F.array("src", "dst")).alias("id")).where(F.col("id") != id).distinct()
        around = self._cut(self.nodes.join(ids, "id", "left_semi").orderBy("id"), self.budget.max_results)
        return GraphResult(around.rows, e.truncated or around.truncated, {"edges": e.rows})

    def _at_path(self, path: str) -> Column:
        """Whether a node lies at a path (or at the end of its own one) or has it as its name."""
        own = field_of(self.nodes, "path")
        return F.coalesce((own == path) | own.endswith(path), F.lit(False)) | (F.col("name") == path)

    def get_code_context(self, ids: list[str] | None = None, paths: list[str] | None = None, depth: int | None = None, branch: str | None = None) -> GraphResult:
        """root, id, depth and node of all symbols asked for and of what is around them; parts: symbols, path_matches (up to the limit)."""
        if not ids and not paths:
            raise ValueError("ids or paths are needed")
        symbols = self._on_branch(self.nodes.where(F.col("id").isin([_named(i, "id") for i in ids or []])), "id", branch)
        hit = F.lit(False)
        for p in paths or []:
            hit = hit | self._at_path(_named(p, "path"))
        matches = self._on_branch(self.nodes.where(hit), "id", branch).orderBy("id").limit(self.budget.max_results)
        _, reached = bfs(self.edges, symbols.select("id"), self.budget.depth(depth), None, both=True, members=self.members(branch), with_edges=False)
        return GraphResult(reached.join(self.nodes, "id").orderBy("root", "depth", "id"), False, {"symbols": symbols, "path_matches": matches})

    def get_dependency_analytics(self, mode: str, id: str | None = None, depth: int | None = None, limit: int | None = None, branch: str | None = None) -> dict:
        """The analytics envelope of a mode; a branch filters the rows after the limit."""
        if mode not in analytics.MODES:
            raise ValueError(f"unknown mode {mode}")
        if (mode == "blast_radius") != (id is not None):
            raise ValueError("an id belongs to blast_radius, and only to it")
        rows = analytics.run(mode, self.nodes, self.edges, id, self.budget.depth(depth))
        if "name" not in rows.columns:
            rows = rows.join(self.nodes.select("id", "name", "kind"), "id", "left").orderBy(*_best_first(mode))
        out = analytics.report(rows, self.budget.limit(limit))
        out["rows"] = self._on_branch(out["rows"], "id", branch).orderBy(*_best_first(mode))
        return out | {"mode": mode}


def _best_first(mode: str) -> list[Column]:
    if mode == "blast_radius":
        return [F.col("distance"), F.col("id")]
    return [F.desc("size"), F.col("component"), F.col("id")] if mode == "clusters" else [F.desc("score"), F.col("id")]
