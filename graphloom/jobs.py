"""Runs over a workspace: index what changed, link what was indexed, tell the state."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import scaffold_id
from graphloom.operators import indexing, links, snapshot
from graphloom.operators.links import LinkSet
from graphloom.plans.storage import stored
from graphloom.sources import git
from graphloom.sources.config import Repository, Workspace, resolve_heads
from graphloom.sources.store import RunState, SparkGraphStore

CONTRACTS = {
    "provides": "repo_id string, branch string, file string, mechanism string, http_method string, route string, service string, method string, handler_id string, line int, language string",
    "consumes": "repo_id string, branch string, file string, mechanism string, http_method string, route string, service string, method string, target_hint string, caller_id string, line int, language string",
    "channels": "repo_id string, branch string, file string, direction string, broker string, channel string, channel_type string, node_id string, line int",
    "resources": "repo_id string, branch string, file string, resource_type string, mechanism string, access string, raw_target string, node_id string, line int",
    "evidence": "repo_id string, branch string, file string, seq long, kind string, value string, detail string, target_repo string, channel string, broker string, line int",
}


@dataclass
class Engine:
    """A workspace with its store and what its runs keep, in one folder."""

    spark: SparkSession
    workspace: Workspace
    home: str

    def __post_init__(self) -> None:
        self.store = SparkGraphStore(self.spark, f"{self.home}/graph")
        self.state = RunState(self.spark, f"{self.home}/runs")

    def index_files(self, repo: Repository, branch: str, sha: str, files: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Index the files (repo_id, branch, path, content) of a head: all of them, or those that changed if ``removed`` paths are given."""
        prev = self.state.load_maps(repo.id, branch)
        held = self.state.load_contracts(repo.id, branch)
        if prev is None:
            removed = None
        run = indexing.index_files(files, repo.github, branch, sha, prev, removed, held, self.state.last_sha(repo.id, branch), repo.languages)
        return self.state.commit(self.store, repo.id, branch, sha, run)

    def index_repository(self, repo: Repository, folder: str | Path, full: bool = False) -> list[tuple[str, str, dict[str, int]]]:
        """(branch, sha, counters) of every branch of a repository whose head is not indexed yet; a diff that fails means a whole run."""
        path = git.open_repository(folder)
        names = self.spark.createDataFrame([(repo.id, b) for b in self.workspace.branches(repo)], "repo_id string, branch string")
        heads = resolve_heads(git.refs(self.spark, path, repo.id), names).where("sha is not null")
        out = []
        for row in self.state.due(heads, full).orderBy("branch").collect():  # the branches of one repository
            last = self.state.last_sha(repo.id, row.branch)
            listing = git.files_at(self.spark, path, repo.id, row.branch, row.sha)
            removed, wanted = None, None
            if last and not full and self.state.load_maps(repo.id, row.branch):
                try:
                    analyze, removed = snapshot.incremental_plan(git.changes(self.spark, path, last, row.sha))
                    wanted = [r.path for r in analyze.collect()]  # the paths of one change
                except git.GitError:
                    removed = None
            files = git.with_content(self.spark, path, row.sha, listing, wanted)
            out.append((row.branch, row.sha, self.index_files(repo, row.branch, row.sha, files, removed)))
        return out

    def index(self, folder_of, repo: str | None = None, full: bool = False) -> dict[str, list]:
        """A pass over all enabled repositories, or one; then the link pass. One that fails doesn't stop the others."""
        done: dict[str, list] = {}
        for r in self.workspace.selected(repo):
            try:
                done[r.id] = self.index_repository(r, folder_of(r), full)
            except (git.GitError, ValueError) as e:
                done[r.id] = [("", "", {"failed": 1, "message": str(e)})]
        done["links"] = [self.link()]
        return done

    def heads(self) -> DataFrame:
        """repo_id, branch, commit_id of the enabled repositories' branches that are indexed."""
        known = self.spark.createDataFrame([(r.id, r.github, b) for r in self.workspace.selected() for b in self.workspace.branches(r)], "repo_id string, github string, branch string")
        s = self.state.state().select("repo_id", "branch", "sha")
        return known.join(s, ["repo_id", "branch"]).select("repo_id", "branch", scaffold_id(F.col("github"), "commit", F.col("sha")).alias("commit_id"))

    def _contracts(self, heads: DataFrame) -> dict[str, DataFrame]:
        out = {k: self.spark.createDataFrame([], v) for k, v in CONTRACTS.items()}
        for row in heads.select("repo_id", "branch").collect():  # configured branches
            held = self.state.load_contracts(row.repo_id, row.branch)
            for k in out if held else ():
                out[k] = out[k].unionByName(held.tables[k].select(*out[k].columns))
        return out

    def compute_links(self) -> LinkSet:
        heads = stored(self.heads(), "link-heads")
        tables = self._contracts(heads)
        numbered = lambda name, key: stored(tables[name].withColumn(key, F.monotonically_increasing_id()), f"link-{name}")
        table = lambda n, k: self.workspace.link_table(self.spark, n).withColumnRenamed("key", k)
        return links.compute_links(
            heads, numbered("provides", "pid"), numbered("consumes", "cid"), numbered("channels", "seq"), numbered("resources", "seq"), tables["evidence"],
            table("base_urls", "prefix"), table("channel_brokers", "key"), table("resources", "key"),
        )

    def link(self) -> dict[str, int]:
        """The link pass: what changed since the stored set is applied, and the new set is stored if no op failed. An equal set changes nothing."""
        new = self.compute_links()
        new = LinkSet(stored(new.edges, "link-edges"), stored(new.topics, "link-topics"), stored(new.resources, "link-resources"))
        old = self.state.load_links() or LinkSet(new.edges.limit(0), new.topics.limit(0), new.resources.limit(0))
        changes = stored(links.link_delta(old, new), "link-delta")
        if changes.isEmpty():
            return {}
        nodes, edges, ops = link_ops(changes, new, self.store.nodes, self.store.edges)
        done = self.store.apply_delta(nodes, edges, ops)
        if not done.get("errors"):
            self.state.save_links(new)
        return done

    def status(self) -> DataFrame:
        """repo_id, branch, sha, indexed_at of all configured branches; nulls where none was indexed."""
        known = self.spark.createDataFrame([(r.id, b, r.enabled) for r in self.workspace.repositories for b in self.workspace.branches(r)], "repo_id string, branch string, enabled boolean")
        return known.join(self.state.state(), ["repo_id", "branch"], "left").orderBy("repo_id", "branch")


def link_ops(changes: DataFrame, new: LinkSet, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node payload, edge payload, ops) of changes between link sets, in the schema of a store's tables."""
    typed = lambda df, like: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])
    payload = typed(links.topic_nodes(new.topics).unionByName(links.resource_nodes(new.resources)), nodes)
    held = links.contains_pairs(new).select(F.lit("CONTAINS_STATE_OF").alias("kind"), F.col("commit").alias("src"), F.col("id").alias("dst"))
    ties = typed(links.graph_edges(new.edges), edges).unionByName(typed(held, edges))
    part, node, pair = (lambda i: F.get(F.split("key", "\x1f"), i)), F.col("entity").isin("TOPIC", "RESOURCE"), F.col("entity") == "CONTAINS"
    ops = changes.select(
        # The applier knows nodes, edges, deleted edges and deleted nodes, in that order.
        F.when(node & (F.col("op") != "DELETE"), 0).when(node, 3).when(F.col("op") != "DELETE", 1).otherwise(2).alias("phase"), "op", F.when(node, "node").otherwise("edge").alias("entity"),
        F.when(node, F.lit(None)).when(pair, "CONTAINS_STATE_OF").otherwise(part(0)).alias("kind"), F.when(node, F.col("key")).when(pair, part(0)).otherwise(part(1)).alias("a"),
        F.when(node, F.lit(None)).when(pair, part(1)).otherwise(part(2)).alias("b"),
    )
    return payload, ties, ops
