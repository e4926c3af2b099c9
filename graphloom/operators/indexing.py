"""The index run: files of a branch head become nodes, edges and contracts, whole or for the files that changed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.extract import evidence, rules, walker
from graphloom.functions.ids import scaffold_id
from graphloom.model import STATE_KINDS
from graphloom.operators import snapshot
from graphloom.plans.storage import stored
from graphloom.sources.registry import detect_languages, is_skipped

NODE = (
    "id string, kind string, name string, qualified_name string, language string, "
    "location struct<repository:string,commit_sha:string,path:string,start_line:int,start_column:int,end_line:int,end_column:int,branch:string>, "
    "content_hash string, properties map<string,string>, provenance array<struct<source:string,analyzer_version:string,status:string,detail:string,recorded_at:string>>"
)
EDGE = "kind string, src string, dst string, content_hash string, properties map<string,string>, provenance array<struct<source:string,analyzer_version:string,status:string,detail:string,recorded_at:string>>"
NODE_COLUMNS = ["id", "kind", "name", "qualified_name", "language", "location", "content_hash", "properties", "provenance"]
EDGE_COLUMNS = ["kind", "src", "dst", "content_hash", "properties", "provenance"]
COMPARED_NODE, COMPARED_EDGE = ("content_hash", "properties", "location"), ("content_hash", "properties")
_GIT = "array(named_struct('source', 'GIT', 'analyzer_version', cast(null as string), 'status', 'COMPLETE', 'detail', cast(null as string), 'recorded_at', cast(null as string)))"


def _own(df: DataFrame, columns: list[str], schema: str) -> DataFrame:
    """The columns of a schema, those that are missing as nulls."""
    types = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c].dataType).alias(c) for c in columns])


def _git_node(node_kind: str, ident: Column, label: Column, qualified: Column, **props: Column) -> list[Column]:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v)]
    bag = F.create_map(*pairs) if pairs else F.create_map()
    return [
        ident.alias("id"), F.lit(node_kind).alias("kind"), label.alias("name"), qualified.alias("qualified_name"), F.lit(None).cast("string").alias("language"), F.lit(None).alias("location"),
        F.lit(None).cast("string").alias("content_hash"), bag.cast("map<string,string>").alias("properties"), F.expr(_GIT).alias("provenance"),
    ]


def _git_edge(kind: str, src: Column, dst: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(None).cast("string").alias("content_hash"), F.create_map().cast("map<string,string>").alias("properties"), F.expr(_GIT).alias("provenance")]


def add_scaffolding(nodes: DataFrame, edges: DataFrame, github: str, branch: str, sha: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with repository, branch, head commit and files.

    The commit contains the state of every symbol; a file, at the place of its symbol with the smallest id, belongs to the
    commit, and its symbols are defined in it. What is there already is replaced, but a file that is known stays.
    """
    spark, g = nodes.sparkSession, F.lit(github)
    repo, head, commit = scaffold_id(g, "repo", F.lit(None).cast("string")), scaffold_id(g, "branch", F.lit(branch)), scaffold_id(g, "commit", F.lit(sha))
    one = spark.range(1)
    scaffold = (
        one.select(*_git_node("REPOSITORY", repo, g, g, github=g))
        .union(one.select(*_git_node("BRANCH", head, F.lit(branch), F.lit(f"{github}#{branch}"), name=F.lit(branch))))
        .union(one.select(*_git_node("COMMIT", commit, F.lit(sha), F.lit(f"{github}@{sha}"), sha=F.lit(sha), repository=g)))
    )
    state = nodes.where(F.col("kind").isin(*STATE_KINDS))
    placed = state.where("location is not null").withColumn("file_id", scaffold_id(g, "file", F.col("location.path")))
    files = placed.groupBy("file_id").agg(F.min_by("location", "id").alias("at")).join(nodes.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    file_nodes = files.select(*_git_node("FILE", F.col("file_id"), F.col("at.path"), F.concat(F.lit(f"{github}:"), F.col("at.path")))[:5], F.col("at").alias("location"), *_git_node("FILE", F.col("file_id"), F.col("at.path"), F.col("at.path"))[6:])
    ties = (
        one.select(*_git_edge("HAS_BRANCH", repo, head)).union(one.select(*_git_edge("POINTS_TO", head, commit))).union(state.select(*_git_edge("CONTAINS_STATE_OF", commit, F.col("id"))))
        .union(files.select(*_git_edge("HAS_FILE", commit, F.col("file_id")))).union(placed.select(*_git_edge("DEFINED_IN", F.col("id"), F.col("file_id"))))
    )
    new_nodes = _own(scaffold, NODE_COLUMNS, NODE).unionByName(_own(file_nodes, NODE_COLUMNS, NODE))
    return snapshot.upsert(_own(nodes, NODE_COLUMNS, NODE), new_nodes, ["id"]), snapshot.upsert(_own(edges, EDGE_COLUMNS, EDGE), _own(ties, EDGE_COLUMNS, EDGE), snapshot.EDGE_KEY)


def merge_incremental(prev: tuple[DataFrame, DataFrame], fresh: tuple[DataFrame, DataFrame], removed: DataFrame, github: str, branch: str, sha: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot after a run over changed files: what lay at the removed paths and the old commit goes, fresh facts come.

    Edges stay where both of their ends do, then the scaffolding of the new head is added.
    """
    nodes, edges = (_own(prev[0], NODE_COLUMNS, NODE), _own(prev[1], EDGE_COLUMNS, EDGE))
    gone = removed.select(F.col("path").alias("__path"))
    left = nodes.where("kind <> 'COMMIT'").withColumn("__path", F.col("location.path")).join(gone, "__path", "left_anti").drop("__path")
    nodes = snapshot.upsert(left, _own(fresh[0], NODE_COLUMNS, NODE), ["id"])
    edges = snapshot.upsert(edges, _own(fresh[1], EDGE_COLUMNS, EDGE), snapshot.EDGE_KEY)
    return add_scaffolding(nodes, snapshot.drop_dangling(nodes, edges)[0], github, branch, sha)


@dataclass
class Contracts:
    """The contracts of an input, each table with repo_id, branch and file."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def files(self) -> DataFrame:
        """repo_id, branch, file of all that any table names."""
        out = None
        for t in self.tables.values():
            one = t.select("repo_id", "branch", "file")
            out = one if out is None else out.union(one)
        return out.distinct()

    def merged(self, other: Contracts) -> Contracts:
        return Contracts({k: t.unionByName(other.tables[k]) for k, t in self.tables.items()})

    def without(self, removed: DataFrame) -> Contracts:
        """Without the rows of the removed files (path)."""
        return Contracts({k: t.join(removed.select(F.col("path").alias("file")), "file", "left_anti").select(*t.columns) for k, t in self.tables.items()})

    def replaced(self, fresh: Contracts) -> Contracts:
        """The fresh rows in place of all rows of their files."""
        named = fresh.files().select("file").distinct()
        return Contracts({k: t.join(named, "file", "left_anti").select(*t.columns).unionByName(fresh.tables[k]) for k, t in self.tables.items()})


def extract_contracts(files: DataFrame, spans: DataFrame) -> Contracts:
    """The contracts of code files (repo_id, branch, path, language, content) with the functions that they belong to, and evidence."""
    code = files.where("language is not null")
    return Contracts({"provides": rules.provides(code, spans), "consumes": rules.consumes(code, spans), "channels": rules.channels(code, spans), "resources": rules.resources(code, spans), "evidence": evidence.scan(files)})


@dataclass
class IndexRun:
    """What a run over one branch head found: its whole snapshot, the delta to it, contracts, statuses and dropped edges."""

    nodes: DataFrame
    edges: DataFrame
    delta: DataFrame
    contracts: Contracts
    statuses: DataFrame
    dangling: DataFrame


def index_files(files: DataFrame, github: str, branch: str, sha: str, prev: tuple[DataFrame, DataFrame] | None = None, removed: DataFrame | None = None, contracts: Contracts | None = None, base: str | None = None, allow: list[str] | None = None, analyzer: walker.Analyzer | None = None) -> IndexRun:
    """Index files (repo_id, branch, path, content) of a head.

    Without ``removed`` (paths that changed or went) the files are the whole head and replace all, though the delta is
    still one from the stored snapshot, so what is gone is deleted; with it, they are the changed files.
    """
    known = stored(detect_languages(files.where(~is_skipped(F.col("path")))), "index-files")
    facts = stored(walker.analyze(walker.allowed_languages(known, allow or []), analyzer), "index-facts")
    nodes, edges, _ = snapshot.normalize(walker.raw_symbols(facts, sha), walker.raw_relations(facts))
    nodes = stored(_own(nodes, NODE_COLUMNS, NODE), "index-nodes")
    sound, dangling = snapshot.drop_dangling(nodes, stored(_own(edges, EDGE_COLUMNS, EDGE), "index-edges"))
    if prev is not None and removed is not None:
        new = merge_incremental(prev, (nodes, stored(_own(edges, EDGE_COLUMNS, EDGE), "index-fresh")), removed, github, branch, sha)
    else:
        new = add_scaffolding(nodes, sound, github, branch, sha)
    new = stored(new[0], "index-new-nodes"), stored(new[1], "index-new-edges")
    delta = snapshot.maps_delta(prev, new, base, sha, COMPARED_NODE, COMPARED_EDGE)
    found = Contracts({k: stored(t, f"index-{k}") for k, t in extract_contracts(known, walker.functions(facts)).tables.items()})
    if contracts is not None and removed is not None:
        found = contracts.without(removed).replaced(found)
    return IndexRun(*new, delta, found, facts.where("fact = 'file'").select("repo_id", "branch", "path", "language", "status"), dangling)
