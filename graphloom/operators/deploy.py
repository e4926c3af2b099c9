"""Deployment records as graph facts, and the state that they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import canonical_id, scaffold_id


def environment_id(name: Column) -> Column:
    return canonical_id(F.lit("deployment-environment"), name)


def deployment_id() -> Column:
    return canonical_id(F.col("repository"), F.lit("deployment"), F.col("environment"), F.concat_ws("@", "commit_sha", "deployed_at"))


def environment_nodes(records: DataFrame, environments: DataFrame | None = None) -> DataFrame:
    """id, kind, name, is_production: one node for each name; declared ones (name, is_production, seq) first, others are no production."""
    implicit = records.select(F.col("environment").alias("name"), F.lit(False).alias("is_production"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("seq"))
    every = implicit if environments is None else implicit.union(environments.select("name", "is_production", F.lit(0), F.col("seq").cast("long")))
    named = every.groupBy("name").agg(F.min_by("is_production", F.struct("o", "seq")).alias("is_production"))
    return named.select(environment_id(F.col("name")).alias("id"), F.lit("DEPLOYMENT_ENVIRONMENT").alias("kind"), "name", "is_production")


def deployment_nodes(records: DataFrame) -> DataFrame:
    """id, kind, name, qualified_name, properties of every deployment, once."""
    pairs = [(c, F.col(c)) for c in ("repository", "environment", "commit_sha", "deployed_at", "status", "source", "release") if c in records.columns]
    props = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    name = F.concat_ws("@", "repository", "environment")
    rows = records.select(deployment_id().alias("id"), F.lit("DEPLOYMENT").alias("kind"), name.alias("name"), F.concat_ws(":", name, "commit_sha").alias("qualified_name"), props.alias("properties"))
    return rows.groupBy("id", "kind", "name", "qualified_name").agg(F.max_by("properties", F.to_json("properties")).alias("properties"))


def deployment_facts(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, name) and (edges DEPLOYED_TO: commit to environment, with status, deployed_at, release)."""
    env, commit = environment_id(F.col("environment")), scaffold_id(F.col("repository"), "commit", F.col("commit_sha"))
    nodes = environment_nodes(records).select("id", "kind", "name").union(deployment_nodes(records).select("id", "kind", "name"))
    edges = records.select(F.lit("DEPLOYED_TO").alias("kind"), commit.alias("src"), env.alias("dst"), "environment", "repository", "commit_sha", "status", "deployed_at", "release").distinct()
    return nodes, edges


def deployment_delta(records: DataFrame, environments: DataFrame | None = None) -> DataFrame:
    """Ops (phase, op, entity, kind, a, b) that create environments, deployments and their edges."""
    null = F.lit(None).cast("string")
    node = lambda df: df.select(F.lit(0).alias("phase"), F.lit("CREATE").alias("op"), F.lit("node").alias("entity"), null.alias("kind"), F.col("id").alias("a"), null.alias("b"))
    _, edges = deployment_facts(records)
    ties = edges.select(F.lit(1).alias("phase"), F.lit("CREATE").alias("op"), F.lit("edge").alias("entity"), "kind", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return node(environment_nodes(records, environments)).union(node(deployment_nodes(records))).union(ties)


def deployment_state(records: DataFrame, repository: str, environment: str) -> DataFrame:
    """commit_sha, status, deployed_at, release of a repository's deployments to an environment of exactly that name."""
    return records.where((F.col("repository") == repository) & (F.col("environment") == environment)).select("commit_sha", "status", "deployed_at", "release").distinct()


def current_deployments(records: DataFrame) -> DataFrame:
    """The last record of each repository and environment."""
    last = F.max_by(F.struct("commit_sha", "status", "deployed_at"), F.struct("deployed_at", "commit_sha", "status"))
    return records.groupBy("repository", "environment").agg(last.alias("r"), F.count(F.lit(1)).alias("deployments")).select("repository", "environment", "r.*", "deployments")
