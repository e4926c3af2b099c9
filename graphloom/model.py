"""Schemas and vocabulary of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fixed wire values: kinds of nodes and of edges, mechanisms of contracts.
NODE_KINDS = (
    "ORGANIZATION", "REPOSITORY", "BRANCH", "COMMIT", "FILE", "PACKAGE", "MODULE", "CLASS", "INTERFACE", "FUNCTION", "METHOD", "SYMBOL", "VARIABLE", "API", "SERVICE", "DATABASE",
    "DEPLOYMENT_ENVIRONMENT", "DEPLOYMENT", "RELEASE", "ANALYZER_RUN", "TOPIC", "RESOURCE",
)
EDGE_KINDS = (
    "HAS_BRANCH", "POINTS_TO", "CONTAINS_STATE_OF", "DEFINED_IN", "CALLS", "REFERENCES", "IMPLEMENTS", "EXTENDS", "IMPORTS", "DEPENDS_ON", "EXPOSES", "CONSUMED_BY", "USES", "DEPLOYED_TO",
    "HAS_COMMIT", "HAS_FILE", "PART_OF", "CALLS_API", "PUBLISH_TO", "CONSUME_FROM", "READS_FROM", "WRITES_TO", "INVOKES", "CONNECTS_TO", "QUERIES",
)
MECHANISMS = ("rest", "grpc", "json_rpc", "websocket", "sse", "kafka", "rabbitmq", "sqs", "pubsub")
#: Fixed wire values: kinds that count as dependencies, in the order that queries follow.
DEPENDENCY_KINDS = (
    "DEPENDS_ON", "IMPORTS", "CALLS_API", "PUBLISH_TO", "CONSUME_FROM", "READS_FROM", "WRITES_TO", "INVOKES", "CONNECTS_TO", "QUERIES",
)
#: Edges between services and resources: they carry branch_pairs and pass the edge branch gate.
SERVICE_KINDS = ("CALLS_API", "PUBLISH_TO", "CONSUME_FROM", "READS_FROM", "WRITES_TO", "INVOKES", "CONNECTS_TO", "QUERIES")
#: Fixed wire values: kinds of symbols that questions name, and those whose state a commit contains.
SYMBOL_KINDS = ("FUNCTION", "METHOD", "CLASS", "INTERFACE", "MODULE", "PACKAGE", "VARIABLE", "SYMBOL", "API")

STATE_KINDS = ("FUNCTION", "METHOD", "CLASS", "INTERFACE", "MODULE", "PACKAGE", "VARIABLE", "SYMBOL")

PROVENANCE = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("source", "analyzer_version", "status", "detail", "recorded_at")])
)
LOCATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repository", "commit_sha", "path")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "start_column", "end_line", "end_column")]
    + [T.StructField("branch", T.StringType())]
)
PROPERTIES = T.MapType(T.StringType(), T.StringType())
NODE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kind", "name", "qualified_name", "language")]
    + [T.StructField("location", LOCATION), T.StructField("content_hash", T.StringType()), T.StructField("properties", PROPERTIES), T.StructField("provenance", PROVENANCE)]
)
EDGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "src", "dst", "content_hash")]
    + [T.StructField("properties", PROPERTIES), T.StructField("provenance", PROVENANCE), T.StructField("branch_pairs", T.ArrayType(T.StringType()))]
)
DEPLOYMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("environment", "repository", "commit_sha", "deployed_at", "status", "source", "release")])


def check_kind(kind: str) -> str:
    """The kind of a node in its wire spelling; anything else is an error."""
    if kind not in NODE_KINDS:
        raise ValueError(f"unknown kind of node: {kind}")
    return kind


def check_relation(kind: str) -> str:
    """The kind of an edge, which must be a token of upper-case letters, digits and underscores that is known."""
    if not kind or not kind[0].isalpha() or kind != kind.upper() or not kind.replace("_", "").isalnum():
        raise ValueError(f"not a token for an edge: {kind!r}")
    if kind not in EDGE_KINDS:
        raise ValueError(f"unknown kind of edge: {kind}")
    return kind
