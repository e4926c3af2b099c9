"""Stable identities: SHA-256 over the non-empty parts joined by ``::``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical_id(*parts: Column) -> Column:
    return F.sha2(F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: x != ""), "::"), 256)


def symbol_id(language: Column, repo: Column, namespace: Column, container: Column, symbol: Column, signature: Column) -> Column:
    return canonical_id(language, repo, namespace, container, symbol, signature)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def topic_id(broker: Column, channel: Column) -> Column:
    return canonical_id(F.lit("topic"), F.lower(trimmed(broker)), F.lower(trimmed(channel)))


def resource_id(kind: Column, identity: Column) -> Column:
    return canonical_id(F.lit("resource"), F.lower(trimmed(kind)), F.lower(trimmed(identity)))


def scaffold_id(repo: Column, kind: str, key: Column) -> Column:
    """Ids of repository, branch, commit and file nodes."""
    return canonical_id(repo, F.lit(kind), key)
