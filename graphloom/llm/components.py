"""Connected components over links between long ids, by contraction (see ``operators.contract``).

Each step is an aggregation that is combined before its shuffle or a join of stored tables; they are written to the
shared folder, so a lost executor costs no more than a step. Nothing is collected but whether rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.contract import smallest_reachable

from .common import materialize


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """id, comp (smallest id reachable) for every id that ``links`` (a, b) names. No links: no rows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, f"{label}-edges")
    return smallest_reachable(both, lambda df, step: materialize(df, f"{label}-{step}"))
