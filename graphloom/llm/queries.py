"""One query for each corpus operator, over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from .common import read_table


def op1_fingerprints(spark, sf_dir):
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    from .url_filter import filter_captures, stand_in_entries, stand_in_fetch_day
    from pyspark.sql import functions as F

    pages = read_table(spark, sf_dir, "pages")
    return filter_captures(pages.select("page_id", "url", stand_in_fetch_day(F.col("page_id")).alias("fetched")), stand_in_entries(pages))


def op3_toxicity(spark, sf_dir):
    from .toxicity import toxicity_report

    return toxicity_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_mix_sources(spark, sf_dir):
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_join(spark, sf_dir):
    from .ngram_join import ngram_join

    return ngram_join(read_table(spark, sf_dir, "documents"))


def op6_licenses(spark, sf_dir):
    from .licenses import license_report

    return license_report(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    from .decontaminate import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark, sf_dir):
    from .line_dedup import line_report

    return line_report(read_table(spark, sf_dir, "documents"))


def op9_token_store(spark, sf_dir):
    from .tokenstore import token_output

    return token_output(read_table(spark, sf_dir, "documents"))


def op10_secrets(spark, sf_dir):
    from .secrets import secret_report

    return secret_report(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_url_filter, op3_toxicity, op4_mix_sources, op5_ngram_join, op6_licenses, op7_decontaminate, op8_line_dedup, op9_token_store, op10_secrets,
    )
}


def _oracle_sql() -> dict[str, str]:
    from . import url_filter

    return {"op2_url_filter": url_filter.SQL}


ORACLE_SQL: dict[str, str] = _oracle_sql()
