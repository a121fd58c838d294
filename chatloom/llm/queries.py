"""Queries of this package, by name: each takes (spark, folder of tables) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from . import credentials, formatting, language, markup, packing, pages, pairs, pii, tokens, truncation


def _raw(run):
    return lambda spark, d: run(table(spark, d, "raw_corpus"))


def _docs(run):
    return lambda spark, d: run(table(spark, d, "documents"))


def _two(run, other):
    return lambda spark, d: run(table(spark, d, "raw_corpus"), table(spark, d, other))


def _prompt_groups(raw):
    return formatting.collapse(raw, "row_id", formatting.prompt_key(F.col("conversation"))).select("first_id", "n_copies")


QUERIES = {
    "p1_found": _two(formatting.found, "raw_payloads"),
    "p1_groups": _two(formatting.groups, "raw_payloads"),
    "p1_prompt_groups": _raw(_prompt_groups),
    "p2_found": _raw(markup.found_rows),
    "p2_clean": _raw(markup.clean_rows),
    "p2_differences": _raw(pages.message_differences),
    "p3_found": _raw(credentials.found_rows),
    "p3_redacted": _raw(credentials.redacted_rows),
    "p5_found": _two(language.found_rows, "enriched_records"),
    "p5_segments": _two(language.language_rows, "enriched_records"),
    "p6_found": _raw(pairs.found_rows),
    "p6_defects": _raw(pairs.counts),
    "p7_found": _raw(pii.found_rows),
    "p7_replaced": _raw(pii.replaced_rows),
    "p8_ids": _docs(tokens.encode),
    "p9_containers": _docs(packing.pack),
    "p9_fill": _docs(packing.fill),
    "p10_found": _docs(truncation.found),
    "p10_by_source": _docs(truncation.by_source),
}
