"""Queries and SQL of the training-data operators and of the pipeline over them."""

from __future__ import annotations

from loomline.llm import exact_dedup, jaccard_join, kd_sharding, language_id, mixing, packing, quality, secrets, token_count, token_files

MODULES = (secrets, mixing, packing, token_files, exact_dedup, quality, jaccard_join, kd_sharding, language_id, token_count)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
