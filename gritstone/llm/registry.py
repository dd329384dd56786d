"""Queries of the corpus operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gritstone.llm import exact_topk, fingerprints, mixing, near_dedup, ordinal_quality, packing, quotations, secret_ledger, url_vocabulary, warc_zstd

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_quotation_linking": quotations.query,
    "op3_warc_dictionary": warc_zstd.query,
    "op4_url_vocabulary": url_vocabulary.query,
    "op5_secret_ledger": secret_ledger.query,
    "op6_piecewise_fingerprints": fingerprints.query,
    "op7_odd_sketch_dedup": near_dedup.query,
    "op8_budget_mixing": mixing.query,
    "op9_exact_topk": exact_topk.query,
    "op10_ordinal_quality": ordinal_quality.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_quotation_linking": quotations.ORACLE,
    "op4_url_vocabulary": url_vocabulary.ORACLE,
    "op5_secret_ledger": secret_ledger.ORACLE,
    "op9_exact_topk": exact_topk.ORACLE,
}
