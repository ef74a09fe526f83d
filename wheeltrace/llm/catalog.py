"""Imports every operator module so that the registry is complete."""

from wheeltrace.llm import conversations, decontaminate, exact_dedup, fingerprints, html_text, langid, line_dedup, ngram_join, packing, spelling, token_counts, toxicity, warc  # noqa: F401
from wheeltrace.llm.registry import ORACLES, QUERIES  # noqa: F401
