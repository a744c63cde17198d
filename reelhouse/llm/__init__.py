"""Training-data operators: language mixtures, repeated spans, decontamination, host
reputation, near-duplicate joins, personal data, fuzzy lines, sharding, exact search, packing,
exact piece encoding, tokenizer alignment and dataset manifests. Nothing else in the package
imports this subpackage.

Each operator module holds the general operator and its thin ``opN_*`` query; ``queries()``
and ``oracle_sql()`` below collect them for the driver contract.
"""

from __future__ import annotations

from . import (bench_join, best_fit, fuzzy_lines, host_reputation, language_mix, merkle_manifest, ngram_join, piece_codec, pii_spans,
               repeated_spans, sampled_shards, token_alignment, topk_search)

MODULES = (language_mix, repeated_spans, bench_join, host_reputation, ngram_join, pii_spans, fuzzy_lines,
           sampled_shards, topk_search, best_fit, piece_codec, token_alignment,
           merkle_manifest)


def queries():
    """name -> builder(spark, sf_dir), from every operator module."""
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    """name -> DuckDB SQL, for the queries that SQL can express over whole tables."""
    out = {}
    for m in MODULES:
        out.update(m.ORACLES)
    return out
