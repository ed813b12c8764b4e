"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from loomspark.llm import alignment, conversations, fingerprints, jaccard_join, lexical, mixing, packing, quality, simhash, token_counts, topk, toxicity, url_filters

_MODULES = (fingerprints, conversations, url_filters, jaccard_join, packing, toxicity, token_counts, mixing, topk, quality, simhash, alignment, lexical)


def queries() -> dict:
    import corpus_pipeline

    found = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    found = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
