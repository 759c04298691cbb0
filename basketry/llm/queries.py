"""The queries of this subpackage and, where there is one, the same query in SQL."""

from basketry.llm import (
    conversation_repair,
    decontamination,
    jaccard_join,
    language,
    main_text,
    near_dedup,
    order_minhash,
    packing,
    periodic_runs,
    pii,
    pitman_yor,
    token_counts,
    toxicity,
)

MODULES = (
    pii,
    order_minhash,
    pitman_yor,
    token_counts,
    toxicity,
    decontamination,
    packing,
    jaccard_join,
    main_text,
    language,
    conversation_repair,
    near_dedup,
    periodic_runs,
)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
