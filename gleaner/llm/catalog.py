"""All queries of this package, and the pipeline over its operators."""

import corpus_pipeline
from gleaner.llm import queries_chat, queries_manifest, queries_sets, queries_text, queries_vectors, queries_web  # noqa: F401  (importing a module registers its queries)
from gleaner.llm.registry import ORACLES, QUERIES  # noqa: F401

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
