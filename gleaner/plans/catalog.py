"""All registered queries."""

from gleaner.plans import (  # noqa: F401  (importing a module registers its queries)
    queries_extract,
    queries_functions,
    queries_fuzzy,
    queries_jobs,
    queries_learning,
    queries_profile,
    queries_relational,
    queries_sources,
    queries_streaming,
    queries_structure,
    queries_text,
    queries_validation,
)
from gleaner.plans.registry import ORACLES, QUERIES  # noqa: F401
