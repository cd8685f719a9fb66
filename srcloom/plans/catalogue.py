"""All named queries."""

from srcloom.plans import (  # noqa: F401
    copybook_queries,
    history_queries,
    job_queries,
    pair_queries,
    prompt_queries,
    rewrite_queries,
    state_queries,
    stream_queries,
    structure_queries,
    tree_queries,
)
from srcloom.plans.registry import ORACLES, QUERIES  # noqa: F401
