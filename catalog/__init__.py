"""The registered queries: each operator on the given tables, with its SQL counterpart."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import (  # noqa: F401
    q_sources, q_functions, q_tokens, q_joins, q_distribution, q_sets, q_skills, q_recommend, q_report, q_labels, q_streams,
)
