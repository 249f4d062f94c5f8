"""All registered queries of the library's own operators, by the ids of the operator inventory."""

from docspark.plans import q_chat, q_rag, q_registry, q_sources, q_tasks, q_text, q_vector  # noqa: F401
from docspark.plans.register import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL", "query"]
