"""All named queries over the standard tables, and their SQL."""

from tidewell.plans import evaluation_queries, labelled_queries, metric_queries, predict_queries, rate_queries, score_queries, set_queries, source_queries, stream_queries, text_queries, topic_queries  # noqa: F401
from tidewell.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
