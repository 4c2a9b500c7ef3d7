"""All registered queries, by family."""

from askgrid.plans.registry import ORACLES, QUERIES
from askgrid.plans import reporting_joins, reporting_aggregates, reporting_scalars, retrieval, evaluation, corpus, guarded, catalogue, streamed

__all__ = ["ORACLES", "QUERIES"]


def flagship(spark, sf_dir):
    """Answer one question end to end: validated T-SQL run over the tables."""
    return QUERIES["guarded_segment_revenue"](spark, sf_dir)
