"""All registered queries."""

from __future__ import annotations

from lineguard.plans import (  # noqa: F401
    corpus_queries,
    drift_queries,
    image_queries,
    log_queries,
    metric_queries,
    run_queries,
    stream_queries,
)
from lineguard.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
