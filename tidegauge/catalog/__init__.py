"""All named queries."""

from tidegauge.catalog import (  # noqa: F401
    drift,
    jobs,
    operations,
    preparation,
    quality,
    store,
    streams,
    texts,
)
from tidegauge.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
