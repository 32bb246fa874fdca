"""All registered queries and their SQL twins."""

from voltloom.catalog import analysis, anchors, answers, device, evaluation, few_cells, files, fleet, health, horizons, life, memory, sequence, state, tables  # noqa: F401
from voltloom.catalog.base import CATALOG

__all__ = ["CATALOG"]
