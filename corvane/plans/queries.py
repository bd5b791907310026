"""All core queries by name."""

from __future__ import annotations

from corvane.plans import evaluation, graphs, logs, scores, search, segments, symbols, tables  # noqa: F401
from corvane.plans.registry import QUERIES  # noqa: F401
