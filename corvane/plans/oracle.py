"""DuckDB SQL for the core queries."""

from __future__ import annotations

from corvane.plans import queries  # noqa: F401
from corvane.plans.registry import SQL  # noqa: F401
