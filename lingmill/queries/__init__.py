"""The registered queries of the library's own operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from lingmill.queries.base import ORACLES, QUERIES
from lingmill.queries import association, extraction, kernel, lexica, prediction, refinement, texts  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
