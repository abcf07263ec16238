"""Queries over the test tables: each module has QUERIES (name -> callable) and ORACLE (name -> SQL)."""

from __future__ import annotations

MODULES: tuple[str, ...] = ("text_functions", "filters_joins", "aggregates", "windows_topk", "grids", "rules", "sources_sinks")
