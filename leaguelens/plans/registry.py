"""Every registered query of the league engine and its DuckDB SQL."""

import importlib

from leaguelens.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _module in ("basics", "joins", "aggregates", "windows", "ingestion", "identity", "ratings", "features", "models", "lineups", "reports", "streams"):
    importlib.import_module(f"leaguelens.plans.{_module}")
