"""Registering queries of the league engine with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from leaguelens.sources.league_view import League, league, sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, plain: bool = False):
    """Registers a function of a League; oracle: SQL after the league's expressions, or on its own if plain."""

    def add(f: Callable[[League], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(league(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle if plain else sql(oracle)
        return f

    return add
