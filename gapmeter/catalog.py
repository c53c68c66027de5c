"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

One entry per inventory row group of SURVEY 7.3. Every query reads the given
tables (through the domain adapter) so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import core as C
from .plans import layers as L
from .sources import adapter as AD

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query and (optionally) its DuckDB oracle SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- shared inputs: the pipeline's layers ---------------------------------------
# raw -> core -> star are written once per session and input folder as Parquet
# tables below the shared checkpoint folder (the reference persists the same
# layers), so every mart reads a finished table instead of re-deriving it.

def base(spark, d):
    """Joined line items with derived keys: the one big join, written once."""
    return L.layer(spark, d, "base_rows", lambda: AD.base_slices(spark, d))


def raw(spark, d):
    return L.layer(spark, d, "raw_registration", lambda: AD.registration_raw(spark, d, base(spark, d)))


def _deduped(spark, d):
    """Passenger-car rows, one per (year, id) (F8), in slices by key. Rows are dealt out by key as joined rows and spelled out as raw
    ones behind the shuffle."""
    return (AD.spelled(x) for x in C.dedup_slices(AD.registration_keys(base(spark, d)), AD.registration_of))


def cars(spark, d):
    """The rows that the dedup step keeps, written once, for who looks at them."""
    return L.layer(spark, d, "cars_dedup", lambda: _deduped(spark, d))


def reg(spark, d):
    """Core: typed in the tasks that the dedup step keeps the rows in, and written once."""
    return L.layer(spark, d, "core_registration", lambda: (C.type_cars(x) for x in _deduped(spark, d)))


def rw(spark, d):
    return L.layer(spark, d, "core_realworld", lambda: AD.realworld(spark, d, base(spark, d)))




#: Focus countries of the parameter table.
FOCUS_COUNTRIES = [f"NATION_{i}" for i in (2, 3, 7, 11, 19, 23)]


def country_parameters(spark, d):
    from .plans import star as ST
    from .sources.tables import read_table
    return ST.country_parameters(read_table(spark, d, "nation"), read_table(spark, d, "region"), FOCUS_COUNTRIES)


def star_fact(spark, d):
    """Year-partitioned fact table (A19), written once."""
    from .plans import star as ST
    return L.layer(spark, d, "star_fact", lambda: ST.fact(reg(spark, d), {n: star_dim(spark, d, n) for n in ST.NATURAL}, stable=True),
                   partition_by=["jahr"])


def star_dim(spark, d, name):
    """A dimension with its keys, written once."""
    from .plans import star as ST
    build = {"manufacturer": ST.dim_manufacturer, "model": ST.dim_model, "powertrain": ST.dim_powertrain,
             "country": lambda r: ST.dim_country(r, country_parameters(spark, d))}[name]
    return L.layer(spark, d, f"star_dim_{name}", lambda: ST.keyed(name, build(reg(spark, d))))


def mart_gap_by_year(spark, d):
    from .plans import gap as G
    return L.layer(spark, d, "mart_gap_by_year", lambda: G.gap_by_year(rw(spark, d)))


def mart_reversal(spark, d, min_vehicles=10):
    from .plans import gap as G
    return L.layer(spark, d, f"mart_reversal_{min_vehicles}", lambda: G.rank_reversal(rw(spark, d), None, min_vehicles))


def mart_mix(spark, d, build):
    return L.layer(spark, d, "mart_mix", build)


def mart_hourly(spark, d, build):
    return L.layer(spark, d, "mart_hourly", build)


# Importing the query modules fills QUERIES.
from .registry import (  # noqa: E402,F401
    q_scalars, q_gap, q_quality, q_star, q_joins, q_profile, q_grid, q_marts,
    q_wtw, q_makers, q_credit, q_training, q_misc, q_stream, q_files, q_corrections,
)
