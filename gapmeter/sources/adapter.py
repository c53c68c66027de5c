"""Domain adapter: the given TPC-H-style tables -> the reference's data model.

The reference ingests untyped registration files (every field text, with
comma decimals, blanks and junk), on-board-meter records and an hourly
generation series. The test tables carry none of that, so this module derives
them deterministically from keys (SURVEY 7.3). The same rules are written in
DuckDB SQL in ``gapmeter.oracle.adapter`` so both engines see identical input.

Scale notes: the derivation is one pass of equi-joins. ``orders`` is first
joined with its (smaller) customer/nation/region side, then ``lineitem``
joins that on the order key -- a single sort-merge shuffle of the two big
tables; ``part`` and ``supplier`` are joined by key: counted, broadcast up to
``BROADCAST_ROWS`` rows, otherwise shuffled (before the order join, while the
line items are narrow). Shuffles of line items end in as many partitions as
their count asks for, so no task's sort grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import slices
from .tables import read_table

# Code tokens cycled into the eco-innovation text; the last two
# are deliberately invalid (not whitelisted / odd length).
CODE_CYCLE = ["08", "28", "29", "32", "33", "35", "37", "38", "39", "82", "99", "7"]


#: Up to so many rows of a joined table are broadcast (a few dozen bytes each).
BROADCAST_ROWS = 1_500_000
#: Line items that a task of the order join gets.
ROWS_PER_TASK = 500_000


def base_join(spark: SparkSession, sf_dir: str, part: int = 0, of: int = 1) -> DataFrame:
    """One row per line item with its order, customer, nation, region, part, supplier. Of ``of`` slices by order key the
    ``part``-th, from 0."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    if of > 1:
        li, o = (t.filter(F.pmod(F.xxhash64(F.col(k).cast("long")), F.lit(of)) == part) for t, k in ((li, "l_orderkey"), (o, "o_orderkey")))
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    p = read_table(spark, sf_dir, "part")
    s = read_table(spark, sf_dir, "supplier")
    geo = (o.join(c, o.o_custkey == c.c_custkey)
           .join(n, c.c_nationkey == n.n_nationkey)
           .join(r, n.n_regionkey == r.r_regionkey))
    # Hash-distribute the line items on the order key. At scale this IS the
    # sort-merge join's exchange (the orders side is shuffled to match, no
    # extra pass); when orders is small enough to broadcast it still spreads
    # a few large input files over all cores instead of one task per file.
    # Both sides of this join grow with the data: never broadcast either, join
    # by key (sort-merge, spills instead of holding a build side in memory).
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(li.count() / ROWS_PER_TASK))
    sides, late = [(p, "p_partkey", "l_partkey"), (s, "s_suppkey", "l_suppkey")], []
    for side, key, to in sides:
        if side.count() <= BROADCAST_ROWS:
            late.append((side, key, to))
        else:
            li = li.repartition(pieces, F.col(to)).join(side.hint("merge"), F.col(to) == F.col(key))
    li = li.repartition(pieces, F.col("l_orderkey"))
    joined = li.join(geo.hint("merge"), li.l_orderkey == geo.o_orderkey)
    for side, key, to in late:
        joined = joined.join(F.broadcast(side), F.col(to) == F.col(key))
    return joined


_FM0 = ("CASE WHEN l_suppkey % 29 = 0 THEN NULL WHEN l_suppkey % 23 = 0 THEN 'F' "
        "ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'E' WHEN '2' THEN 'P' "
        "WHEN '3' THEN 'H' WHEN '4' THEN 'M' ELSE 'B' END END")
_FT0 = ("CASE WHEN l_partkey % 97 = 0 THEN 'hydrogen' WHEN fm0 = 'E' THEN 'electric' "
        "WHEN fm0 = 'P' THEN 'petrol/electric' WHEN l_returnflag = 'A' THEN 'petrol' "
        "WHEN l_returnflag = 'N' THEN 'diesel' ELSE 'lpg' END")

_MASS = "p_size * 40 + 500"


def _with_keys(df: DataFrame) -> DataFrame:
    return (df.withColumn("k", F.col("l_orderkey"))
            .withColumn("fm0", F.expr(_FM0))
            .withColumn("ft0", F.expr(_FT0))
            .withColumn("yr", F.year("o_orderdate"))
            .withColumn("mass", F.expr(_MASS)))


BASE_COLUMNS = ["k", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax", "o_orderdate", "o_orderpriority", "o_orderstatus",
                "c_custkey", "c_mktsegment", "n_name", "r_name", "p_partkey", "p_name", "p_brand", "p_size",
                "p_retailprice", "s_name", "fm0", "ft0", "yr", "mass"]


def base_rows(spark: SparkSession, sf_dir: str, part: int = 0, of: int = 1) -> DataFrame:
    """The joined line items with the derived keys -- computed once and shared
    by the registration and the meter derivation (one big join, not two)."""
    return _with_keys(base_join(spark, sf_dir, part, of)).select(*BASE_COLUMNS)


def base_slices(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """``base_rows`` in as many slices as the line items ask for, to be written one after the other."""
    of = slices(read_table(spark, sf_dir, "lineitem").count())
    return (base_rows(spark, sf_dir, part, of) for part in range(of))


def registration_raw(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """All-text registration staging table (A1 shape): comma decimals, blanks,
    junk words, mixed case, run-together code text, several date formats."""
    return spelled(registration_of(registration_keys(base if base is not None else base_rows(spark, sf_dir))))


#: What of a joined row the registration follows from.
REGISTRATION_COLUMNS = ["k", "l_linenumber", "l_partkey", "l_suppkey", "o_orderdate", "c_custkey", "c_mktsegment", "n_name",
                        "p_name", "p_brand", "p_size", "s_name", "fm0", "ft0"]
#: The row's vehicle class, as the registration has it.
_CLASS = ("CASE WHEN k % 17 = 0 THEN 'N1' WHEN k % 19 = 0 THEN '' WHEN k % 23 = 0 THEN NULL "
          "WHEN k % 7 = 0 THEN ' m1g' ELSE 'M1' END")


def registration_keys(base: DataFrame) -> DataFrame:
    """The joined rows with the registration's id and year, as numbers, and class: enough to filter and to deal rows out by key
    before ``registration_of`` spells out all the text but these two, and ``spelled`` these."""
    return base.selectExpr(*REGISTRATION_COLUMNS, "k * 10 + l_linenumber AS id", "yr AS jahr", f"{_CLASS} AS ct")


def spelled(b: DataFrame) -> DataFrame:
    """The registration with id and year as text, like all its fields."""
    return b.withColumns({c: F.col(c).cast("string") for c in ("id", "jahr")})


def registration_of(b: DataFrame) -> DataFrame:
    cyc = "array(" + ",".join(f"'{c}'" for c in CODE_CYCLE) + ")"
    c1 = f"element_at({cyc}, cast(l_partkey % 12 + 1 as int))"
    c2 = f"element_at({cyc}, cast(l_suppkey % 12 + 1 as int))"
    e = "concat('e', cast(k % 9 as string))"
    b = b.withColumn("mass", F.expr(_MASS))
    return b.selectExpr(
        "id",
        "CASE WHEN k % 9 = 0 THEN lower(n_name) ELSE n_name END AS ms",
        "CASE WHEN c_custkey % 5 < 2 THEN c_mktsegment WHEN c_custkey % 5 = 2 THEN '' END AS mp",
        "s_name AS mh",
        "p_brand AS man",
        "CASE WHEN k % 4 = 1 THEN lower(p_brand) ELSE p_brand END AS mk",
        "CASE WHEN k % 5 = 2 THEN upper(p_name) ELSE p_name END AS cn",
        f"{_CLASS} AS ct",
        "CASE WHEN k % 13 = 0 THEN 'n/a' WHEN k % 11 = 0 THEN '' "
        "WHEN k % 3 = 0 THEN replace(cast(cast(mass AS decimal(12,2)) AS string), '.', ',') "
        "WHEN k % 7 = 0 THEN concat(' ', cast(mass AS string), ' ') "
        "ELSE cast(cast(mass AS decimal(12,1)) AS string) END AS m_kg",
        "cast(mass + 100 AS string) AS mt",
        "CASE WHEN fm0 = 'E' THEN '0' ELSE concat(cast(60 + p_size * 3 AS string), "
        "CASE WHEN k % 3 = 0 THEN ',' ELSE '.' END, cast(l_partkey % 10 AS string)) END AS ewltp",
        "CASE WHEN k % 2 = 0 THEN upper(ft0) ELSE ft0 END AS ft",
        "CASE WHEN k % 6 = 5 THEN concat(' ', lower(fm0), ' ') ELSE fm0 END AS fm",
        "cast(p_size * 3 + 40 AS string) AS ep_kw",
        "CASE WHEN fm0 IN ('E', 'P') THEN cast(p_size * 4 + 120 AS string) END AS z_whkm",
        "CASE WHEN fm0 = 'E' THEN NULL ELSE concat(cast(4 + p_size div 5 AS string), '.', "
        "cast(p_size % 5 * 2 AS string)) END AS fc",
        f"CASE k % 4 WHEN 0 THEN concat({e}, ' ', {c1}, ' ', {c2}) "
        f"WHEN 1 THEN concat({e}, ' ', {c1}, {c2}) "
        f"WHEN 2 THEN concat({e}, {c1}, '  ', {c2}) END AS it_code",
        "CASE WHEN k % 4 < 3 THEN concat(cast(l_linenumber AS string), ',', "
        "cast(l_partkey % 10 AS string)) END AS erwltp",
        "CASE WHEN k % 37 = 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') "
        "WHEN k % 5 = 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:00') "
        "ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS dr",
        "jahr",
        "CASE WHEN jahr >= 2000 THEN 'P' ELSE 'F' END AS status",
        "concat('co2cars_', cast(jahr AS string), CASE WHEN jahr >= 2000 THEN 'P' ELSE 'F' END, "
        "'v', cast(jahr % 7 + 10 AS string)) AS version_file",
        "CASE WHEN k % 8 = 3 THEN '' ELSE concat('e', cast(l_partkey % 50 AS string), '*', cast(l_suppkey % 9 AS string)) END AS tan",
        "concat('T', cast(l_partkey % 30 AS string)) AS typ",
        "cast(l_suppkey % 6 AS string) AS va",
        "CASE WHEN k % 10 <> 7 THEN cast(l_linenumber AS string) END AS ve",
        "CASE WHEN k % 21 = 0 THEN 'unbek.' WHEN fm0 = 'E' THEN '0' ELSE concat(cast(50 + p_size * 3 AS string), '.', cast(l_partkey % 10 AS string)) END AS enedc",
        "CASE WHEN k % 33 = 0 THEN '' ELSE concat(cast(2500 + p_size * 10 AS string), CASE WHEN k % 2 = 0 THEN ',5' ELSE '' END) END AS w_mm",
        "CASE WHEN fm0 = 'E' THEN NULL ELSE cast(p_size * 50 + 900 AS string) END AS ec_cm3",
        "CASE WHEN k % 101 = 0 THEN '2' WHEN k % 103 <> 0 THEN '1' END AS r_count",
    )


def realworld(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Typed on-board-meter table (core.realworld shape), one row per vehicle.

    Measures: lab l/100 km from the part price, lifetime fuel and distance
    from price and quantity, electric distance and grid energy for plug-ins.
    """
    from ..plans.core import type_realworld  # local import: plans depend on sources
    b = base if base is not None else base_rows(spark, sf_dir)
    src = b.selectExpr(
        "concat(cast(k AS string), '-', cast(l_linenumber AS string)) AS vehicle_id",
        "n_name AS country", "r_name AS region", "cast(yr AS string) AS jahr_txt",
        "o_orderstatus AS data_source", "s_name AS mh", "p_brand AS mk", "p_name AS cn",
        "cast(mass AS double) AS m_kg", "cast(mass + 100 AS double) AS mt",
        "cast(p_size * 50 + 900 AS double) AS ec_cm3", "cast(p_size * 3 + 40 AS double) AS ep_kw",
        "CASE WHEN k % 2 = 0 THEN upper(ft0) ELSE ft0 END AS ft", "fm0 AS fm",
        "CASE WHEN fm0 = 'E' THEN cast(0 AS double) "
        "ELSE cast(600 + p_size * 30 + p_partkey % 10 AS double) / 10 END AS ewltp",
        "CASE WHEN fm0 = 'E' THEN NULL WHEN fm0 = 'P' THEN p_retailprice / 1000 "
        "ELSE p_retailprice / 100 END AS wltp_fc",
        "CASE WHEN fm0 IN ('E', 'P') THEN cast(p_size * 4 + 120 AS double) END AS z_whkm",
        "CASE WHEN fm0 IN ('E', 'P') THEN cast(p_size * 2 + 30 AS double) END AS e_range_km",
        "CASE WHEN fm0 = 'E' THEN cast(0 AS double) ELSE l_extendedprice / 100 END AS fuel_total_l",
        "l_quantity * 100 AS dist_total_km",
        "CASE WHEN fm0 = 'P' THEN l_quantity * 100 * l_discount * 8 END AS dist_cd_off_km",
        "CASE WHEN fm0 = 'P' THEN l_tax * 10000 END AS grid_energy_kwh",
        "CASE WHEN k % 50 = 0 THEN NULL WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS used_in_calc",
    )
    return type_realworld(src)


def generation_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly generation series in long form (instant x carrier, MWh) from
    ``events``: the hour bucket is the instant, the event type the carrier,
    the summed value the energy. Partial aggregation happens map-side."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("zeitpunkt"),
                       F.col("event_type").alias("traeger"))
            .agg(F.sum("value").alias("mwh")))
