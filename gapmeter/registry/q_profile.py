"""Profile queries (E20-E26) with oracles."""

from __future__ import annotations

from ..catalog import query, raw
from ..operators import profile as P
from ..oracle import adapter as O
from ..oracle.adapter import rnd
from .q_gap import gap_pooled, _POOLED

FREQ_COLS = ["ms", "ft", "fm", "ct", "status", "version_file"]
TOP_COLS = ["mp", "mk", "it_code"]
TOP_N = 300
FILL_COLS = ["mp", "mh", "man", "mk", "cn", "m_kg", "mt", "ewltp", "ep_kw", "z_whkm", "erwltp", "dr", "fc"]
RANGE_COLS = ["m_kg", "mt", "ewltp", "ep_kw", "z_whkm", "erwltp", "fc"]

_STACK = " UNION ALL ".join(f"SELECT '{c}' AS spalte, CAST({c} AS VARCHAR) AS wert FROM raw"
                            for c in FREQ_COLS + TOP_COLS)


@query("frequency_table", O.with_raw(f""", long AS ({_STACK}),
g AS (SELECT spalte, wert, count(*) AS anzahl FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY spalte ORDER BY anzahl DESC, wert ASC NULLS FIRST) AS rn FROM g),
k AS (SELECT * FROM r WHERE spalte NOT IN ({', '.join(repr(c) for c in TOP_COLS)}) OR rn <= {TOP_N})
SELECT spalte, coalesce(nullif(wert, ''), '(leer)') AS wert, anzahl,
  {rnd('anzahl * 100.0 / sum(anzahl) OVER (PARTITION BY spalte)', 4)} AS prozent FROM k"""))
def frequency_table(spark, d):
    return P.frequency_table(raw(spark, d), FREQ_COLS, TOP_COLS, TOP_N)


@query("fill_rates", O.with_raw(", w AS (SELECT count(*) AS n, " + ", ".join(
    f"count({c}) AS {c}" for c in FILL_COLS) + " FROM raw),\n" + f"""l AS (UNPIVOT w ON {', '.join(FILL_COLS)}
  INTO NAME spalte VALUE belegt)
SELECT spalte, belegt, n - belegt AS fehlt, {rnd('belegt * 100.0 / n', 3)} AS prozent_belegt FROM l"""))
def fill_rates(spark, d):
    return P.fill_rates(raw(spark, d), FILL_COLS)


@query("value_ranges", O.with_raw(" UNION ALL ".join(
    f"SELECT '{c}' AS spalte, min({O.num(c)}) AS minimum, max({O.num(c)}) AS maximum, "
    f"{rnd('avg(' + O.num(c) + ')', 2)} AS mittelwert FROM raw" for c in RANGE_COLS)))
def value_ranges(spark, d):
    return P.value_ranges(raw(spark, d), RANGE_COLS)


@query("cross_table", O.with_raw(f"""
, g AS (SELECT ft, fm, count(*) AS anzahl, avg({O.num('ewltp')}) AS m1, avg({O.num('m_kg')}) AS m2 FROM raw GROUP BY ft, fm)
SELECT ft, fm, anzahl, {rnd('anzahl * 100.0 / sum(anzahl) OVER ()', 4)} AS prozent, {rnd('m1', 1)} AS avg_ewltp,
  {rnd('m2', 0)} AS avg_m_kg FROM g"""))
def cross_table(spark, d):
    return P.cross_table(raw(spark, d), "ft", "fm", "ewltp", "m_kg")


@query("quartile_class", O.with_rw(f"""
, p AS ({_POOLED}),
q AS (SELECT quantile_cont(gap_median_pct, 0.25) AS q1, quantile_cont(gap_median_pct, 0.75) AS q3 FROM p)
SELECT p.*, CASE WHEN gap_median_pct <= q1 THEN 'unteres Quartil' WHEN gap_median_pct >= q3 THEN 'oberes Quartil'
  ELSE 'Mitte' END AS quartil_klasse FROM p, q"""))
def quartile_class(spark, d):
    return P.quartile_class(gap_pooled(spark, d), "gap_median_pct")
