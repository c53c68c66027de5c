"""Grid-mix queries (I1, I2, H22, E25, B17, A14) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..oracle.adapter import rnd
from ..plans import gridmix as GM
from ..sources.adapter import generation_long
from ..sources.tables import read_table

PROFILE_YEAR = 2024
MIN_POINTS = 500

_FACT_SQL = ", ".join(f"('{t}', {g}, {str(e).upper()})" for t, g, e in GM.FACTORS)
_LONG = f"""WITH long AS (SELECT date_trunc('hour', ts) AS zeitpunkt, event_type AS traeger, sum(value) AS mwh
   FROM events GROUP BY ALL),
fac AS (SELECT * FROM (VALUES {_FACT_SQL}) t(traeger, g_co2_je_kwh, erneuerbar)),
hourly AS (
  SELECT zeitpunkt, CAST(year(zeitpunkt) AS INTEGER) AS jahr, CAST(month(zeitpunkt) AS INTEGER) AS monat,
    CAST(hour(zeitpunkt) AS INTEGER) AS stunde, {rnd('sum(mwh)', 3)} AS erzeugung_mwh,
    {rnd('sum(mwh * g_co2_je_kwh)', 3)} AS emission_g_je_kwh_gewichtet,
    {rnd('sum(mwh * g_co2_je_kwh) / nullif(sum(mwh), 0)', 1)} AS g_co2_je_kwh,
    {rnd('100.0 * sum(mwh) FILTER (WHERE erneuerbar) / nullif(sum(mwh), 0)', 1)} AS anteil_erneuerbar_prozent
  FROM long JOIN fac USING (traeger) WHERE traeger <> '{GM.STORAGE}' GROUP BY zeitpunkt)
"""


def _hourly(spark, d):
    from ..sources.load import require_rows
    long = require_rows(generation_long(spark, d), "generation series")      # H17 guard
    return GM.hourly_intensity(long, GM.factor_table(spark))


@query("hourly_intensity", _LONG + "SELECT * FROM hourly")
def hourly_intensity(spark, d):
    return _hourly(spark, d)


@query("yearly_intensity", _LONG + f"""
SELECT jahr, count(*) AS stunden, {rnd('avg(g_co2_je_kwh)', 1)} AS mittel_g_kwh, {rnd('min(g_co2_je_kwh)', 1)} AS min_g_kwh,
  {rnd('max(g_co2_je_kwh)', 1)} AS max_g_kwh, {rnd('avg(anteil_erneuerbar_prozent)', 1)} AS erneuerbar_prozent,
  {rnd('sum(erzeugung_mwh) / 1e6', 4)} AS erzeugung_twh FROM hourly GROUP BY jahr""")
def yearly_intensity(spark, d):
    return GM.yearly_intensity(_hourly(spark, d))


@query("day_profile", _LONG + f"""
SELECT stunde, {rnd('avg(g_co2_je_kwh)', 1)} AS mittel_g_kwh, {rnd('avg(anteil_erneuerbar_prozent)', 1)} AS erneuerbar_prozent
FROM hourly WHERE jahr = {PROFILE_YEAR} GROUP BY stunde""")
def day_profile(spark, d):
    return GM.day_profile(_hourly(spark, d), PROFILE_YEAR)


@query("series_completeness", _LONG + f"""
SELECT traeger, min(zeitpunkt) AS erster, max(zeitpunkt) AS letzter, count(*) AS punkte,
  CASE WHEN count(*) >= {MIN_POINTS} THEN 'ok' ELSE 'unvollstaendig' END AS bewertung FROM long GROUP BY traeger""")
def series_completeness(spark, d):
    return GM.series_completeness(generation_long(spark, d), MIN_POINTS)


_RULES_SQL = ", ".join(f"('{t}', '{r}', {a}, {'NULL' if b is None else b})" for t, r, a, b in GM.RULES)


@query("series_plausibility", _LONG + f""",
rules AS (SELECT * FROM (VALUES {_RULES_SQL}) t(traeger, regel, a, b)),
p AS (SELECT traeger, count(*) AS werte, min(mwh) AS mn, max(mwh) AS mx, avg(mwh) AS mit,
        count(*) FILTER (WHERE mwh = 0) / count(*) AS nul, max(mwh) / greatest(1.0, min(mwh)) AS sp
      FROM long WHERE mwh IS NOT NULL GROUP BY traeger)
SELECT p.traeger, werte, {rnd('mn', 3)} AS min_mwh, {rnd('mx', 3)} AS max_mwh, {rnd('mit', 3)} AS mittel_mwh,
  {rnd('nul', 4)} AS nullanteil, {rnd('sp', 3)} AS spanne,
  CASE WHEN regel IS NULL THEN 'keine Regel'
       WHEN CASE regel WHEN 'spread_gt' THEN sp > a WHEN 'mean_between' THEN mit > a AND mit < b
                       WHEN 'min_gt' THEN mn > a WHEN 'min_lt' THEN mn < a
                       WHEN 'base_load' THEN nul < a AND mit > b END THEN 'ok' ELSE 'PRUEFEN' END AS bewertung
FROM p LEFT JOIN rules r ON r.traeger = p.traeger""")
def series_plausibility(spark, d):
    return GM.series_plausibility(generation_long(spark, d), GM.rule_table(spark))


@query("hour_year_parts", """
SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms, make_timestamp((epoch_us(ts) // 1000) * 1000) AS zeitpunkt,
  CAST(year(ts) AS INTEGER) AS jahr, CAST(month(ts) AS INTEGER) AS monat, CAST(hour(ts) AS INTEGER) AS stunde
FROM events""")
def hour_year_parts(spark, d):
    ev = read_table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"))
    return ev.select("event_id", "epoch_ms", *GM.epoch_ms_to_parts("epoch_ms"))


@query("half_open_range", """
SELECT event_type, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type""")
def half_open_range(spark, d):
    ev = read_table(spark, d, "events")
    return (ev.filter(GM.half_open(F.col("ts"), "2024-01-10 00:00:00", "2024-01-20 00:00:00"))
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
