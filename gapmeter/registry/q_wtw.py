"""Well-to-wheel queries (I13, I14, H19-H21) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import mart_hourly, query, reg, rw
from ..oracle import adapter as O
from ..oracle.adapter import rnd
from ..plans import gridmix as GM
from ..plans import layers as L
from ..plans import reconcile as R
from ..plans import wtw as W
from ..sources import load as LD
from ..sources.adapter import generation_long
from ..streaming.incremental import scratch
from .q_grid import _LONG

FOCUS = "NATION_7"
MIN_AGG = 20

_FF = ", ".join(f"('{k}', {g})" for k, g in W.FUEL_FACTORS)
_SC = ", ".join(f"('{n}', {a})" for n, a in W.SCENARIOS)


def _q(c):
    return f"quantile_cont(CAST({c} AS DOUBLE), 0.5)"


_WTW = f""",
{_LONG.replace('WITH ', '', 1)},
g AS (SELECT {rnd('avg(g_co2_je_kwh)', 1)} AS g_kwh FROM hourly),
ff AS (SELECT * FROM (VALUES {_FF}) t(kraftstoff, g_co2_je_l)),
sc AS (SELECT * FROM (VALUES {_SC}) t(s, a)),
r AS (SELECT * FROM rw WHERE land = '{FOCUS}' AND eea_verwendbar AND hat_mindestlauf AND antriebsklasse <> 'BEV'),
ftm AS (SELECT antriebsklasse, ft FROM (SELECT antriebsklasse, ft, row_number() OVER (PARTITION BY antriebsklasse
          ORDER BY count(*) DESC, ft) AS rn FROM r WHERE ft IS NOT NULL GROUP BY antriebsklasse, ft) WHERE rn = 1),
comb AS (SELECT r.antriebsklasse, count(*) AS fahrzeuge, {_q('fc_real')} AS fc_real, {_q('fc_wltp')} AS fc_wltp,
    {_q('co2_wltp')} AS co2_wltp, {_q('masse_kg')} AS masse_kg,
    {_q('CASE WHEN dist_total_km > 0 AND grid_kwh IS NOT NULL THEN grid_kwh / dist_total_km * 100 END')} AS kwh_je_100km,
    CAST(NULL AS DOUBLE) AS wh_je_km_wltp, {rnd('avg(g_co2_je_l)', 1)} AS faktor_g_je_l
  FROM r LEFT JOIN ff ON r.ft = ff.kraftstoff GROUP BY r.antriebsklasse),
basis AS (
  SELECT c.antriebsklasse, fahrzeuge, fc_real, fc_wltp, co2_wltp, masse_kg, kwh_je_100km, wh_je_km_wltp,
         m.ft AS ft_haeufigster, faktor_g_je_l, 'OBFCM gemessen' AS quelle_real
  FROM comb c LEFT JOIN ftm m ON m.antriebsklasse = c.antriebsklasse
  UNION ALL
  SELECT 'BEV', count(*), NULL, NULL, {_q('co2_wltp')}, {_q('masse_kg')}, NULL, {_q('strom_wh_km')},
         'electric', NULL, 'WLTP Laborwert'
  FROM reg WHERE ms = '{FOCUS}' AND antriebsklasse = 'BEV' AND strom_wh_km IS NOT NULL),
x AS (SELECT b.*, sc.s, sc.a, g.g_kwh,
    coalesce(fc_real, 0) * coalesce(faktor_g_je_l, 0) / 100 AS ex,
    coalesce(kwh_je_100km, 0) * g.g_kwh / 100 AS gp,
    coalesce(wh_je_km_wltp, 0) * sc.a * g.g_kwh / 1000 AS gb
  FROM basis b, sc, g),
wtw AS (SELECT antriebsklasse, fahrzeuge, quelle_real, ft_haeufigster, faktor_g_je_l,
    {rnd('masse_kg', 0)} AS masse_kg, {rnd('co2_wltp', 1)} AS co2_offiziell, {rnd('ex', 1)} AS co2_auspuff_real,
    {rnd('gp', 1)} AS co2_strom_phev, {rnd('gb', 1)} AS co2_strom_bev,
    {rnd("ex + gp + CASE WHEN antriebsklasse = 'BEV' THEN gb ELSE 0 END", 1)} AS co2_wtw_gesamt,
    s AS bev_szenario, CAST(a AS DOUBLE) AS bev_aufschlag, g_kwh AS strommix_g_kwh,
    {rnd('fc_real', 2)} AS fc_real, {rnd('kwh_je_100km', 1)} AS kwh_je_100km, {rnd('wh_je_km_wltp', 1)} AS wh_je_km_wltp
  FROM x)"""


def wsql(select):
    return O.with_all(_WTW + "\n" + select)


def _wtw(spark, d):
    """I13, written once: its readers (I14, H21) take the stored mart, as it takes the stored hourly one."""
    def build():
        hourly = mart_hourly(spark, d, lambda: GM.hourly_intensity(generation_long(spark, d), GM.factor_table(spark)))
        return W.scenarios(W.class_basis(rw(spark, d), reg(spark, d), W.fuel_factor_table(spark), FOCUS), W.grid_mean(hourly))
    return L.layer(spark, d, "mart_wtw", build)


@query("wtw_scenarios", wsql("SELECT * FROM wtw"))
def wtw_scenarios(spark, d):
    return _wtw(spark, d)


@query("wtw_fair", wsql(f"""
SELECT antriebsklasse, fahrzeuge, quelle_real, ft_haeufigster, faktor_g_je_l, masse_kg, co2_offiziell, co2_auspuff_real,
  CASE WHEN antriebsklasse = 'BEV' THEN co2_strom_bev ELSE co2_strom_phev END AS co2_strom, co2_wtw_gesamt,
  {rnd('co2_wtw_gesamt - co2_offiziell', 1)} AS differenz_zum_papier,
  {rnd('100.0 * (co2_wtw_gesamt - co2_offiziell) / nullif(co2_offiziell, 0)', 0)} AS abweichung_prozent
FROM wtw WHERE bev_szenario = 'mittel'"""))
def wtw_fair(spark, d):
    return W.fair_comparison(_wtw(spark, d))


@query("wtw_pivot", wsql("""
SELECT bev_szenario, max(co2_wtw_gesamt) FILTER (WHERE antriebsklasse = 'BEV') AS bev,
  max(co2_wtw_gesamt) FILTER (WHERE antriebsklasse = 'PHEV') AS phev,
  max(co2_wtw_gesamt) FILTER (WHERE antriebsklasse = 'ICE_BENZIN') AS benzin_rein,
  max(co2_wtw_gesamt) FILTER (WHERE antriebsklasse = 'ICE_DIESEL') AS diesel_rein,
  max(co2_wtw_gesamt) FILTER (WHERE antriebsklasse = 'HEV') AS hybrid
FROM wtw GROUP BY bev_szenario"""))
def wtw_pivot(spark, d):
    return W.scenario_pivot(_wtw(spark, d))


_GRID = ", ".join(f"({v})" for v in W.MIX_GRID)


@query("mix_break_even", wsql(f"""
, one AS (SELECT max(co2_auspuff_real) FILTER (WHERE antriebsklasse = 'PHEV') AS pa,
     max(kwh_je_100km) FILTER (WHERE antriebsklasse = 'PHEV') AS pk,
     max(co2_auspuff_real) FILTER (WHERE antriebsklasse = 'ICE_BENZIN') AS b FROM wtw WHERE bev_szenario = 'mittel'),
mix AS (SELECT CAST(g AS DOUBLE) AS g FROM (VALUES {_GRID}) t(g))
SELECT mix.g AS strommix_g_kwh, pa AS phev_auspuff, {rnd('pk * mix.g / 100', 1)} AS phev_strom,
  {rnd('pa + pk * mix.g / 100', 1)} AS phev_gesamt, b AS benzin_rein,
  CASE WHEN pa + pk * mix.g / 100 > b THEN 'PHEV schlechter' ELSE 'PHEV besser' END AS ergebnis
FROM one, mix"""))
def mix_break_even(spark, d):
    return W.break_even(_wtw(spark, d))


@query("wtw_consistency", wsql(f"""
SELECT {rnd('max(strommix_g_kwh)', 1)} AS verwendeter_mix_g_kwh,
  max(co2_auspuff_real) FILTER (WHERE antriebsklasse = 'PHEV' AND bev_szenario = 'mittel') AS phev_auspuff_haupttabelle,
  CASE WHEN max(strommix_g_kwh) BETWEEN 300 AND 450 THEN 'plausibel' ELSE 'PRUEFEN' END AS bewertung_mix FROM wtw"""))
def wtw_consistency(spark, d):
    return W.consistency(_wtw(spark, d))


# The official aggregate is a file of its own: written as the authority would, with deviations planted by the count of a
# cell -- 10 % more (every 7th), 1 % more (every 5th of the rest), cells it lacks (rest 3 of 11) and cells of a fuel nobody
# measured (rest 5 of 13) --, and read back as text.
_PLANT = "CASE WHEN n_fahrzeuge % 7 = 0 THEN 1.10 WHEN n_fahrzeuge % 5 = 0 THEN 1.01 ELSE 1 END"
STRANGE_FUEL = "wood gas"

_OFFICIAL = f""", agg AS (SELECT jahr, mh AS hersteller, ft AS kraftstoff, count(*) AS n_fahrzeuge, avg(fc_real) AS obfcm_fc,
   avg(fc_wltp) AS wltp_fc, avg(gap_pct) AS gap_fc_pct, avg(fc_real * co2_wltp / fc_wltp) AS obfcm_co2,
   avg(co2_wltp) AS wltp_co2 FROM rw WHERE ft IS NOT NULL GROUP BY ALL),
num AS (SELECT jahr, hersteller, kraftstoff, n_fahrzeuge, round(obfcm_fc * ({_PLANT}), 6) AS obfcm_fc, round(wltp_fc, 6) AS wltp_fc,
   round(gap_fc_pct, 6) AS gap_fc_pct, round(obfcm_co2, 6) AS obfcm_co2, round(wltp_co2, 6) AS wltp_co2 FROM agg),
off AS (SELECT * FROM num WHERE n_fahrzeuge % 11 <> 3
   UNION ALL SELECT * REPLACE ('{STRANGE_FUEL}' AS kraftstoff) FROM num WHERE n_fahrzeuge % 13 = 5 AND kraftstoff = 'petrol')"""


def _official(spark, d):
    """The official file, written once and read as text."""
    def build():
        rows = R.official_rows(rw(spark, d)).withColumn("obfcm_fc", F.col("obfcm_fc") * F.expr(_PLANT))
        strange = rows.filter("n_fahrzeuge % 13 = 5 AND kraftstoff = 'petrol'").withColumn("kraftstoff", F.lit(STRANGE_FUEL))
        path = scratch(spark, "text-official")
        R.as_text(rows.filter("n_fahrzeuge % 11 <> 3").unionByName(strange)).write.option("header", True).option("escape", '"').option("nullValue", "NULL").csv(path)
        return R.official_from_text(LD.read_null_word_csv(spark, path))
    return L.layer(spark, d, "official_aggregate", build)


@query("factor_backcheck", O.with_rw(_OFFICIAL + f"""
SELECT kraftstoff, count(*) AS gruppen, {rnd('avg(obfcm_co2 / nullif(obfcm_fc, 0) * 100)', 0)} AS faktor_aus_obfcm,
  {rnd('avg(wltp_co2 / nullif(wltp_fc, 0) * 100)', 0)} AS faktor_aus_wltp
FROM off WHERE n_fahrzeuge >= {MIN_AGG} GROUP BY kraftstoff"""))
def factor_backcheck(spark, d):
    return W.factor_backcheck(_official(spark, d), MIN_AGG)


@query("official_crosscheck", O.with_rw(_OFFICIAL + f"""
SELECT jahr, kraftstoff, CAST(sum(n_fahrzeuge) AS BIGINT) AS eea_fahrzeuge, {rnd('avg(gap_fc_pct)', 1)} AS eea_gap_pct,
  {rnd('avg(obfcm_fc)', 2)} AS eea_real_l, {rnd('avg(wltp_fc)', 2)} AS eea_wltp_l
FROM off WHERE n_fahrzeuge >= {MIN_AGG} GROUP BY jahr, kraftstoff"""))
def official_crosscheck(spark, d):
    return W.official_crosscheck(_official(spark, d), MIN_AGG)


_RECONCILED = _OFFICIAL + f""",
own AS (SELECT jahr, hersteller, kraftstoff, n_fahrzeuge AS eigen_n, obfcm_fc AS eigen_fc FROM agg),
j AS (SELECT coalesce(own.jahr, off.jahr) AS jahr, CASE WHEN eigen_n IS NULL THEN off.hersteller ELSE own.hersteller END AS hersteller,
   coalesce(own.kraftstoff, off.kraftstoff) AS kraftstoff, eigen_n, n_fahrzeuge AS amtlich_n, eigen_fc, obfcm_fc AS amtlich_fc,
   (obfcm_fc - eigen_fc) * 100 / nullif(eigen_fc, 0) AS dev
   FROM own FULL JOIN off ON own.jahr = off.jahr AND own.hersteller IS NOT DISTINCT FROM off.hersteller AND own.kraftstoff = off.kraftstoff),
u AS (SELECT *, CASE WHEN amtlich_n IS NULL THEN '{R.OWN_ONLY}' WHEN eigen_n IS NULL THEN '{R.OFFICIAL_ONLY}'
   WHEN dev IS NULL THEN CASE WHEN eigen_fc IS NOT DISTINCT FROM amtlich_fc THEN '{R.SAME}' ELSE '{R.FAR}' END
   WHEN abs(round(dev, 6)) <= 0.1 THEN '{R.SAME}' WHEN abs(round(dev, 6)) <= 5 THEN '{R.NEAR}' ELSE '{R.FAR}' END AS urteil,
   CAST(round(greatest(coalesce(eigen_n, 0), coalesce(amtlich_n, 0)) * abs(coalesce(amtlich_fc, 0) - coalesce(eigen_fc, 0)), 4) AS DECIMAL(28,4)) AS amount FROM j),
cells AS (SELECT jahr, hersteller, kraftstoff, eigen_n, amtlich_n, {rnd('eigen_fc', 3)} AS eigen_fc, {rnd('amtlich_fc', 3)} AS amtlich_fc,
   {rnd('dev', 2)} AS abweichung_prozent, urteil, {rnd('CAST(amount AS DOUBLE) * 100 / (SELECT CAST(sum(amount) AS DOUBLE) FROM u)', 4)} AS anteil_prozent FROM u)"""


@query("official_reconcile", O.with_rw(_RECONCILED + "\nSELECT * FROM cells"))
def official_reconcile(spark, d):
    """Every cell of either side with its verdict and its share of the difference."""
    return R.reconcile(R.own_cells(rw(spark, d)), _official(spark, d))


@query("official_verdicts", O.with_rw(_RECONCILED + f"""
SELECT urteil, count(*) AS zellen, CAST(coalesce(sum(eigen_n), 0) AS BIGINT) AS eigen_n, CAST(coalesce(sum(amtlich_n), 0) AS BIGINT) AS amtlich_n,
  {rnd('sum(anteil_prozent)', 2)} AS anteil_prozent FROM cells GROUP BY urteil"""))
def official_verdicts(spark, d):
    return R.verdicts(official_reconcile(spark, d))


@query("official_deviations", O.with_rw(_OFFICIAL + f"""
SELECT jahr, hersteller, kraftstoff, '{R.FAR}' AS urteil FROM agg WHERE n_fahrzeuge % 7 = 0 AND n_fahrzeuge % 11 <> 3 AND obfcm_fc > 0
UNION ALL SELECT jahr, hersteller, kraftstoff, '{R.NEAR}' FROM agg WHERE n_fahrzeuge % 5 = 0 AND n_fahrzeuge % 7 <> 0 AND n_fahrzeuge % 11 <> 3 AND obfcm_fc > 0
UNION ALL SELECT jahr, hersteller, kraftstoff, '{R.OWN_ONLY}' FROM agg WHERE n_fahrzeuge % 11 = 3
UNION ALL SELECT jahr, hersteller, '{STRANGE_FUEL}', '{R.OFFICIAL_ONLY}' FROM agg WHERE n_fahrzeuge % 13 = 5 AND kraftstoff = 'petrol'"""))
def official_deviations(spark, d):
    """A3: exactly the planted deviations, by their rule."""
    return official_reconcile(spark, d).filter(F.col("urteil") != R.SAME).select("jahr", "hersteller", "kraftstoff", "urteil")
