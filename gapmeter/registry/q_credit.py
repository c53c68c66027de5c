"""Eco-credit queries (I18) with oracles."""

from __future__ import annotations

from ..catalog import query, reg
from ..oracle import adapter as O
from ..oracle.adapter import rnd
from ..oracle.measures import mean, measures, n, percent, quantile
from ..plans import credit as CR

FOCUS = "NATION_7"
#: Registrations of the focus country with the credit as a number, whether there is one, and CO2 per litre with and without it.
_ROWS = O.with_reg(f"""
, home AS (FROM reg SELECT *, ifnull(oeko_gutschrift, 0) AS credit, ifnull(oeko_gutschrift, 0) > 0 AS credited WHERE ms = '{FOCUS}'),
fuel AS (FROM home SELECT *, CASE WHEN credited THEN 'mit Gutschrift' ELSE 'ohne Gutschrift' END AS gruppe,
           100 * co2_wltp / verbrauch_l AS per_litre, 100 * (co2_wltp + credit) / verbrauch_l AS per_litre_full
         WHERE ft IN ('petrol', 'diesel') AND least(verbrauch_l, co2_wltp) > 0 AND verbrauch_l IS NOT NULL AND co2_wltp IS NOT NULL)
""")


@query("credit_adoption", _ROWS + measures(
    "home", ["jahr"], fahrzeuge=n(), mit_gutschrift=n("credited"), anteil_prozent=percent("credited", 1),
    mittlere_gutschrift_g_km=mean("oeko_gutschrift", 2, "credited"), groesste_gutschrift="max(oeko_gutschrift)"))
def credit_adoption(spark, d):
    return CR.adoption(reg(spark, d), FOCUS)


@query("credit_factor_mean", _ROWS + measures(
    "fuel", ["ft", "gruppe"], fahrzeuge=n(), gutschrift_g_km=mean("credit", 2), faktor_wie_gemeldet=mean("per_litre", 1),
    faktor_zurueckaddiert=mean("per_litre_full", 1)))
def credit_factor_mean(spark, d):
    return CR.factor_mean(reg(spark, d), FOCUS)


@query("credit_factor_median", _ROWS + measures(
    "fuel", ["ft", "gruppe"], fahrzeuge=n(), faktor_median=quantile("per_litre", 0.5, 1), faktor_median_zurueckaddiert=quantile("per_litre_full", 0.5, 1)))
def credit_factor_median(spark, d):
    return CR.factor_median(reg(spark, d), FOCUS)


@query("credit_size", _ROWS + measures(
    "home", ["antriebsklasse"], where="co2_wltp > 0", fahrzeuge=n(), co2_offiziell=mean("co2_wltp", 1), mittlere_gutschrift=mean("credit", 2),
    anteil_prozent=rnd("100 * sum(credit) / sum(co2_wltp)", 2)))
def credit_size(spark, d):
    return CR.credit_size(reg(spark, d), FOCUS)
