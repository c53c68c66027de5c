"""Training-base checks (H23-H25) with oracles; model training in q_ml."""

from __future__ import annotations

from ..catalog import query, rw
from ..oracle import adapter as O
from ..oracle.adapter import rnd
from ..oracle.measures import share_of_all
from ..plans import training as T

_FULL = " AND ".join(f"{c} IS NOT NULL" for c in T.FEATURES)


#: One row per measured vehicle: which of the conditions of a training set it meets.
_FLAGS = f"""
, flags AS (FROM ok SELECT antriebsklasse, (gap_pct >= -50 AND gap_pct <= 900)::INT AS near, (gap_pct >= 0 AND gap_pct <= 2000)::INT AS near_plugin,
              ({_FULL})::INT AS whole, (anteil_elektrisch IS NOT NULL)::INT AS share, (grid_kwh IS NOT NULL)::INT AS grid)
"""


@query("completeness_cost", O.with_rw(_FLAGS + f"""FROM (FROM flags SELECT count() AS grundgesamtheit, sum(near)::BIGINT AS nach_ausreissergrenze, sum(near * whole)::BIGINT AS trainingsbasis)
SELECT *, {rnd('100 * trainingsbasis / grundgesamtheit', 2)} AS anteil_prozent"""))
def completeness_cost(spark, d):
    return T.completeness_cost(rw(spark, d))


@query("feature_missing", O.with_rw("\n" + "\nUNION ALL ".join(
    [f"SELECT '{c}' AS merkmal, count(*) FILTER (WHERE {c} IS NULL) AS fehlend FROM ok" for c in T.FEATURES] +
    [f"SELECT '{c} (auf 0 gesetzt)', count(*) FILTER (WHERE {c} IS NULL) FROM ok" for c in T.ZERO_FILLED])))
def feature_missing(spark, d):
    return T.feature_missing(rw(spark, d))


@query("filter_bias", O.with_rw(_FLAGS + f"""FROM (FROM flags SELECT antriebsklasse, sum(near)::BIGINT AS vorher, sum(near * whole)::BIGINT AS nachher GROUP BY ALL)
SELECT *, {share_of_all('vorher', 2)} AS anteil_vorher_pct, {share_of_all('nachher', 2)} AS anteil_nachher_pct WHERE vorher > 0"""))
def filter_bias(spark, d):
    return T.filter_bias(rw(spark, d))


@query("plugin_completeness", O.with_rw(_FLAGS + """FROM flags SELECT count() AS phev_gesamt, sum(near_plugin)::BIGINT AS nach_ausreissergrenze,
  count() - sum(share)::BIGINT AS ohne_e_anteil, count() - sum(grid)::BIGINT AS ohne_netzstrom,
  sum(near_plugin * whole * share * grid)::BIGINT AS trainingsbasis WHERE antriebsklasse = 'PHEV'"""))
def plugin_completeness(spark, d):
    return T.plugin_completeness(rw(spark, d))


# -- model workflow (L1-L7, G3) ---------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from ..functions import scalars as S  # noqa: E402
from ..plans import ml as ML  # noqa: E402
from ..session import materialize  # noqa: E402

SEED = 1234
SAMPLE_ROWS = 5_000      # the size of the sample query; nothing else is cut

_PHEV = f"antriebsklasse = 'PHEV' AND gap_pct BETWEEN 0 AND 2000 AND {_FULL} AND anteil_elektrisch IS NOT NULL AND grid_kwh IS NOT NULL"
_REST = f"gap_pct BETWEEN -50 AND 900 AND {_FULL}"


def _drawn(cols: list[str], where: str, strata: str | None, having: str = "") -> str:
    """Training rows with their rank in the draw (md5 of id and seed, then all columns)."""
    listed = ", ".join({"jahr": "jahr::VARCHAR AS jahr", "hubraum_cm3": "coalesce(hubraum_cm3, 0) AS hubraum_cm3",
                        "e_reichweite_km": "coalesce(e_reichweite_km, 0) AS e_reichweite_km"}.get(c, c) for c in cols)
    order = ", ".join(f"{c} NULLS FIRST" for c in ["vehicle_id", *cols, "gap_pct"])
    part = f"PARTITION BY {strata} " if strata else ""
    return f""", t AS (SELECT vehicle_id, {listed}, gap_pct FROM ok WHERE {where}),
drawn AS (SELECT *, row_number() OVER ({part}ORDER BY md5(coalesce(vehicle_id::VARCHAR, '') || ':{SEED}'), {order}) AS place,
            count(*) OVER ({part}) AS of_all FROM t),
cut AS (SELECT *, CASE WHEN place <= round(of_all * 0.7) THEN 'train' ELSE 'test' END AS split FROM drawn)"""


@query("sample_deterministic", O.with_rw(_drawn(ML.FEATURES_ALL, _REST, None) + f"""
SELECT vehicle_id, {', '.join(ML.FEATURES_ALL)}, gap_pct FROM drawn WHERE place <= {SAMPLE_ROWS}"""))
def sample_deterministic(spark, d):
    """A repeatable sample of the training rows."""
    return ML.deterministic_sample(ML.training_set(rw(spark, d)), "vehicle_id", SAMPLE_ROWS, SEED)


@query("training_unknown", O.with_rw(_drawn(ML.FEATURES_ALL, _REST, None) + """,
gaps AS (SELECT coalesce(CASE WHEN masse_kg % 7 <> 0 THEN antriebsklasse END, 'unbekannt') AS antriebsklasse, coalesce(CASE WHEN masse_kg % 11 <> 0 THEN land END, 'unbekannt') AS land FROM t)
SELECT antriebsklasse, land, count(*) AS n FROM gaps GROUP BY ALL"""))
def training_unknown(spark, d):
    """L3: training rows with missing categories, which become a category of their own."""
    t = ML.training_set(rw(spark, d))
    t = t.withColumn("antriebsklasse", F.when(F.col("masse_kg") % 7 != 0, F.col("antriebsklasse"))).withColumn("land", F.when(F.col("masse_kg") % 11 != 0, F.col("land")))
    return ML.fill_unknown(t).groupBy("antriebsklasse", "land").agg(F.count(F.lit(1)).alias("n"))


@query("split_stratified", O.with_rw(_drawn(ML.FEATURES_ALL, _REST, "antriebsklasse") + """
SELECT antriebsklasse, split, count(*) AS n, round(sum(gap_pct), 4) AS summe_gap FROM cut GROUP BY ALL"""))
def split_stratified(spark, d):
    """L4: exact 70/30 split per class, all training rows."""
    s = ML.exact_split(ML.training_set(rw(spark, d)), "vehicle_id", "antriebsklasse", 0.7, SEED)
    return s.groupBy("antriebsklasse", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gap_pct"), 4).alias("summe_gap"))


@query("split_random", O.with_rw(_drawn(ML.FEATURES_ALL, _REST, None) + """
SELECT split, count(*) AS n, round(sum(gap_pct), 4) AS summe_gap FROM cut GROUP BY ALL"""))
def split_random(spark, d):
    """L4: exact 70/30 split without strata, all training rows."""
    s = ML.exact_split(ML.training_set(rw(spark, d)), "vehicle_id", None, 0.7, SEED)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gap_pct"), 4).alias("summe_gap"))


def _fitted(feats: list[str], where: str, strata: str | None) -> str:
    """The model in SQL: design rows, normal equations, elimination by a recursion over pivots, prediction ``p``."""
    cats, nums = [c for c in feats if c in ML.CATEGORICAL], [c for c in feats if c not in ML.CATEGORICAL]
    dummies = ", ".join(f"list_transform(lv_{c}, lambda v: CASE WHEN {c} = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)" for c in cats)
    filled = ", ".join(f"coalesce({c}, 'unbekannt') AS {c}" for c in cats)
    return _drawn(feats, where, strata) + f""",
filled AS (SELECT * REPLACE ({filled}) FROM cut),
lv AS (SELECT {', '.join(f"list(DISTINCT {c} ORDER BY {c})[2:] AS lv_{c}" for c in cats)} FROM filled WHERE split = 'train'),
mo AS (SELECT {', '.join(f"avg({c}) AS m_{c}, sqrt(CASE WHEN avg({c} * {c}) > avg({c}) ** 2 THEN avg({c} * {c}) - avg({c}) ** 2 ELSE 1 END) AS s_{c}" for c in nums)}
       FROM (SELECT {', '.join(f"{c}::DOUBLE AS {c}" for c in nums)} FROM filled WHERE split = 'train')),
des AS (SELECT filled.*, flatten([[1.0::DOUBLE], {dummies}, [{', '.join(f"(({c} - m_{c}) / s_{c})::DOUBLE" for c in nums)}]]) AS x FROM filled, lv, mo),
xy AS (SELECT list_append(x, gap_pct::DOUBLE) AS v, len(x) AS k FROM des WHERE split = 'train'),
pr AS (SELECT i, j, k, sum(v[i] * v[j]) AS s FROM xy, unnest(range(1, k + 1)) a(i), unnest(range(i, k + 2)) b(j) GROUP BY i, j, k),
eq AS (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, s FROM pr UNION ALL SELECT j, i, s FROM pr WHERE i < j AND j <= k) GROUP BY i),
m0 AS (SELECT list(r ORDER BY i) AS m, (SELECT count(*) FROM xy) AS n FROM eq),
gj AS (SELECT 1 AS p, m, n, []::BOOLEAN[] AS dep FROM m0
  UNION ALL SELECT p + 1, CASE WHEN abs(m[p][p]) < {ML.LinearModel.SINGULAR} * n THEN m ELSE list_transform(m, lambda r, i: CASE WHEN i = p
      THEN list_transform(r, lambda v: v / r[p]) ELSE list_transform(r, lambda v, j: v - r[p] * m[p][j] / m[p][p]) END) END,
    n, list_append(dep, abs(m[p][p]) < {ML.LinearModel.SINGULAR} * n) FROM gj WHERE p <= len(m)),
coef AS (SELECT list_transform(m, lambda r, i: CASE WHEN dep[i] THEN 0.0 ELSE r[len(r)] END) AS b FROM gj WHERE p = len(m) + 1),
fit AS (SELECT des.*, list_dot_product(x, b) AS p, gap_pct AS y FROM des, coef)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_SCORES = f"""
SELECT count(*) AS n, {rnd('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 4)} AS r2, {rnd('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))', 4)} AS r2_adj,
  {rnd('avg(abs(y - p))', 4)} AS mae, {rnd('sqrt(sum((y - p) ** 2) / count(*))', 4)} AS rmse, {rnd('avg(p - y)', 4)} AS mittlere_abweichung,
  CASE WHEN count(*) FILTER (y = 0) = 0 THEN {rnd('avg(abs((y - p) / nullif(y, 0))) * 100', 3)} END AS mape, count(*) FILTER (y = 0) AS null_ist
FROM fit WHERE split = 'test'"""


def _predicted(spark, d, plugin):
    feats = ML.FEATURES_PHEV if plugin else ML.FEATURES_ALL
    t = ML.fill_unknown(ML.training_set(rw(spark, d), plugin=plugin))
    s = materialize(ML.exact_split(t, "vehicle_id", None if plugin else "antriebsklasse", 0.7, SEED))
    return ML.fit_linear(s.filter(F.col("split") == "train"), feats)(s)


def _scores(pred):
    s = ML.score(pred.filter(F.col("split") == "test"))
    return s.select("n", *[S.rnd(c, 4).alias(c) for c in ("r2", "r2_adj", "mae", "rmse", "mittlere_abweichung")], S.rnd("mape", 3).alias("mape"), "null_ist")


@query("linreg_metrics", _recursive(O.with_rw(_fitted(ML.FEATURES_ALL, _REST, "antriebsklasse") + _SCORES)))
def linreg_metrics(spark, d):
    """Model over all classes, scored on the whole test part."""
    return _scores(_predicted(spark, d, False))


@query("linreg_metrics_plugin", _recursive(O.with_rw(_fitted(ML.FEATURES_PHEV, _PHEV, None) + _SCORES)))
def linreg_metrics_plugin(spark, d):
    """Plug-in hybrids only, two more features."""
    return _scores(_predicted(spark, d, True))


@query("linreg_predictions", _recursive(O.with_rw(_fitted(ML.FEATURES_ALL, _REST, "antriebsklasse") + f"""
SELECT vehicle_id, antriebsklasse, gap_pct, {rnd('p', 3)} AS "Prediction (gap_pct)" FROM fit WHERE split = 'test'""")))
def linreg_predictions(spark, d):
    """Predictions on the test part, column 'Prediction (gap_pct)'."""
    return (_predicted(spark, d, False).filter(F.col("split") == "test")
            .select("vehicle_id", "antriebsklasse", "gap_pct", S.rnd("prediction", 3).alias("Prediction (gap_pct)")))


_ZERO = ["masse_kg", "leistung_kw", "fc_wltp", "co2_wltp"]


@query("linreg_identities", O.with_rw(_drawn(ML.FEATURES_ALL, _REST, "antriebsklasse") + f"""
SELECT antriebsklasse, split, count(*) AS n, count(*) AS vorhergesagt,
  split = 'train' OR NULL AS rest_mittel_null, {', '.join(f"split = 'train' OR NULL AS rest_{c}_null" for c in _ZERO)}
FROM cut GROUP BY ALL"""))
def linreg_identities(spark, d):
    """What makes a fit the least-squares fit: on the rows it is fitted on, residuals sum to zero within
    each class (a dummy each) and stay uncorrelated with each numeric feature over all of them. The fit takes
    the whole training part, however large. Every row of both parts has a prediction."""
    p = materialize(_predicted(spark, d, False).withColumn("r", F.col(ML.LABEL) - F.col("prediction")))
    train = p.filter(F.col("split") == "train")
    scale = train.agg(F.stddev_pop("r")).first()[0] or 1.0
    corr = train.agg(*[F.abs(F.corr("r", c)).alias(c) for c in _ZERO]).first()
    flag = F.col("split") == "train"
    return p.groupBy("antriebsklasse", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count("prediction").alias("vorhergesagt"), F.avg("r").alias("_m")).select(
        "antriebsklasse", "split", "n", "vorhergesagt", F.when(flag, F.abs("_m") < 1e-3 * scale).alias("rest_mittel_null"),
        *[F.when(flag, F.lit(corr[c] is None or corr[c] < 1e-3)).alias(f"rest_{c}_null") for c in _ZERO])
