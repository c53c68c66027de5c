"""What drives the gap: training sets, exact splits, linear model, scores.

* sample and 70/30 split follow one lottery: md5 of key and seed, ties by all
  columns. A row's rank is computed from prefix buckets (per-bucket counts ->
  offsets, in groups of groups -> a window inside (stratum, bucket)), so no stratum -- even one
  holding a third of all rows -- is sorted in one task;
* the model is least squares from sums of products (one aggregate over all training rows, which parts of the data
  add up to); its prediction is one expression, scored distributed.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import offsets
from .core import analysable

FEATURES_ALL = ["antriebsklasse", "land", "jahr", "masse_kg", "leistung_kw", "hubraum_cm3", "e_reichweite_km",
                "fc_wltp", "co2_wltp", "dist_total_km"]
FEATURES_PHEV = ["land", "jahr", "masse_kg", "leistung_kw", "hubraum_cm3", "e_reichweite_km", "fc_wltp",
                 "co2_wltp", "dist_total_km", "anteil_elektrisch", "grid_kwh"]
CATEGORICAL = ["antriebsklasse", "land", "jahr"]
LABEL = "gap_pct"


def training_set(rw: DataFrame, plugin: bool = False) -> DataFrame:
    """L1/L2: filtered, NULL-handled training rows, all of them."""
    df = analysable(rw)
    req = ["masse_kg", "leistung_kw", "fc_wltp", "co2_wltp", "dist_total_km"]
    if plugin:
        df = df.filter((F.col("antriebsklasse") == "PHEV") & F.col("gap_pct").between(0, 2000))
        req += ["anteil_elektrisch", "grid_kwh"]
    else:
        df = df.filter(F.col("gap_pct").between(-50, 900))
    for c in req:
        df = df.filter(F.col(c).isNotNull())
    cols = (FEATURES_PHEV if plugin else FEATURES_ALL)
    return df.select("vehicle_id", *[
        F.col("jahr").cast("string").alias("jahr") if c == "jahr" else
        F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in ("hubraum_cm3", "e_reichweite_km") else F.col(c)
        for c in cols], LABEL)


def draw(key: str, seed: int) -> Column:
    """A row's place in the lottery: md5 of key and seed, the same in every engine."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _with_place(df: DataFrame, key: str, strata: str | None, seed: int, rows_per_bucket: int = 10_000) -> DataFrame:
    """Adds _rank (1-based, in the order of the draw, ties by all columns) and _tot, per stratum.

    Buckets are prefixes of the draw, as long as the row count asks for: counts per
    (stratum, bucket) give offsets, a window finishes inside a bucket. Rows that are
    equal in every column are interchangeable."""
    digits = max(1, math.ceil(math.log(max(df.count(), 1) / rows_per_bucket, 16)))
    x = df.withColumn("_s", F.col(strata) if strata else F.lit("_all")).withColumn("_h", draw(key, seed))
    x = x.withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"))
    per = offsets(x.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_n")), ["_s"], "_b", "_n")
    tot = x.groupBy(F.col("_s").alias("_ts")).agg(F.count(F.lit(1)).alias("_tot"))
    per = per.join(tot, F.col("_s").eqNullSafe(F.col("_ts"))).select(F.col("_s").alias("_ps"), F.col("_b").alias("_pb"), "_off", "_tot")
    w = Window.partitionBy("_s", "_b").orderBy("_h", *df.columns)
    joined = x.withColumn("_in", F.row_number().over(w)).join(per, F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("_b") == F.col("_pb")))
    return joined.withColumn("_rank", F.col("_in") + F.col("_off")).drop("_s", "_h", "_b", "_ps", "_pb", "_in", "_off")


def deterministic_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows that the draw puts first (ties by all columns), found without a global sort."""
    return _with_place(df, key, None, seed).filter(F.col("_rank") <= n).drop("_rank", "_tot")


def fill_unknown(df: DataFrame, value: str = "unbekannt") -> DataFrame:
    """L3: missing strings -> 'unbekannt'."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.fillna(value, subset=strings)


def exact_split(df: DataFrame, key: str, strata: str | None, frac: float = 0.7, seed: int = 1234) -> DataFrame:
    """L4: column ``split`` = 'train' for exactly round(frac * n) rows of each
    stratum (or of all rows when ``strata`` is None), those that the draw puts first."""
    r = _with_place(df, key, strata, seed)
    return r.withColumn("split", F.when(F.col("_rank") <= F.round(F.col("_tot") * frac), "train").otherwise("test")).drop("_rank", "_tot")


def cross_sums(df: DataFrame, cats: list[str], cols: list[str]) -> DataFrame:
    """All that a linear model needs of its rows, one row per combination of categories (few by nature: classes,
    countries, years): count, sums and sums of products of ``cols``. One aggregate, combined map-side;
    parts of the data (days, partitions) add up, see ``merged``."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*cats).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
                                 *[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"p{i}_{j}") for i, j in pairs])


def merged(parts: list[DataFrame], cats: list[str]) -> DataFrame:
    """Sums of several parts of the rows as those of all."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy(*cats).agg(*[F.sum(c).alias(c) for c in whole.columns if c not in cats])


class LinearModel:
    """Least squares from ``cross_sums``: intercept, a dummy per category level but the first, standardised numbers.

    The normal equations are solved by elimination; a column that depends on those before it gets the coefficient 0."""

    SINGULAR = 1e-9

    def __init__(self, sums: list, cats: list[str], nums: list[str]):
        k = len(nums)  # the label follows them
        self.cats, self.nums = cats, nums
        self.levels = {c: sorted({r[c] for r in sums}) for c in cats}
        n = sum(r["n"] for r in sums)
        total = lambda name: sum(r[name] for r in sums)
        self.mean = np.array([total(f"s{i}") / n for i in range(k)])
        spread = np.array([total(f"p{i}_{i}") / n for i in range(k)]) - self.mean ** 2
        self.scale = np.sqrt(np.where(spread > 0, spread, 1.0))
        place, size = {}, 1
        for c in cats:
            for v in self.levels[c][1:]:
                place[c, v] = size
                size += 1
        full = np.zeros((size + k, size + k + 1))
        for r in sums:
            on = [0, *(place[c, r[c]] for c in cats if (c, r[c]) in place)]
            s = np.array([r[f"s{i}"] for i in range(k + 1)])
            p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k)]).reshape(k, k + 1)
            z = (s[:k] - r["n"] * self.mean) / self.scale
            zz = (p[:, :k] - np.outer(self.mean, s[:k]) - np.outer(s[:k], self.mean) + r["n"] * np.outer(self.mean, self.mean)) / np.outer(self.scale, self.scale)
            full[np.ix_(on, on)] += r["n"]
            full[on, size:size + k] += z
            full[size:, on] += z[:, None]
            full[size:, size:size + k] += zz
            full[on, -1] += s[k]
            full[size:, -1] += (p[:, k] - self.mean * s[k]) / self.scale
        dependent = np.zeros(len(full), bool)
        for i in range(len(full)):
            if abs(full[i, i]) < self.SINGULAR * n:
                dependent[i] = True
                continue
            full[i] /= full[i, i]
            other = np.arange(len(full)) != i
            full[other] -= np.outer(full[other, i], full[i])
        b = np.where(dependent, 0.0, full[:, -1])
        self.intercept, self.dummies, self.slopes = float(b[0]), {key: float(b[at]) for key, at in place.items()}, b[size:]

    def prediction(self) -> Column:
        """The model as an expression; a level that the training part lacks counts as the reference level."""
        out = F.lit(self.intercept)
        for c in self.cats:
            known = [x for v in self.levels[c][1:] for x in (F.lit(v), F.lit(self.dummies[c, v]))]
            if known:
                out = out + F.coalesce(F.try_element_at(F.create_map(*known), F.col(c)), F.lit(0.0))
        for c, m, s, b in zip(self.nums, self.mean, self.scale, self.slopes):
            out = out + (F.col(c) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(b))
        return out


def fit_linear(train: DataFrame, features: list[str], label: str = LABEL, fit_rows: int | None = None, seed: int = 1234):
    """Categoricals as dummies (the first level is the reference), numeric as is, with
    intercept. ``fit_rows`` bounds only the rows that the model is fitted on; split,
    prediction and scores use all rows. A level that the training part lacks is predicted
    with the reference level. Returns a function that adds ``prediction`` to a DataFrame."""
    rows = train if fit_rows is None else deterministic_sample(train, "vehicle_id", fit_rows, seed)
    cats = [c for c in features if c in CATEGORICAL]
    nums = [c for c in features if c not in CATEGORICAL]
    sums = cross_sums(rows, cats, [*nums, label]).collect()     # a row per combination of categories
    if not sums or not sum(r["n"] for r in sums):
        raise ValueError("no rows to fit on")
    model = LinearModel(sums, cats, nums)
    return lambda df: df.withColumn("prediction", model.prediction())


def score(pred: DataFrame, label: str = LABEL) -> DataFrame:
    """R², adjusted R² (the published scorer counts 0 predictors, so it equals R²), MAE,
    RMSE, mean signed difference, MAPE (NULL when an actual value is 0, with the count of
    such rows) -- one aggregate."""
    y, p = F.col(label), F.col("prediction")
    a = pred.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("_sse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.avg(p - y).alias("mittlere_abweichung"),
                 F.avg(F.abs((y - p) / F.nullif(y, F.lit(0.0)))).alias("_mape"),
                 F.count(F.when(y == 0, 1)).alias("null_ist"), F.var_pop(y).alias("_var"))
    r2 = 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))
    return a.select("n", r2.alias("r2"), r2.alias("r2_adj"), "mae", F.sqrt(F.try_divide(F.col("_sse"), F.col("n"))).alias("rmse"),
                    "mittlere_abweichung", F.when(F.col("null_ist") == 0, F.col("_mape") * 100).alias("mape"), "null_ist")
