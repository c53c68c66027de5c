"""Join-semantics queries (D3, D4, D12, D15, D16, D17, A16) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import mart_gap_by_year, query, raw, reg
from ..functions import arrays as A
from ..operators.quality import counts_row
from ..oracle import adapter as O
from ..plans import gap as G
from ..plans import star as ST
from ..catalog import rw
from .q_gap import _BY_YEAR_CTE, _POOLED


@query("null_safe_join", O.with_reg("""
, dm AS (SELECT DISTINCT mp_pool, mh_name, man_name, mp_pool IS NOT NULL AS ist_gepoolt FROM reg)
SELECT ist_gepoolt, count(*) AS n FROM reg r JOIN dm ON r.mp_pool IS NOT DISTINCT FROM dm.mp_pool
  AND r.mh_name IS NOT DISTINCT FROM dm.mh_name AND r.man_name IS NOT DISTINCT FROM dm.man_name GROUP BY ist_gepoolt"""))
def null_safe_join(spark, d):
    """NULL-safe equality is an equi key in Spark (hash/sort-merge), not a nested loop."""
    r = reg(spark, d)
    dm = ST.dim_manufacturer(r).select(F.col("mp_pool").alias("p"), F.col("mh_name").alias("h"),
                                       F.col("man_name").alias("m"), "ist_gepoolt")
    j = r.join(dm, r.mp_pool.eqNullSafe(dm.p) & r.mh_name.eqNullSafe(dm.h) & r.man_name.eqNullSafe(dm.m))
    return j.groupBy("ist_gepoolt").agg(F.count(F.lit(1)).alias("n"))


@query("left_expected_actual", O.with_reg("""
, s AS (SELECT CAST(yr AS VARCHAR) AS jahr, n_name AS ms, count(*) AS soll FROM base GROUP BY ALL),
i AS (SELECT jahr, ms, count(*) AS n FROM raw GROUP BY ALL)
SELECT s.jahr, s.ms, s.soll, coalesce(i.n, 0) AS ist FROM s LEFT JOIN i ON i.jahr = s.jahr AND i.ms = s.ms"""))
def left_expected_actual(spark, d):
    """D3: expected vs actual, missing actual -> 0."""
    from .q_quality import _expected
    i = raw(spark, d).groupBy("jahr", "ms").agg(F.count(F.lit(1)).alias("n"))
    j = _expected(spark, d).join(i, ["jahr", "ms"], "left")
    return j.select("jahr", "ms", "soll", F.coalesce("n", F.lit(0)).alias("ist"))


@query("raw_vs_core_year", O.with_reg("""
SELECT r.jahr, r.n_raw, c.n_core FROM (SELECT jahr, count(*) AS n_raw FROM raw GROUP BY jahr) r
LEFT JOIN (SELECT jahr, count(*) AS n_core FROM reg GROUP BY jahr) c ON CAST(r.jahr AS INTEGER) = c.jahr"""))
def raw_vs_core_year(spark, d):
    """Text year key vs integer year key, joined through a cast."""
    r = raw(spark, d).groupBy("jahr").agg(F.count(F.lit(1)).alias("n_raw"))
    c = reg(spark, d).groupBy(F.col("jahr").alias("cj")).agg(F.count(F.lit(1)).alias("n_core"))
    return r.join(c, r.jahr.try_cast("int") == c.cj, "left").select("jahr", "n_raw", "n_core")


_WL = ", ".join(f"('{c}')" for c in A.ECO_CODE_WHITELIST)
_TOKENS = """tok AS (SELECT unnest(regexp_split_to_array(trim(it_code), '\\s+')) AS t FROM raw WHERE it_code IS NOT NULL)"""


@query("semi_whitelist", O.with_raw(f""", {_TOKENS}, wl AS (SELECT * FROM (VALUES {_WL}) v(code))
SELECT t AS code, count(*) AS n FROM tok WHERE t IN (SELECT code FROM wl) GROUP BY t"""))
def semi_whitelist(spark, d):
    """Tokens kept by a semi join against the whitelist table (broadcast, 10 rows)."""
    wl = spark.createDataFrame([(c,) for c in A.ECO_CODE_WHITELIST], "code string")
    t = raw(spark, d).filter(F.col("it_code").isNotNull()).select(
        F.explode(F.split(F.trim("it_code"), r"\s+")).alias("code"))
    return (t.join(F.broadcast(wl), "code", "left_semi").groupBy("code")
            .agg(F.count(F.lit(1)).alias("n")))


@query("anti_insert", O.with_raw(f""", {_TOKENS}, wl AS (SELECT * FROM (VALUES {_WL}) v(code)),
obs AS (SELECT DISTINCT t AS code FROM tok WHERE regexp_full_match(t, '[0-9]{{2}}'))
SELECT code, 'liste' AS quelle FROM wl UNION ALL
SELECT code, 'neu' FROM obs WHERE code NOT IN (SELECT code FROM wl)"""))
def anti_insert(spark, d):
    """Insert-if-absent -- observed two-digit codes not yet listed (left_anti), appended."""
    wl = spark.createDataFrame([(c,) for c in A.ECO_CODE_WHITELIST], "code string")
    obs = (raw(spark, d).filter(F.col("it_code").isNotNull())
           .select(F.explode(F.split(F.trim("it_code"), r"\s+")).alias("code"))
           .filter(F.col("code").rlike(r"\A[0-9]{2}\z")).distinct())
    new = obs.join(F.broadcast(wl), "code", "left_anti")
    return wl.withColumn("quelle", F.lit("liste")).unionByName(new.withColumn("quelle", F.lit("neu")))


@query("using_join", O.with_rw(f""", {_BY_YEAR_CTE}, p AS ({_POOLED})
SELECT land, antriebsklasse, jahr, y.median_gap_pct, p.gap_median_pct AS pooled_gap_pct
FROM by_year y JOIN p USING (land, antriebsklasse)"""))
def using_join(spark, d):
    """Yearly medians next to the pooled median, JOIN USING (country, class)."""
    y = mart_gap_by_year(spark, d).select("land", "antriebsklasse", "jahr", "median_gap_pct")
    p = G.gap_pooled(rw(spark, d)).select("land", "antriebsklasse", F.col("gap_median_pct").alias("pooled_gap_pct"))
    return y.join(p, ["land", "antriebsklasse"])


@query("scalar_subquery_diff", O.with_reg("""
SELECT (SELECT count(*) FROM raw) AS raw_zeilen, (SELECT count(*) FROM reg) AS core_zeilen,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM reg) AS differenz"""))
def scalar_subquery_diff(spark, d):
    """Uncorrelated scalar subqueries as one union + aggregate row."""
    j = counts_row(raw_zeilen=raw(spark, d), core_zeilen=reg(spark, d))
    return j.withColumn("differenz", F.col("raw_zeilen") - F.col("core_zeilen"))
