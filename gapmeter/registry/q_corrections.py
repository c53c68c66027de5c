"""Corrections of provisional years: change sets, marts kept up to date, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query, reg, star_dim
from ..operators import changes as CH
from ..oracle import adapter as O
from ..plans import layers as L
from ..plans import marts as M
from ..sources.tables import read_table
from ..streaming import incremental as INC
from .q_marts import _MIX
from .q_star import star

#: Years whose first version is provisional.
PROVISIONAL_FROM = 2000


def _final(spark, d) -> DataFrame:
    return M.mix_cells(reg(spark, d), star_dim(spark, d, "country"))


def _provisional(spark, d) -> DataFrame:
    """The version before: some rows are missing yet, some have another CO2 value, some will be withdrawn."""
    f = _final(spark, d)
    open_ = F.col("jahr") >= PROVISIONAL_FROM
    hit = lambda n: open_ & (F.col("src_id") % n == 0)
    kept = f.filter(~hit(11)).withColumn("co2_wltp", F.when(hit(13), F.col("co2_wltp") + 1).otherwise(F.col("co2_wltp")))
    gone = f.filter(hit(17)).withColumn("src_id", -F.col("src_id") - 1)
    return kept.unionByName(gone)


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both versions as stored tables."""
    return L.layer(spark, d, "version_1", lambda: _provisional(spark, d)), L.layer(spark, d, "version_2", lambda: _final(spark, d))


@query("year_changes", O.with_reg(f"""
SELECT jahr, src_id, 'neu' AS art FROM reg WHERE jahr >= {PROVISIONAL_FROM} AND src_id % 11 = 0
UNION ALL SELECT jahr, src_id, 'geaendert' FROM reg WHERE jahr >= {PROVISIONAL_FROM} AND src_id % 13 = 0 AND src_id % 11 <> 0 AND co2_wltp IS NOT NULL
UNION ALL SELECT jahr, -src_id - 1, 'entfallen' FROM reg WHERE jahr >= {PROVISIONAL_FROM} AND src_id % 17 = 0"""))
def year_changes(spark, d):
    """Keys that a final version adds, withdraws or changes."""
    old, new = _versions(spark, d)
    return CH.change_set(old, new, ["jahr", "src_id"])


@query("year_changes_summary", O.with_reg(f"""
SELECT jahr, count(*) FILTER (src_id % 11 = 0) AS neu, count(*) FILTER (src_id % 13 = 0 AND src_id % 11 <> 0 AND co2_wltp IS NOT NULL) AS geaendert,
  count(*) FILTER (src_id % 17 = 0) AS entfallen FROM reg WHERE jahr >= {PROVISIONAL_FROM} GROUP BY jahr
HAVING count(*) FILTER (src_id % 11 = 0 OR src_id % 17 = 0 OR (src_id % 13 = 0 AND co2_wltp IS NOT NULL)) > 0"""))
def year_changes_summary(spark, d):
    """The change set per year, as a load report."""
    c = year_changes(spark, d)
    return c.groupBy("jahr").agg(*[F.count(F.when(F.col("art") == a, 1)).alias(a) for a in (CH.ADDED, CH.CHANGED, CH.REMOVED)])


@query("mix_maintained", star(_MIX + "\nSELECT * FROM mix"))
def mix_maintained(spark, d):
    """A1 over the provisional version, brought to the final one by differences of sums; equals the rebuild."""
    old, new = _versions(spark, d)
    by, measures = [*M.MIX_CELL, "data_status"], ["co2_wltp", "masse_kg"]
    cells = L.layer(spark, d, "mix_cells_1", lambda: CH.partial_sums(old, by, measures))
    return M.powertrain_mix_of_cells(CH.maintain(cells, old, new, ["jahr", "src_id"], by, measures))


_DELIVERY = "least(3, ((month(ts) - 1) // 3)) + CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END"


@query("stream_late_rows", f"""
WITH e AS (SELECT *, {_DELIVERY} AS lieferung FROM events),
m AS (SELECT lieferung, max(ts) AS bis FROM e GROUP BY lieferung),
s AS (SELECT lieferung, max(bis) OVER (ORDER BY lieferung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grenze FROM m)
SELECT date_trunc('hour', ts) AS fenster_start, event_type, {O.rnd('sum(value)', 6)} AS summe, count(*) AS n,
  count(*) FILTER (ts < grenze - INTERVAL 2 HOUR) AS n_spaet
FROM e JOIN s ON e.lieferung = s.lieferung GROUP BY ALL""")
def stream_late_rows(spark, d):
    """Deliveries in order, a few rows come with the next one: they correct earlier hours and are counted as late."""
    quarter = F.least(F.lit(3), F.floor((F.month("ts") - 1) / 3))
    e = read_table(spark, d, "events").withColumn("lieferung", (quarter + F.when(F.col("event_id") % 20 == 0, 1).otherwise(0)).cast("int"))
    stage, sink, ck = (INC.scratch(spark, x) for x in ("stage-late", "sink-late", "ckpt-late"))
    e.write.partitionBy("lieferung").parquet(stage)
    for k in range(5):  # each run takes what has come since, as a timer would start it
        one = spark.read.parquet(stage).filter(F.col("lieferung") == k).drop("lieferung")
        one.coalesce(1).write.mode("append").parquet(f"{stage}-in")
        src = INC.file_stream(spark, f"{stage}-in", one.schema)
        INC.run_batches(src.withColumn("ts", F.col("ts").cast("timestamp")), sink, ck, INC.hourly_with_late("ts", "event_type", "value", 2))
    return INC.hourly_totals(spark.read.parquet(sink), "event_type")
