"""Remaining relational forms (E1, E2, E7, E17, E18, E27, D2, D14, G2, G4, G5, G7, A8, A11,
A20-A24, B10, B24, B26, B27, B33-B39, I21) with oracles where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import mart_gap_by_year, query, raw, reg, rw, star_dim, star_fact
from ..functions import scalars as S
from ..functions.scalars import rnd
from ..oracle.adapter import rnd as srnd
from ..oracle import adapter as O
from ..plans.core import analysable
from ..session import SMALL_GROUPS, ensure_checkpoint_dir, unsorted_writes
from ..sources import load as L
from ..sources.tables import read_table
from .q_gap import _BY_YEAR_CTE, _POOLED
from .q_star import star
from ..plans import gap as G

FOCUS = "NATION_7"
KM_PER_YEAR = 15000.0
PRICE_PER_L = 1.80
UF_ASSUMED = 84.0


@query("grouped_stats", O.with_reg(f"""
SELECT antriebsklasse, count(*) AS n, {srnd('sum(masse_kg)', 1)} AS summe_masse, {srnd('avg(co2_wltp)', 2)} AS avg_co2,
  min(co2_wltp) AS min_co2, max(co2_wltp) AS max_co2 FROM reg GROUP BY antriebsklasse"""))
def grouped_stats(spark, d):
    """Grouped count / sum / avg / min / max (partial aggregation map-side)."""
    return reg(spark, d).groupBy("antriebsklasse").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("masse_kg"), 1).alias("summe_masse"),
        rnd(F.avg("co2_wltp"), 2).alias("avg_co2"), F.min("co2_wltp").alias("min_co2"),
        F.max("co2_wltp").alias("max_co2"))


@query("global_stats", O.with_rw(f"""
SELECT count(*) AS n, {srnd('avg(gap_pct)', 2)} AS avg_gap, min(gap_pct) AS min_gap, max(gap_pct) AS max_gap,
  {srnd('stddev_pop(gap_pct)', 2)} AS sd_gap FROM ok"""))
def global_stats(spark, d):
    """One global aggregate row."""
    return analysable(rw(spark, d)).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("gap_pct"), 2).alias("avg_gap"), F.min("gap_pct").alias("min_gap"),
        F.max("gap_pct").alias("max_gap"), rnd(F.stddev_pop("gap_pct"), 2).alias("sd_gap"))


@query("fact_dim_stats", star(f"""
SELECT antrieb_label, count(*) AS n, {srnd('avg(co2_wltp)', 1)} AS avg_co2 FROM f GROUP BY antrieb_label"""))
def fact_dim_stats(spark, d):
    """Fact joined to one dimension for an analysis."""
    f = star_fact(spark, d).join(star_dim(spark, d, "powertrain").select("powertrain_sk", "antrieb_label"),
                                 "powertrain_sk")
    return f.groupBy("antrieb_label").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("co2_wltp"), 1).alias("avg_co2"))


@query("group_by_position", O.with_reg("""
SELECT coalesce(mp_pool, '(kein Pool)') AS pool, count(*) AS n FROM reg GROUP BY 1"""))
def group_by_position(spark, d):
    """Grouping by an expression."""
    return (reg(spark, d).groupBy(F.coalesce("mp_pool", F.lit("(kein Pool)")).alias("pool"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("text_min_max", O.with_reg("""
SELECT marke_norm, handelsname_norm, min(antriebsklasse) AS klasse_min, max(data_status) AS status_max,
  min(marke) AS marke FROM reg GROUP BY ALL"""))
def text_min_max(spark, d):
    """min/max over text in byte order (the T4 trap: min picks alphabetically)."""
    return reg(spark, d).groupBy("marke_norm", "handelsname_norm").agg(
        F.min("antriebsklasse").alias("klasse_min"), F.max("data_status").alias("status_max"),
        F.min("marke").alias("marke"))


@query("year_span", O.with_rw("""
SELECT land, min(jahr) AS jahr_von, max(jahr) AS jahr_bis,
  CAST(min(jahr) AS VARCHAR) || '-' || CAST(max(jahr) AS VARCHAR) AS zeitraum FROM rw GROUP BY land"""))
def year_span(spark, d):
    """Year range label."""
    g = rw(spark, d).groupBy("land").agg(F.min("jahr").alias("jahr_von"), F.max("jahr").alias("jahr_bis"))
    return g.withColumn("zeitraum", F.concat(F.col("jahr_von").cast("string"), F.lit("-"),
                                             F.col("jahr_bis").cast("string")))


@query("distinct_sorted_array", O.with_reg("""
SELECT ms, array_to_string(list_sort(list_distinct(list(antriebsklasse))), ',') AS klassen FROM reg GROUP BY ms"""))
def distinct_sorted_array(spark, d):
    """Distinct ordered array per group (bounded: the class domain)."""
    return reg(spark, d).groupBy("ms").agg(
        F.array_join(F.array_sort(F.collect_set("antriebsklasse")), ",").alias("klassen"))


@query("explode_series", O.with_reg("""
SELECT jahr, count(*) AS tage FROM (SELECT jahr, unnest(generate_series(min(zulassung_datum), max(zulassung_datum),
  INTERVAL 1 DAY)) AS tag FROM reg GROUP BY jahr) GROUP BY jahr"""))
def explode_series(spark, d):
    """Lateral series -- explode(sequence) of the covered days per year."""
    span = reg(spark, d).groupBy("jahr").agg(F.min("zulassung_datum").alias("lo"), F.max("zulassung_datum").alias("hi"))
    days = span.select("jahr", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("tag"))
    return days.groupBy("jahr").agg(F.count(F.lit(1)).alias("tage"))


@query("mixed_direction_sort", O.with_reg("""
SELECT ft, count(*) AS n, CAST(row_number() OVER (ORDER BY ft ASC NULLS FIRST, count(*) DESC) AS INTEGER) AS pos
FROM reg GROUP BY ft"""))
def mixed_direction_sort(spark, d):
    """Multi-key sort with mixed directions; NULL order stated (first); position as a column."""
    g = reg(spark, d).groupBy("ft").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("ft").asc_nulls_first(), F.col("n").desc())   # over the few aggregate rows
    return g.withColumn("pos", F.row_number().over(w))


@query("one_row", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def one_row(spark, d):
    """One row (made deterministic by an order)."""
    return (read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1))


@query("union_years", O.with_raw("""
SELECT jahr, count(*) AS n FROM raw GROUP BY jahr"""))
def union_years(spark, d):
    """Yearly tables unioned by name: the raw rows are written as a folder per year
    (a null year has its own) and one scan reads the folders as one table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/years-{uuid.uuid4().hex[:12]}"
    with unsorted_writes(spark):
        raw(spark, d).write.options(**SMALL_GROUPS).partitionBy("jahr").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("jahr").cast("string").alias("jahr")).agg(F.count(F.lit(1)).alias("n"))


@query("union_provenance", O.with_all("""
SELECT quelle, count(*) AS n FROM (SELECT 'registrierung' AS quelle FROM reg UNION ALL SELECT 'messung' FROM rw)
GROUP BY quelle"""))
def union_provenance(spark, d):
    """Two provenances with a marker column."""
    a = reg(spark, d).select(F.lit("registrierung").alias("quelle"))
    b = rw(spark, d).select(F.lit("messung").alias("quelle"))
    return a.unionByName(b).groupBy("quelle").agg(F.count(F.lit(1)).alias("n"))


@query("pushed_scan", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1998-01-01'""")
def pushed_scan(spark, d):
    """Projection and filter reach the Parquet scan (PushedFilters / ReadSchema)."""
    o = read_table(spark, d, "orders")
    return (o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") &
                     (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
            .select("o_orderkey", "o_totalprice"))


_HEAD = ["jahr", "id", "mk", "cn", "m_kg", "ft", "fm"]


@query("head_sample", O.with_raw(f"""
SELECT {', '.join(_HEAD)} FROM raw WHERE ms = '{FOCUS}' ORDER BY {', '.join(c + ' NULLS FIRST' for c in _HEAD)} LIMIT 50"""))
def head_sample(spark, d):
    """The first n rows of one country (a sampling feature), in a stated order."""
    return raw(spark, d).filter(F.col("ms") == FOCUS).select(*_HEAD).orderBy(*_HEAD).limit(50)


@query("mart_filter", O.with_rw(f", p AS ({_POOLED})\nSELECT * FROM p WHERE land = '{FOCUS}' AND fahrzeuge >= 50"))
def mart_filter(spark, d):
    """Read a mart with a country filter and a threshold."""
    return G.gap_pooled(rw(spark, d)).filter((F.col("land") == FOCUS) & (F.col("fahrzeuge") >= 50))


@query("squeeze_text", """
SELECT page_id, substr(regexp_replace(html, '\\s+', ' ', 'g'), 1, 70) AS kurz,
  length(regexp_replace(html, '\\s+', ' ', 'g')) AS laenge FROM pages""")
def squeeze_text(spark, d):
    """Collapse whitespace over the whole text; the 70-char label is the display feature."""
    p = read_table(spark, d, "pages")
    sq = F.regexp_replace("html", r"\s+", " ")
    return p.select("page_id", S.squeeze_text("html", 70).alias("kurz"), F.length(sq).cast("bigint").alias("laenge"))


@query("cost_of_gap", O.with_rw(f", p AS ({_POOLED})\n" + f"""
SELECT land, antriebsklasse, {srnd(f'wltp_l * {KM_PER_YEAR} / 100', 1)} AS liter_labor,
  {srnd(f'real_l * {KM_PER_YEAR} / 100', 1)} AS liter_real,
  {srnd(f'(real_l - wltp_l) * {KM_PER_YEAR} / 100', 1)} AS liter_differenz,
  {srnd(f'(real_l - wltp_l) * {KM_PER_YEAR} / 100 * {PRICE_PER_L}', 2)} AS mehrkosten_eur FROM p"""))
def cost_of_gap(spark, d):
    """Litres per year lab vs real and the cost of the difference (inputs as parameters)."""
    p = G.gap_pooled(rw(spark, d))
    km = F.lit(KM_PER_YEAR)
    return p.select("land", "antriebsklasse", rnd(F.col("wltp_l") * km / 100, 1).alias("liter_labor"),
                    rnd(F.col("real_l") * km / 100, 1).alias("liter_real"),
                    rnd((F.col("real_l") - F.col("wltp_l")) * km / 100, 1).alias("liter_differenz"),
                    rnd((F.col("real_l") - F.col("wltp_l")) * km / 100 * PRICE_PER_L, 2).alias("mehrkosten_eur"))


@query("uf_panel", O.with_rw(f""", {_BY_YEAR_CTE}
SELECT land, jahr, {srnd('avg(median_e_anteil_pct)', 1)} AS e_anteil_gefahren_pct,
  {srnd(f'avg(median_e_anteil_pct) - {UF_ASSUMED}', 1)} AS abweichung_zum_uf
FROM by_year WHERE antriebsklasse = 'PHEV' GROUP BY land, jahr"""))
def uf_panel(spark, d):
    """Measured electric share minus the assumed utility factor."""
    y = mart_gap_by_year(spark, d).filter(F.col("antriebsklasse") == "PHEV")
    return y.groupBy("land", "jahr").agg(
        rnd(F.avg("median_e_anteil_pct"), 1).alias("e_anteil_gefahren_pct"),
        rnd(F.avg("median_e_anteil_pct") - UF_ASSUMED, 1).alias("abweichung_zum_uf"))


@query("top_countries", O.with_rw("SELECT land, count(*) AS n FROM rw GROUP BY land ORDER BY n DESC, land LIMIT 10"))
def top_countries(spark, d):
    """Top countries of the meter table (unique tie-break)."""
    return (rw(spark, d).groupBy("land").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "land").limit(10))


@query("meter_paths", O.with_rw("SELECT data_source, jahr, count(*) AS n FROM rw GROUP BY ALL"))
def meter_paths(spark, d):
    """Reporting path x year."""
    return rw(spark, d).groupBy("data_source", "jahr").agg(F.count(F.lit(1)).alias("n"))


@query("meter_classes", O.with_rw("""
SELECT antriebsklasse, count(*) AS n, count(*) FILTER (WHERE gap_pct IS NOT NULL) AS mit_luecke FROM rw GROUP BY ALL"""))
def meter_classes(spark, d):
    """Classes with and without a computable gap."""
    return rw(spark, d).groupBy("antriebsklasse").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("gap_pct").isNotNull(), 1)).alias("mit_luecke"))


@query("class_filter", O.with_raw("""
SELECT upper(trim(coalesce(ct, ''))) IN ('M1', 'M1G') AS pkw, count(*) AS n FROM raw GROUP BY 1"""))
def class_filter(spark, d):
    """NULL-safe class filter and its complement."""
    return raw(spark, d).groupBy(S.is_car_class("ct").alias("pkw")).agg(F.count(F.lit(1)).alias("n"))


@query("prefix_mismatch", O.with_raw("""
SELECT jahr, count(*) FILTER (WHERE regexp_matches(dr, '^[0-9]{4}-') AND left(dr, 4) <> jahr) AS abweichend,
  count(*) AS n FROM raw GROUP BY jahr"""))
def prefix_mismatch(spark, d):
    """Year prefix of the date text differs from the reporting year."""
    r = raw(spark, d)
    bad = F.col("dr").rlike(r"\A[0-9]{4}-") & S.year_prefix_mismatch("dr", "jahr")
    return r.groupBy("jahr").agg(F.count(F.when(bad, 1)).alias("abweichend"), F.count(F.lit(1)).alias("n"))


@query("outlier_band", O.with_rw("""
SELECT antriebsklasse, count(*) FILTER (WHERE gap_pct BETWEEN -50 AND 900) AS im_band, count(*) AS n
FROM ok GROUP BY antriebsklasse"""))
def outlier_band(spark, d):
    """BETWEEN outlier band."""
    return analysable(rw(spark, d)).groupBy("antriebsklasse").agg(
        F.count(F.when(S.in_band("gap_pct", -50, 900), 1)).alias("im_band"), F.count(F.lit(1)).alias("n"))


@query("number_format", O.with_reg("""
SELECT jahr, count(*) AS n, format('{:,}', count(*)) AS n_text FROM reg GROUP BY jahr"""))
def number_format(spark, d):
    """Thousands-separated counts."""
    g = reg(spark, d).groupBy("jahr").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("n_text", S.thousands("n"))


@query("key_casts", O.with_reg("""
SELECT CAST(jahr AS VARCHAR) AS jahr_text, CAST(count(*) AS VARCHAR) AS n_text FROM reg GROUP BY jahr"""))
def key_casts(spark, d):
    """Casts of keys to text (year as a category)."""
    return (reg(spark, d).groupBy("jahr").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("jahr").cast("string").alias("jahr_text"), F.col("n").cast("string").alias("n_text")))


@query("load_audit", O.with_reg(f"""
, s AS (SELECT CAST(yr AS VARCHAR) AS jahr, count(*) AS soll FROM base GROUP BY 1),
i AS (SELECT jahr, any_value(version_file) AS version_file, count(*) AS ist FROM raw GROUP BY jahr)
SELECT s.jahr, i.version_file, regexp_extract(i.version_file, '^co2cars_[0-9]{{4}}([FP])v([0-9]+)$', 1) AS data_status,
  CAST(regexp_extract(i.version_file, '^co2cars_[0-9]{{4}}([FP])v([0-9]+)$', 2) AS INTEGER) AS version,
  s.soll, coalesce(i.ist, 0) AS ist, coalesce(i.ist, 0) - s.soll AS differenz,
  CASE WHEN coalesce(i.ist, 0) = s.soll THEN 'F' ELSE 'P' END AS status
FROM s LEFT JOIN i ON i.jahr = s.jahr"""))
def load_audit(spark, d):
    """Written vs counted at the source per year, version and status parsed from the name."""
    from .q_quality import _expected
    soll = _expected(spark, d).groupBy("jahr").agg(F.sum("soll").alias("soll"))
    return L.load_audit(raw(spark, d), soll)


@query("version_pick", O.with_raw("""
, c AS (SELECT DISTINCT version_file AS tabelle FROM raw),
p AS (SELECT tabelle, CAST(regexp_extract(tabelle, '^co2cars_([0-9]{4})([FP])v([0-9]+)$', 1) AS INTEGER) AS jahr,
  regexp_extract(tabelle, '^co2cars_([0-9]{4})([FP])v([0-9]+)$', 2) AS status,
  CAST(regexp_extract(tabelle, '^co2cars_([0-9]{4})([FP])v([0-9]+)$', 3) AS INTEGER) AS version FROM c)
SELECT jahr, tabelle, status, version FROM (SELECT *, row_number() OVER (PARTITION BY jahr
  ORDER BY CASE status WHEN 'F' THEN 0 ELSE 1 END, version DESC) AS rn FROM p) WHERE rn = 1"""))
def version_pick(spark, d):
    """Latest version per year -- final before provisional, then highest version."""
    names = raw(spark, d).select(F.col("version_file").alias("tabelle")).distinct()
    return L.pick_versions(names)


_HALVED = """
WITH RECURSIVE s AS (SELECT min(o_orderkey) AS lo, greatest(1, length(trim(leading '0' FROM bin(max(o_orderkey) - min(o_orderkey))))) AS d FROM orders),
w AS (SELECT 0 AS level, 0::BIGINT AS id, count(*) AS n FROM orders
  UNION ALL SELECT w.level + 1, (o_orderkey - lo) >> (d - w.level - 1), count(*) FROM w, s, orders
  WHERE w.n > 400 AND w.level < d AND (o_orderkey - lo) >> (d - w.level) = w.id GROUP BY 1, 2),
leaf AS (SELECT lo + (id << (d - level)) AS von, lo + ((id + 1) << (d - level)) AS bis, n AS zeilen, n > 400 AS wiederholt
  FROM w, s WHERE n <= 400 OR level = d)"""


@query("key_windows", _HALVED + "\nSELECT * FROM leaf")
def key_windows(spark, d):
    """Windows over the key range with 400 rows at most, and the rows that each reads."""
    return L.key_windows(read_table(spark, d, "orders"), "o_orderkey", rows_per_window=400)


@query("key_windows_largest", _HALVED + """
SELECT count(*) AS fenster, max(zeilen) AS groesstes, min(zeilen) AS kleinstes, CAST(sum(zeilen) AS BIGINT) AS zeilen, max(zeilen) <= 400 AS eingehalten FROM leaf""")
def key_windows_largest(spark, d):
    """The largest window stays within its bound."""
    return key_windows(spark, d).agg(F.count(F.lit(1)).alias("fenster"), F.max("zeilen").alias("groesstes"), F.min("zeilen").alias("kleinstes"),
                                     F.sum("zeilen").alias("zeilen"), (F.max("zeilen") <= 400).alias("eingehalten"))


@query("like_prefix", O.with_raw("""
SELECT jahr, count(*) FILTER (WHERE version_file LIKE 'co2cars_20%') AS neu, count(*) AS n FROM raw GROUP BY jahr"""))
def like_prefix(spark, d):
    """LIKE prefix predicate."""
    r = raw(spark, d)
    return r.groupBy("jahr").agg(F.count(F.when(F.col("version_file").like("co2cars_20%"), 1)).alias("neu"),
                                 F.count(F.lit(1)).alias("n"))


@query("blank_label", O.with_raw("""
SELECT coalesce(nullif(mp, ''), '(leer)') AS pool, count(*) AS n FROM raw GROUP BY 1"""))
def blank_label(spark, d):
    """NULL or '' shown as '(leer)'."""
    return raw(spark, d).groupBy(S.blank_label("mp").alias("pool")).agg(F.count(F.lit(1)).alias("n"))


@query("rating_rule", O.with_raw("""
, c AS (SELECT jahr, ms, count(*) AS n FROM raw GROUP BY ALL)
SELECT jahr, ms, n, CASE WHEN n % 10 = 0 THEN 'ok' WHEN n % 10 < 5 THEN 'auffaellig' ELSE 'kritisch' END AS bewertung
FROM c"""))
def rating_rule(spark, d):
    """Three-tier rating (ok / auffaellig / kritisch) of a measured value."""
    c = raw(spark, d).groupBy("jahr", "ms").agg(F.count(F.lit(1)).alias("n"))
    r = F.col("n") % 10
    return c.withColumn("bewertung", S.rating(r, noticeable_below=5))


@query("finding_message", O.with_raw("""
SELECT jahr, printf('Soll %d, Ist %d', count(*), count(m_kg)) AS kommentar FROM raw GROUP BY jahr"""))
def finding_message(spark, d):
    """Finding messages from counts."""
    g = raw(spark, d).groupBy("jahr").agg(F.count(F.lit(1)).alias("a"), F.count("m_kg").alias("b"))
    return g.select("jahr", S.message("Soll %d, Ist %d", "a", "b").alias("kommentar"))


@query("label_concat", O.with_reg("""
SELECT DISTINCT marke || ' ' || handelsname AS bezeichnung FROM reg"""))
def label_concat(spark, d):
    """Brand || ' ' || model (NULL-propagating)."""
    return (reg(spark, d).select(F.concat(F.col("marke"), F.lit(" "), F.col("handelsname")).alias("bezeichnung"))
            .distinct())
