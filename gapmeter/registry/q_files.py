"""Text files end to end (A1-A6, A10, A12, A13, A17-A21, H17, H18): what the tables hold is written
as files into the shared folder, read back by the loaders and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, raw, reg, rw, star_fact
from ..functions import scalars as S
from ..functions.scalars import rnd
from ..oracle import adapter as O
from ..plans import core as C
from ..plans import marts as M
from ..plans import star as ST
from ..sources import load as L
from ..sources.adapter import generation_long
from ..sources.tables import read_table
from ..streaming.incremental import scratch
from .q_marts import _HIST
from .q_star import star

FINAL_YEAR = 1998


#: Lines of a text file: it is compressed, so one task reads it as a whole.
LINES_PER_FILE = 1_000_000


def _as_text(df, path, **options):
    """CSV that keeps null, empty text and outer spaces apart, as compressed files of a bounded number of lines."""
    w = df.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w = w.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", LINES_PER_FILE)
    for k, v in options.items():
        w = w.option(k, v)
    w.csv(path)
    return path


@query("core_from_text", O.with_reg(f"""
SELECT jahr, antriebsklasse, count(*) AS n, {O.rnd('sum(masse_kg)', 1)} AS masse, count(oeko_codes) AS mit_codes,
  count(zulassung_datum) AS mit_datum FROM reg GROUP BY jahr, antriebsklasse"""))
def core_from_text(spark, d):
    """A1: registration text file -> all-text rows -> class filter, dedup, typing."""
    back = L.read_text_csv(spark, _as_text(raw(spark, d), scratch(spark, "text-registration")))
    return C.type_registration(back).groupBy("jahr", "antriebsklasse").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("masse_kg"), 1).alias("masse"), F.count("oeko_codes").alias("mit_codes"),
        F.count("zulassung_datum").alias("mit_datum"))


@query("meter_from_text", O.with_rw(f"""
SELECT land, count(*) AS n, count(fc_real) AS mit_verbrauch, count(anteil_elektrisch) AS mit_anteil, {O.rnd('sum(gap_pct)', 2)} AS luecke,
  count(*) FILTER (WHERE handelsname LIKE '%,%') AS mit_komma FROM rw GROUP BY land"""))
def meter_from_text(spark, d):
    """A2, A3: text file with a word for missing values and quoted commas."""
    cols = ["vehicle_id", "land", "handelsname", "fc_real", "anteil_elektrisch", "gap_pct"]
    path = _as_text(rw(spark, d).select(*[F.col(c).cast("string").alias(c) for c in cols]), scratch(spark, "text-meter"), nullValue="NULL")
    t = L.read_null_word_csv(spark, path)
    return t.groupBy("land").agg(F.count(F.lit(1)).alias("n"), F.count("fc_real").alias("mit_verbrauch"), F.count("anteil_elektrisch").alias("mit_anteil"),
                                 rnd(F.sum(F.col("gap_pct").cast("double")), 2).alias("luecke"),
                                 F.count(F.when(F.col("handelsname").contains(","), 1)).alias("mit_komma"))


#: How each measured number is written in the meter file, by vehicle: decimal comma, blanks around, a blank, junk, a word, or plain.
_FORMS = """CASE WHEN {n} % 29 = 0 THEN ' ' WHEN {n} % 31 = 0 THEN 'n/a' WHEN {n} % 37 = 0 THEN '12,3,4' WHEN {n} % 41 = 0 THEN ''
  WHEN {n} % 3 = 0 THEN replace({t}, '.', ',') WHEN {n} % 5 = 0 THEN concat('  ', {t}, ' ') ELSE {t} END"""
_METER_NUMBERS = ["fuel_total_l", "dist_total_km", "masse_kg", "fc_wltp"]
_UNREADABLE = " OR ".join(f"v.n % {k} = 0" for k in (29, 31, 37, 41))


@query("meter_text_numbers", O.with_rw(f"""
, v AS (SELECT *, CAST(split_part(vehicle_id, '-', 1) AS BIGINT) * 7 + CAST(split_part(vehicle_id, '-', 2) AS BIGINT) AS n FROM rw)
SELECT land, count(*) AS fahrzeuge, {', '.join(f"count(CASE WHEN NOT ({_UNREADABLE}) THEN {c} END) AS {c}_n, {O.rnd(f'sum(CASE WHEN NOT ({_UNREADABLE}) THEN CAST({c} AS DECIMAL(24,4)) END)', 2)} AS {c}_summe" for c in _METER_NUMBERS)}
FROM v GROUP BY land"""))
def meter_text_numbers(spark, d):
    """A2, B1: the meter file's own numbers as text with commas, blanks and junk, through the tolerant parsers."""
    n = F.split("vehicle_id", "-")[0].cast("long") * 7 + F.split("vehicle_id", "-")[1].cast("long")
    t = rw(spark, d).withColumn("n", n)
    t = t.withColumns({f"t_{c}": F.col(c).cast("decimal(24,4)").cast("string") for c in _METER_NUMBERS})
    form = {c: F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.expr(_FORMS.format(n="n", t=f"t_{c}"))).alias(c) for c in _METER_NUMBERS}
    path = _as_text(t.select("vehicle_id", "land", *form.values()), scratch(spark, "text-meter-numbers"), nullValue="NULL", emptyValue="")
    typed = L.read_null_word_csv(spark, path).select("land", *[S.parse_number(c).alias(c) for c in _METER_NUMBERS])
    return typed.groupBy("land").agg(F.count(F.lit(1)).alias("fahrzeuge"), *[x for c in _METER_NUMBERS for x in (
        F.count(c).alias(f"{c}_n"), rnd(F.sum(F.col(c).cast("decimal(24,4)")), 2).alias(f"{c}_summe"))])


@query("histogram_from_text", O.with_raw("," + _HIST + f"""
SELECT h.jahr, 'hist_' || h.jahr AS tabelle, count(*) AS zellen, CAST(sum(n) AS BIGINT) AS zulassungen, {O.rnd('sum(avg_mass * n)', 1)} AS masse
FROM hist h WHERE h.jahr < {FINAL_YEAR} GROUP BY h.jahr"""))
def histogram_from_text(spark, d):
    """A4: the source's histogram, a file per year, loaded through a file that says which table holds which year."""
    hist = M.mass_histogram(raw(spark, d)).filter(F.col("jahr") < FINAL_YEAR)
    path, names = scratch(spark, "text-histogram"), scratch(spark, "text-years")
    years = F.concat(F.lit("hist_"), F.col("jahr"))
    _as_text(hist.select("jahr").distinct().select(F.col("jahr").cast("string").alias("jahr"), years.alias("tabelle")), names)
    text = hist.select(years.alias("tabelle"), *[F.col(c).cast("string").alias(c) for c in hist.columns if c != "jahr"])
    text.repartition("tabelle").write.partitionBy("tabelle").option("header", True).option("escape", '"').option("nullValue", "NULL").csv(path)
    # the year is not in the files: only the map has it
    loaded = L.read_null_word_csv(spark, path).join(L.read_text_csv(spark, names), "tabelle")
    g = loaded.groupBy(S.parse_number("jahr").cast("int").alias("jahr"), "tabelle")
    n = S.parse_number("n")
    return g.agg(F.count(F.lit(1)).alias("zellen"), F.sum(n.cast("long")).alias("zulassungen"), rnd(F.sum(S.parse_number("avg_mass") * n), 1).alias("masse"))


@query("columns_by_header", O.with_raw("""
SELECT jahr, count(*) AS n, count(mk) AS mit_marke, count(CASE WHEN jahr < '1998' THEN ft END) AS mit_kraftstoff, 'pump' AS fehlend FROM raw GROUP BY jahr"""))
def columns_by_header(spark, d):
    """A4, A5, A10: one folder, files with headers of their own order and content, bound by name."""
    path, r = scratch(spark, "text-headers"), raw(spark, d)
    _as_text(r.where("jahr < '1998'").select("jahr", "id", "mk", "ft"), path)
    _as_text(r.where("jahr >= '1998' or jahr is null").select("mk", "jahr", "id"), path)
    wanted = ["id", "jahr", "mk", "ft", "pump"]
    found = L.read_by_header(spark, path)
    missing = L.missing_columns(found, wanted)
    return L.bind(found, wanted).groupBy("jahr").agg(
        F.count(F.lit(1)).alias("n"), F.count("mk").alias("mit_marke"), F.count("ft").alias("mit_kraftstoff"), F.lit(",".join(missing)).alias("fehlend"))


_BAD_LINES = '''
WITH l AS (SELECT *, year(o_orderdate) AS jahr, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) + 1 AS zeilennummer FROM orders),
b AS (SELECT 'jahr=' || jahr AS datei, zeilennummer, CASE WHEN o_orderkey % 97 = 0 THEN 2 ELSE 4 END AS felder,
  left(CASE WHEN o_orderkey % 97 = 0 THEN o_custkey || ',"' || o_orderpriority || ', ""x"""'
            ELSE o_custkey || ',' || o_orderstatus || ',"' || o_orderpriority || ', ""x""",1' END, 150) AS anfang
  FROM l WHERE o_orderkey % 97 = 0 OR o_orderkey % 101 = 0)'''


def _order_lines(spark, d):
    """A text file per year, in the order of keys, with lines of too few and too many fields."""
    o = read_table(spark, d, "orders").withColumn("jahr", F.year("o_orderdate"))
    path = scratch(spark, "text-lines")
    o.withColumn("kunde,status,text", _order_line()).repartition("jahr").sortWithinPartitions("jahr", "o_orderkey").select("jahr", "kunde,status,text") \
        .write.partitionBy("jahr").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return path


def _order_line():
    key, text = F.col("o_custkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""x"""'))
    return F.when(F.col("o_orderkey") % 97 == 0, F.concat_ws(",", key, text)) \
        .when(F.col("o_orderkey") % 101 == 0, F.concat_ws(",", key, F.col("o_orderstatus"), text, F.lit("1"))) \
        .otherwise(F.concat_ws(",", key, F.col("o_orderstatus"), text))


def _bad_order_lines(spark, d):
    b = L.bad_lines(spark, _order_lines(spark, d), 3)
    return b.withColumn("datei", F.regexp_extract("datei", "(jahr=[0-9]+)/[^/]*$", 1))


@query("quarantine_lines", _BAD_LINES + "\nSELECT * FROM b")
def quarantine_lines(spark, d):
    """Every bad line with file, line number, fields and beginning."""
    return _bad_order_lines(spark, d)


@query("quarantine_first", _BAD_LINES + "\nSELECT * FROM b ORDER BY datei, zeilennummer LIMIT 25")
def quarantine_first(spark, d):
    """The report's first 25 bad lines."""
    return L.first_bad_lines(_bad_order_lines(spark, d))


@query("quarantine_report", """
WITH l AS (SELECT o_custkey, o_orderkey % 97 = 0 AS wenig, o_orderkey % 101 = 0 AS viel FROM orders)
SELECT count(*) FILTER (WHERE NOT wenig AND NOT viel) AS gut,
  count(*) FILTER (WHERE NOT wenig AND NOT viel) - count(DISTINCT CASE WHEN NOT wenig AND NOT viel THEN o_custkey END) AS doppelte_ids,
  count(*) FILTER (WHERE wenig OR viel) AS quarantaene, min(CASE WHEN wenig THEN 2 WHEN viel THEN 4 END) AS felder_min,
  max(CASE WHEN wenig THEN 2 WHEN viel THEN 4 END) AS felder_max, 0 AS differenz FROM l""")
def quarantine_report(spark, d):
    """Lines with too few and too many fields go to quarantine, quoted commas don't count."""
    o = read_table(spark, d, "orders")
    path = scratch(spark, "text-quarantine")
    o.select(_order_line().alias("kunde,status,text")).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    good, bad = L.quarantine_csv(spark, path, ["kunde", "status", "text"])
    return L.quarantine_report(good, bad, "kunde", o.count())


@query("series_from_json", f"""
WITH h AS (SELECT date_trunc('hour', ts) AS zeitpunkt, event_type, sum(value) AS v FROM events GROUP BY ALL)
SELECT event_type AS traeger, count(*) AS punkte, {O.rnd('sum(v)', 4)} AS mwh, min(zeitpunkt) AS von, max(zeitpunkt) AS bis FROM h GROUP BY event_type""")
def series_from_json(spark, d):
    """A JSON document per carrier and week, weeks overlap by a day; the later one wins."""
    g = generation_long(spark, d).withColumn("ms", F.unix_millis(F.col("zeitpunkt").cast("timestamp")))
    week = F.floor(F.col("ms") / (7 * 86_400_000))
    g = g.withColumn("w", F.explode(F.when(F.col("ms") % (7 * 86_400_000) < 86_400_000, F.array(week - 1, week)).otherwise(F.array(week))))
    docs = g.groupBy("traeger", "w").agg(F.sort_array(F.collect_list(F.array(F.col("ms").cast("double"), F.col("mwh")))).alias("series"))
    path = scratch(spark, "json-series")
    docs.select("traeger", "series").write.partitionBy("traeger").json(path)
    t = L.read_series_json(spark, path, multi_line=False)
    at = F.timestamp_millis("epoch_ms").cast("timestamp_ntz")
    return t.groupBy("traeger").agg(F.count(F.lit(1)).alias("punkte"), rnd(F.sum("wert"), 4).alias("mwh"), F.min(at).alias("von"), F.max(at).alias("bis"))


@query("year_reload", star("SELECT jahr, count(*) AS n, count(DISTINCT src_id) AS saetze FROM f GROUP BY jahr"))
def year_reload(spark, d):
    """A fact written by year, one year loaded again: that year is replaced, the others stay."""
    path, f = scratch(spark, "fact-years"), star_fact(spark, d)
    ST.write_fact(f, path)
    ST.write_fact(f.where(F.col("jahr") == FINAL_YEAR), path)
    return spark.read.parquet(path).groupBy("jahr").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src_id").alias("saetze"))


@query("mart_rewrite", O.with_reg("SELECT ms, count(*) AS n FROM reg GROUP BY ms"))
def mart_rewrite(spark, d):
    """A result table is dropped and created anew."""
    path, m = scratch(spark, "mart"), reg(spark, d).groupBy("ms").agg(F.count(F.lit(1)).alias("n"))
    L.write_mart(m.limit(1), path)
    L.write_mart(m, path)
    return spark.read.parquet(path)


@query("findings_append", O.with_raw("""
SELECT pruefung, count(*) AS zeilen, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'ohne Masse' AS pruefung, count(*) FILTER (WHERE m_kg IS NULL) AS n FROM raw GROUP BY jahr
  UNION ALL SELECT 'ohne Marke', count(*) FILTER (WHERE mk IS NULL) FROM raw GROUP BY jahr) GROUP BY pruefung"""))
def findings_append(spark, d):
    """The findings table is emptied at the start and appended to by each check."""
    path, r = scratch(spark, "findings"), raw(spark, d)

    def missing(col, name):
        return r.groupBy("jahr").agg(F.count(F.when(F.col(col).isNull(), 1)).alias("n")).select(F.lit(name).alias("pruefung"), "jahr", "n")

    L.append_findings(missing("ft", "alt"), path, truncate=True)
    L.append_findings(missing("m_kg", "ohne Masse"), path, truncate=True)
    L.append_findings(missing("mk", "ohne Marke"), path)
    return spark.read.parquet(path).groupBy("pruefung").agg(F.count(F.lit(1)).alias("zeilen"), F.sum("n").cast("bigint").alias("n"))


@query("load_log", O.with_raw("""
SELECT jahr, version_file, count(*) AS zeilen, 2 AS lauf FROM raw GROUP BY jahr, version_file
UNION ALL SELECT jahr, version_file, count(*), 1 FROM raw GROUP BY jahr, version_file"""))
def load_log(spark, d):
    """Each load run appends a row per loaded file to the log."""
    path = scratch(spark, "load-log")
    for run in (1, 2):
        L.append_findings(raw(spark, d).groupBy("jahr", "version_file").agg(F.count(F.lit(1)).alias("zeilen")).withColumn("lauf", F.lit(run)), path)
    return spark.read.parquet(path)


@query("profile_csv", O.with_reg("SELECT ms, CAST(count(*) AS VARCHAR) AS n FROM reg GROUP BY ms"))
def profile_csv(spark, d):
    """A21: ';' profile file with header, read back as text."""
    path = scratch(spark, "profile")
    L.write_semicolon_csv(reg(spark, d).groupBy("ms").agg(F.count(F.lit(1)).alias("n")), path)
    return L.read_text_csv(spark, path, sep=";")


@query("input_guards", """
SELECT 'orders' AS eingabe, 'gelesen' AS ergebnis, count(*) AS zeilen FROM orders
UNION ALL SELECT 'orders ohne Zeilen', 'abgebrochen', 0 UNION ALL SELECT 'orders_alt', 'uebersprungen', 0""")
def input_guards(spark, d):
    """An empty required input stops the step, a missing optional one is skipped."""
    o, out = read_table(spark, d, "orders"), []
    for name, df in (("orders", o), ("orders ohne Zeilen", o.where("o_orderkey < 0"))):
        try:
            out.append((name, "gelesen", L.require_rows(df, name).count()))
        except ValueError:
            out.append((name, "abgebrochen", 0))
    old = L.optional_input(spark, f"{d}/orders_alt.parquet", "orders_alt")
    out.append(("orders_alt", "uebersprungen" if old is None else "gelesen", 0))
    return spark.createDataFrame(out, "eingabe string, ergebnis string, zeilen long")
