"""Data-quality queries (F8, H1-H15, A12, D13, E5, E6, G6) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, raw, reg, rw
from ..functions import scalars as S
from ..operators import dedup as DD
from ..operators import quality as Q
from ..oracle import adapter as O
from ..oracle.adapter import rnd
from ..plans import layers as PL
from ..plans.core import car_rows

MISSING_COLS = "mp mk cn tan m_kg mt ewltp enedc ft fm ec_cm3 ep_kw z_whkm it_code erwltp dr fc w_mm".split()
NUMERIC_COLS = "m_kg mt ewltp enedc ec_cm3 ep_kw z_whkm erwltp fc r_count".split()
VALUE_COLS = "ft fm ct status version_file".split()
BUSINESS_COLS = "ms tan typ va ve dr ewltp m_kg".split()
TOLERANCE = 1000


def _fc(schicht, objekt, spalte, pruefung, ergebnis, einheit, schwelle, bewertung, kommentar):
    """SQL select list in the finding schema."""
    return (f"{schicht} AS schicht, {objekt} AS objekt, {spalte} AS spalte, {pruefung} AS pruefung, "
            f"CAST({ergebnis} AS DOUBLE) AS ergebnis, {einheit} AS einheit, CAST({schwelle} AS DOUBLE) AS schwelle, "
            f"{bewertung} AS bewertung, {kommentar} AS kommentar")


def _expected(spark, d):
    """Rows counted at the source per year x country (the joined source rows)."""
    from ..catalog import base
    return (base(spark, d).groupBy(F.col("yr").cast("string").alias("jahr"), F.col("n_name").alias("ms"))
            .agg(F.count(F.lit(1)).alias("soll")))


_SOLL = """soll AS (SELECT CAST(yr AS VARCHAR) AS jahr, n_name AS ms, count(*) AS soll FROM base GROUP BY ALL)"""

_H1 = f""", {_SOLL},
ist AS (SELECT jahr, ms, count(*) AS n FROM raw GROUP BY jahr, ms),
h1 AS (SELECT {_fc("'raw'", "'co2cars_' || s.jahr", 's.ms', "'Geladene gegen gezaehlte Zeilen'",
                  'coalesce(i.n, 0) - s.soll', "'Zeilen Differenz'", '0',
                  "CASE WHEN coalesce(i.n, 0) = s.soll THEN 'ok' WHEN abs(coalesce(i.n, 0) - s.soll) < s.soll * 0.001 "
                  "THEN 'auffaellig' ELSE 'kritisch' END", "printf('Soll %d, Ist %d', s.soll, coalesce(i.n, 0))")}
       FROM soll s LEFT JOIN ist i ON i.jahr = s.jahr AND i.ms = s.ms)"""

_H2 = ", h2w AS (SELECT jahr, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL OR {c} = '') AS {c}" for c in MISSING_COLS) + " FROM raw GROUP BY jahr),\n" + \
    f"h2l AS (UNPIVOT h2w ON {', '.join(MISSING_COLS)} INTO NAME spalte VALUE fehlend),\n" + \
    f"""h2 AS (SELECT {_fc("'raw'", "'co2cars_' || jahr", 'spalte', "'Anteil unbelegter Felder'",
                        rnd('fehlend * 100.0 / n', 2), "'%'", 'NULL',
                        "CASE WHEN fehlend = 0 THEN 'ok' WHEN fehlend < n THEN 'auffaellig' ELSE 'kritisch' END",
                        "printf('%d von %d Saetzen ohne Wert', fehlend, n)")} FROM h2l)"""

_BAD = "({c} IS NOT NULL AND {c} <> '' AND NOT regexp_full_match({c}, '-?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?'))"
_H3 = ", h3w AS (SELECT jahr, " + ", ".join(
    f"count(*) FILTER (WHERE {_BAD.format(c=c)}) AS {c}__n, min({c}) FILTER (WHERE {_BAD.format(c=c)}) AS {c}__ex"
    for c in NUMERIC_COLS) + " FROM raw GROUP BY jahr),\n" + "h3l AS (" + " UNION ALL ".join(
    f"SELECT jahr, '{c}' AS spalte, {c}__n AS anzahl, {c}__ex AS beispiel FROM h3w" for c in NUMERIC_COLS) + "),\n" + \
    f"""h3 AS (SELECT {_fc("'raw'", "'co2cars_' || jahr", 'spalte', "'Text ist keine Zahl'", 'anzahl',
                        "'Saetze'", '0', "CASE WHEN anzahl = 0 THEN 'ok' ELSE 'kritisch' END",
                        "'Beispielwert: ' || coalesce(beispiel, '-')")} FROM h3l)"""


def _v(c):
    return f"(CASE WHEN regexp_full_match({c}, '[0-9.]+') THEN TRY_CAST({c} AS DOUBLE) END)"


def _rule_sql(column, kind, *args):
    n, fuels = _v(column), ", ".join(repr(a) for a in args)
    return {"outside": lambda: f"{n} < {args[0]} OR {n} > {args[1]}", "above": lambda: f"{n} > {args[0]}",
            "zero_unless_fuel": lambda: f"{n} = 0 AND ft NOT IN ({fuels})", "above_zero_for_fuel": lambda: f"{n} > 0 AND ft = {fuels}",
            "other_year": lambda: f"regexp_matches({column}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND left({column}, 4) <> jahr",
            "filled_but_not": lambda: f"{column} NOT IN ('', {fuels})"}[kind]()


_RULES = [(c, title, _rule_sql(c, *rule)) for c, title, rule in Q.RANGE_RULES]
_H4 = ", h4l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS spalte, '{p}' AS pruefung, count(*) FILTER (WHERE {cond}) AS anzahl FROM raw"
    for c, p, cond in _RULES) + "),\n" + \
    f"""h4 AS (SELECT {_fc("'raw'", "'co2cars_alle'", 'spalte', 'pruefung', 'anzahl', "'Saetze'", '0',
                        "CASE WHEN anzahl = 0 THEN 'ok' ELSE 'auffaellig' END", 'CAST(NULL AS VARCHAR)')} FROM h4l)"""

_H5 = f""", h5 AS (SELECT {_fc("'raw'", "'co2cars_alle'", 'CAST(NULL AS VARCHAR)',
    "'Gruppen gleicher Saetze unter mehreren IDs'", 'count(*)', "'Gruppen'", 'NULL',
    "CASE WHEN count(*) = 0 THEN 'ok' ELSE 'auffaellig' END", 'CAST(NULL AS VARCHAR)')}
  FROM (SELECT {', '.join(BUSINESS_COLS)} FROM raw GROUP BY ALL HAVING count(*) > 1))"""

_H6 = ", h6l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS spalte, count(DISTINCT {c}) AS n, string_agg(DISTINCT {c}, ', ' ORDER BY {c}) AS werte FROM raw"
    for c in VALUE_COLS) + "),\n" + \
    f"""h6 AS (SELECT {_fc("'raw'", "'co2cars_alle'", 'spalte', "'Verschiedene Werte'", 'n',
                        "'Werte'", 'NULL', "'ok'", 'werte')} FROM h6l)"""

_H8 = f""", h8 AS (SELECT {_fc("'core'", "'registration'", "'fahrzeugklasse'",
    "'Keine Pkw, nicht uebernommen'", 'count(*)', "'Zeilen'", 'NULL', "'auffaellig'",
    "'Fahrzeugklasse ' || coalesce(nullif(upper(trim(coalesce(ct, ''))), ''), '(leer)') || ' gehoert nicht zu M1/M1G'")}
  FROM raw WHERE upper(trim(coalesce(ct, ''))) NOT IN ('M1', 'M1G') GROUP BY upper(trim(coalesce(ct, ''))))"""

_H9 = f""", h9 AS (SELECT {_fc("'core'", "'registration'", "'src_id'",
    "'Mehrfach gelieferte Satz-ID, nicht uebernommen'", '(SELECT count(*) FROM cars) - (SELECT count(*) FROM reg)',
    "'Zeilen'", '0', "CASE WHEN (SELECT count(*) FROM cars) = (SELECT count(*) FROM reg) THEN 'ok' ELSE 'auffaellig' END",
    'CAST(NULL AS VARCHAR)')})"""


def _count_sql(name, src, cond, objekt, spalte, pruefung, critical=False, layer="core"):
    bad = "kritisch" if critical else "auffaellig"
    return (f", {name} AS (SELECT {_fc(repr(layer), repr(objekt), repr(spalte), repr(pruefung), 'count(*) FILTER (WHERE ' + cond + ')', chr(39) + 'Zeilen' + chr(39), '0', 'CASE WHEN count(*) FILTER (WHERE ' + cond + ') = 0 THEN ' + chr(39) + 'ok' + chr(39) + ' ELSE ' + repr(bad) + ' END', 'CAST(NULL AS VARCHAR)')} FROM {src})")


_H11 = _count_sql("h11", "reg", "antriebsklasse = 'UNBEKANNT'", "registration", "antriebsklasse",
                  "Antriebsklasse nicht bestimmbar")
_H12 = _count_sql("h12", "reg", "oeko_code_roh IS NOT NULL AND oeko_codes IS NULL", "registration", "oeko_codes",
                  "Oeko-Text ohne gueltigen Code")
_H13 = _count_sql("h13", "cars", f"{O.blank('ewltp')} IS NOT NULL AND {O.num('ewltp')} IS NULL", "registration",
                  "co2_wltp", "WLTP-Ausstoss belegt, aber unlesbar", critical=True)


def _raw_findings(spark, d):
    r = raw(spark, d)
    return [Q.row_counts_vs_expected(r, _expected(spark, d)), Q.missing_share(r, MISSING_COLS),
            Q.unconvertible(r, NUMERIC_COLS), Q.range_rules(r), Q.duplicate_business_rows(r, BUSINESS_COLS),
            Q.value_lists(r, VALUE_COLS)]


def _core_findings(spark, d):
    r = raw(spark, d)
    cars, core = car_rows(r), reg(spark, d)
    return [Q.excluded_classes(r), Q.removed_duplicates(cars, core),
            Q.count_finding(core, F.col("antriebsklasse") == "UNBEKANNT", "registration", "antriebsklasse",
                            "Antriebsklasse nicht bestimmbar"),
            Q.count_finding(core, F.col("oeko_code_roh").isNotNull() & F.col("oeko_codes").isNull(), "registration",
                            "oeko_codes", "Oeko-Text ohne gueltigen Code"),
            Q.count_finding(cars, S.blank_to_null("ewltp").isNotNull() & S.parse_number("ewltp").isNull(),
                            "registration", "co2_wltp", "WLTP-Ausstoss belegt, aber unlesbar",
                            critical=True)]


def stored_findings(spark, d):
    """Every check runs once and its findings are stored; summary and lists read them."""
    return PL.layer(spark, d, "dq_befund", lambda: Q.union_all(_raw_findings(spark, d) + _core_findings(spark, d)))


def _reg_sql(ctes, select):
    return O.with_reg(ctes + "\n" + select)


@query("row_count_check", _reg_sql(_H1, "SELECT * FROM h1"))
def row_count_check(spark, d):
    return Q.row_counts_vs_expected(raw(spark, d), _expected(spark, d))


@query("unpivot_missing", _reg_sql(_H2, "SELECT * FROM h2"))
def unpivot_missing(spark, d):
    return Q.missing_share(raw(spark, d), MISSING_COLS)


@query("unconvertible", _reg_sql(_H3, "SELECT * FROM h3"))
def unconvertible(spark, d):
    return Q.unconvertible(raw(spark, d), NUMERIC_COLS)


@query("range_rules", _reg_sql(_H4, "SELECT * FROM h4"))
def range_rules(spark, d):
    return Q.range_rules(raw(spark, d))


@query("duplicate_business", _reg_sql(_H5, "SELECT * FROM h5"))
def duplicate_business(spark, d):
    return Q.duplicate_business_rows(raw(spark, d), BUSINESS_COLS)


@query("value_lists", _reg_sql(_H6, "SELECT * FROM h6"))
def value_lists(spark, d):
    return Q.value_lists(raw(spark, d), VALUE_COLS)


@query("excluded_classes", _reg_sql(_H8, "SELECT * FROM h8"))
def excluded_classes(spark, d):
    return Q.excluded_classes(raw(spark, d))


@query("duplicates_removed", _reg_sql(_H9, "SELECT * FROM h9"))
def duplicates_removed(spark, d):
    r = raw(spark, d)
    return Q.removed_duplicates(car_rows(r), reg(spark, d))


@query("unclassifiable", _reg_sql(_H11, "SELECT * FROM h11"))
def unclassifiable(spark, d):
    return _core_findings(spark, d)[2]


@query("code_unresolved_finding", _reg_sql(_H12, "SELECT * FROM h12"))
def code_unresolved_finding(spark, d):
    return _core_findings(spark, d)[3]


@query("unconvertible_core", _reg_sql(_H13, "SELECT * FROM h13"))
def unconvertible_core(spark, d):
    return _core_findings(spark, d)[4]


_ALL = _H1 + _H2 + _H3 + _H4 + _H5 + _H6 + _H8 + _H9 + _H11 + _H12 + _H13
_UNION = " UNION ALL ".join(f"SELECT * FROM {x}" for x in "h1 h2 h3 h4 h5 h6 h8 h9 h11 h12 h13".split())


@query("findings_by_rating", _reg_sql(_ALL + f", allf AS ({_UNION})",
                                      "SELECT bewertung, count(*) AS anzahl FROM allf GROUP BY bewertung"))
def findings_by_rating(spark, d):
    """H7: the summary of the stored findings."""
    return stored_findings(spark, d).groupBy("bewertung").agg(F.count(F.lit(1)).alias("anzahl"))


@query("critical_findings", _reg_sql(_ALL + f", allf AS ({_UNION})",
                                     "SELECT objekt, spalte, pruefung, ergebnis, einheit, kommentar FROM allf "
                                     "WHERE bewertung = 'kritisch'"))
def critical_findings(spark, d):
    """H7: the critical list, from the stored findings."""
    return stored_findings(spark, d).filter(F.col("bewertung") == "kritisch").select("objekt", "spalte", "pruefung", "ergebnis", "einheit",
                                                             "kommentar")


@query("mostly_missing", _reg_sql(_H2, "SELECT objekt, spalte, ergebnis AS prozent_fehlend FROM h2 "
                                       "WHERE pruefung LIKE 'Anteil unbelegt%' AND ergebnis > 90"))
def mostly_missing(spark, d):
    f = stored_findings(spark, d).filter((F.col("spalte").isin(MISSING_COLS)) & F.col("pruefung").startswith("Anteil unbelegt") & (F.col("ergebnis") > 90))    # B28
    return f.select("objekt", "spalte", F.col("ergebnis").alias("prozent_fehlend"))


@query("unique_vs_source", O.with_reg(f""", s AS (SELECT CAST(yr AS INTEGER) AS jahr,
    count(DISTINCT k * 10 + l_linenumber) AS soll FROM base GROUP BY 1),
c AS (SELECT jahr, count(*) AS n FROM reg GROUP BY jahr)
SELECT {_fc("'core'", "'registration'", "'jahr ' || CAST(s.jahr AS VARCHAR)",
            "'Eindeutige Saetze gegen die Zaehlung der Quelle'", 'coalesce(c.n, 0) - s.soll', "'Zeilen'", '0',
            f"CASE WHEN abs(coalesce(c.n, 0) - s.soll) <= {TOLERANCE} THEN 'ok' ELSE 'auffaellig' END",
            "printf('Ist %d, Soll %d', coalesce(c.n, 0), s.soll)")}
FROM s LEFT JOIN c ON c.jahr = s.jahr"""))
def unique_vs_source(spark, d):
    from ..catalog import base
    soll = (base(spark, d).groupBy(F.col("yr").alias("jahr"))
            .agg(F.countDistinct(F.col("k") * 10 + F.col("l_linenumber")).alias("soll")))
    c = reg(spark, d).groupBy("jahr").agg(F.count(F.lit(1)).alias("n"))
    j = soll.join(c, "jahr", "left").withColumn("n", F.coalesce("n", F.lit(0)))   # D3/D4
    diff = F.col("n") - F.col("soll")
    return Q.finding(j, "core", "registration", F.concat(F.lit("jahr "), F.col("jahr").cast("string")),
                     "Eindeutige Saetze gegen die Zaehlung der Quelle", diff, "Zeilen", 0,
                     F.when(F.abs(diff) <= TOLERANCE, "ok").otherwise("auffaellig"),
                     F.format_string("Ist %d, Soll %d", F.col("n"), F.col("soll")))


@query("extreme_values", O.with_rw(f"""
SELECT {_fc("'core'", "'realworld'", 'spalte', 'pruefung', 'n', "'Zeilen'", 'NULL',
            "CASE WHEN n = 0 THEN 'ok' ELSE 'auffaellig' END", 'kommentar')} FROM (
  SELECT 'dist_total_km' AS spalte, 'Gefahrene Strecke groesser als 1 Mio. km' AS pruefung,
    count(*) FILTER (WHERE dist_total_km > 1000000) AS n,
    printf('Groesster Wert %s km', CAST(CAST({rnd('max(dist_total_km) FILTER (WHERE dist_total_km > 1000000)', 0)} AS BIGINT) AS VARCHAR)) AS kommentar FROM rw
  UNION ALL SELECT 'fc_real', 'Verbrauch groesser als 100 l je 100 km', count(*) FILTER (WHERE fc_real > 100),
    printf('Groesster Wert %s l/100 km', CAST(CAST({rnd('max(fc_real) FILTER (WHERE fc_real > 100)', 0)} AS BIGINT) AS VARCHAR)) FROM rw
  UNION ALL SELECT 'gap_pct', 'Luecke groesser als 5000 %', count(*) FILTER (WHERE gap_pct > 5000), NULL FROM rw)"""))
def extreme_values(spark, d):
    return Q.extreme_values(rw(spark, d))


@query("filter_effects", O.with_all(f"""
SELECT {_fc("'core'", "'realworld'", 'spalte', 'pruefung', 'n', 'einheit', 'NULL', "'auffaellig'", 'CAST(NULL AS VARCHAR)')} FROM (
  SELECT 'used_in_calc' AS spalte, 'Quelle schliesst den Satz aus' AS pruefung,
    count(*) FILTER (WHERE NOT eea_verwendbar) AS n, 'Zeilen' AS einheit FROM rw
  UNION ALL SELECT 'dist_total_km', 'Strecke zu kurz (unter 1000 km)', count(*) FILTER (WHERE NOT hat_mindestlauf), 'Zeilen' FROM rw
  UNION ALL SELECT 'fc_wltp', 'Laborwert fehlt', count(*) FILTER (WHERE fc_wltp IS NULL OR fc_wltp <= 0), 'Zeilen' FROM rw
  UNION ALL SELECT 'ft', 'Schreibweisen, die sich nur in der Gross-/Kleinschreibung unterscheiden',
    (SELECT count(DISTINCT ft) FROM rwsrc) - (SELECT count(DISTINCT ft) FROM rw), 'Auspraegungen')"""))
def filter_effects(spark, d):
    from ..catalog import base
    src_ft = base(spark, d).select(F.when(F.col("k") % 2 == 0, F.upper("ft0")).otherwise(F.col("ft0")).alias("ft"))
    return Q.filter_effects(rw(spark, d), src_ft)


@query("dedup_latest", O.with_reg("SELECT jahr, id, m_kg, ewltp, mk, cn, dr FROM dedup"))
def dedup_latest(spark, d):
    """F8: the surviving row per (year, id), as core is typed from it."""
    from ..catalog import cars
    return cars(spark, d).select("jahr", "id", "m_kg", "ewltp", "mk", "cn", "dr")


@query("duplicate_groups", O.with_raw("""
SELECT jahr, id, count(*) AS n FROM raw GROUP BY jahr, id HAVING count(*) > 1"""))
def duplicate_groups(spark, d):
    return DD.duplicate_groups(raw(spark, d), ["jahr", "id"])


@query("duplicate_count", O.with_raw("""
SELECT CAST(sum(n) AS BIGINT) AS rows_total, count(*) AS distinct_keys, CAST(sum(n) - count(*) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS keys_with_dups
FROM (SELECT jahr, id, count(*) AS n FROM raw GROUP BY jahr, id)"""))
def duplicate_count(spark, d):
    return DD.duplicate_count(raw(spark, d), ["jahr", "id"])
