"""Data-quality findings.

Every check returns rows of one finding schema (layer, object, column, check,
result, unit, threshold, rating, comment). Checks over many columns of one
table run as ONE scan: conditional aggregates into one wide row (or one row
per year), then ``unpivot`` to long form -- never one scan per column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scalars import rnd

FINDING_COLUMNS = ["schicht", "objekt", "spalte", "pruefung", "ergebnis", "einheit", "schwelle",
                   "bewertung", "kommentar"]


def finding(df: DataFrame, schicht, objekt, spalte, pruefung, ergebnis, einheit, schwelle,
            bewertung, kommentar) -> DataFrame:
    """Project any per-check DataFrame to the finding schema."""
    def lit(x, t="string"):
        return x if isinstance(x, Column) else F.lit(x).cast(t)
    return df.select(lit(schicht).alias("schicht"), lit(objekt).alias("objekt"),
                     lit(spalte).alias("spalte"), lit(pruefung).alias("pruefung"),
                     lit(ergebnis, "double").cast("double").alias("ergebnis"), lit(einheit).alias("einheit"),
                     lit(schwelle, "double").cast("double").alias("schwelle"),
                     lit(bewertung).alias("bewertung"), lit(kommentar).alias("kommentar"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of checks of one shape."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts_vs_expected(actual: DataFrame, expected: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """H1 / D3: per year x country, actual vs expected (missing actual -> 0)."""
    a = actual.groupBy("jahr", "ms").agg(F.count(F.lit(1)).alias("ist"))
    j = expected.join(a, ["jahr", "ms"], "left").withColumn("ist", F.coalesce("ist", F.lit(0)))
    diff = F.col("ist") - F.col("soll")
    rating = (F.when(diff == 0, "ok").when(F.abs(diff) < F.col("soll") * tolerance, "auffaellig")
              .otherwise("kritisch"))
    return finding(j, "raw", F.concat(F.lit("co2cars_"), F.col("jahr")), F.col("ms"),
                   "Geladene gegen gezaehlte Zeilen", diff, "Zeilen Differenz", 0, rating,
                   F.format_string("Soll %d, Ist %d", F.col("soll"), F.col("ist")))


def missing_share(raw: DataFrame, cols: list[str]) -> DataFrame:
    """H2: share of NULL-or-empty per year x column, one scan + unpivot."""
    wide = raw.groupBy("jahr").agg(F.count(F.lit(1)).alias("_n"), *[
        F.count(F.when(F.col(c).isNull() | (F.col(c) == ""), 1)).alias(c) for c in cols])
    long = wide.unpivot(["jahr", "_n"], cols, "spalte", "fehlend")
    pct = rnd(F.col("fehlend") * 100.0 / F.col("_n"), 2)
    rating = F.when(F.col("fehlend") == 0, "ok").when(F.col("fehlend") < F.col("_n"), "auffaellig").otherwise("kritisch")
    return finding(long, "raw", F.concat(F.lit("co2cars_"), F.col("jahr")), F.col("spalte"),
                   "Anteil unbelegter Felder", pct, "%", None, rating,
                   F.format_string("%d von %d Saetzen ohne Wert", F.col("fehlend"), F.col("_n")))


def unconvertible(raw: DataFrame, cols: list[str]) -> DataFrame:
    """H3: values present but not numeric-shaped (strict, untrimmed), with the
    smallest offending value as example -- one scan."""
    def bad(c):
        return F.col(c).isNotNull() & (F.col(c) != "") & ~S.strict_number_shape(F.col(c))
    aggs = []
    for c in cols:
        aggs += [F.count(F.when(bad(c), 1)).alias(f"{c}__n"), F.min(F.when(bad(c), F.col(c))).alias(f"{c}__ex")]
    wide = raw.groupBy("jahr").agg(*aggs)
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(f"{c}__n"), F.col(f"{c}__ex"))])
    long = wide.select("jahr", st.alias("spalte", "anzahl", "beispiel"))
    return finding(long, "raw", F.concat(F.lit("co2cars_"), F.col("jahr")), F.col("spalte"),
                   "Text ist keine Zahl", F.col("anzahl"), "Saetze", 0,
                   F.when(F.col("anzahl") == 0, "ok").otherwise("kritisch"),
                   F.concat(F.lit("Beispielwert: "), F.coalesce(F.col("beispiel"), F.lit("-"))))


#: Plausibility rules: column, title, (kind, arguments). Thresholds are fixed values.
RANGE_RULES = [
    ("m_kg", "Masse ausserhalb 500 bis 3500 kg", ("outside", 500, 3500)),
    ("ewltp", "WLTP-Ausstoss groesser als 500 g/km", ("above", 500)),
    ("ewltp", "Verbrenner ohne WLTP-Ausstoss", ("zero_unless_fuel", "electric", "hydrogen")),
    ("ewltp", "Elektroantrieb mit WLTP-Ausstoss", ("above_zero_for_fuel", "electric")),
    ("ep_kw", "Leistung ausserhalb 10 bis 800 kW", ("outside", 10, 800)),
    ("dr", "Zulassung nicht im Berichtsjahr", ("other_year",)),
    ("r_count", "Satz zaehlt nicht als ein Fahrzeug", ("filled_but_not", "1")),
]


def _breaks(column: str, kind: str, *args) -> Column:
    text, ft = F.col(column), F.col("ft")
    number = F.when(text.rlike(r"\A[0-9.]+\z"), text.try_cast("double"))      # '1.2.3' counts as no value (T13)
    return {
        "outside": lambda lo, hi: (number < lo) | (number > hi),
        "above": lambda x: number > x,
        "zero_unless_fuel": lambda *fuels: (number == 0) & ~ft.isin(*fuels),
        "above_zero_for_fuel": lambda fuel: (number > 0) & (ft == fuel),
        "other_year": lambda: text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}") & S.year_prefix_mismatch(column, "jahr"),
        "filled_but_not": lambda x: (text != "") & (text != x),
    }[kind](*args)


def range_rules(raw: DataFrame) -> DataFrame:
    """H4: all range rules in one scan."""
    wide = raw.agg(*[F.count(F.when(_breaks(c, *rule), 1)).alias(f"r{i}") for i, (c, _, rule) in enumerate(RANGE_RULES)])
    st = F.stack(F.lit(len(RANGE_RULES)), *[x for i, (c, p, _) in enumerate(RANGE_RULES)
                                            for x in (F.lit(c), F.lit(p), F.col(f"r{i}"))])
    long = wide.select(st.alias("spalte", "pruefung", "anzahl"))
    return finding(long, "raw", "co2cars_alle", F.col("spalte"), F.col("pruefung"), F.col("anzahl"), "Saetze", 0,
                   F.when(F.col("anzahl") == 0, "ok").otherwise("auffaellig"), None)


def value_lists(raw: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct count and ordered distinct value list per column."""
    wide = raw.agg(*[x for c in cols for x in (
        F.countDistinct(c).alias(f"{c}__n"),
        F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(f"{c}__v"))])
    st = F.stack(F.lit(len(cols)), *[x for c in cols for x in (F.lit(c), F.col(f"{c}__n"), F.col(f"{c}__v"))])
    long = wide.select(st.alias("spalte", "n", "werte"))
    return finding(long, "raw", "co2cars_alle", F.col("spalte"), "Verschiedene Werte",
                   F.col("n"), "Werte", None, "ok", F.col("werte"))


def duplicate_business_rows(raw: DataFrame, cols: list[str]) -> DataFrame:
    """H5: number of groups of identical business rows (count > 1)."""
    g = raw.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    c = g.agg(F.count(F.lit(1)).alias("gruppen"))
    return finding(c, "raw", "co2cars_alle", None,
                   "Gruppen gleicher Saetze unter mehreren IDs", F.col("gruppen"),
                   "Gruppen", None, F.when(F.col("gruppen") == 0, "ok").otherwise("auffaellig"), None)


def excluded_classes(raw: DataFrame) -> DataFrame:
    """H8: rows dropped by the class filter, per class, '(leer)' for empty."""
    cls = S.vehicle_class("ct")
    g = raw.filter(~cls.isin(S.CAR_CLASSES)).groupBy(cls.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return finding(g, "core", "registration", "fahrzeugklasse", "Keine Pkw, nicht uebernommen",
                   F.col("n"), "Zeilen", None, "auffaellig",
                   F.concat(F.lit("Fahrzeugklasse "), S.blank_label(F.col("k")), F.lit(" gehoert nicht zu M1/M1G")))


def counts_row(**frames: DataFrame) -> DataFrame:
    """Row counts of several DataFrames side by side in ONE row (D16 scalar
    subqueries): a union of tagged empty projections and one aggregate -- no
    join, each input scanned once."""
    tagged = [df.select(F.lit(k).alias("_src")) for k, df in frames.items()]
    u = union_all(tagged)
    return u.agg(*[F.count(F.when(F.col("_src") == k, 1)).alias(k) for k in frames])


def removed_duplicates(cars: DataFrame, core: DataFrame) -> DataFrame:
    """H9: rows removed by dedup = filtered raw count - core count."""
    j = counts_row(a=cars, b=core)
    d = F.col("a") - F.col("b")
    return finding(j, "core", "registration", "src_id",
                   "Mehrfach gelieferte Satz-ID, nicht uebernommen", d, "Zeilen", 0,
                   F.when(d == 0, "ok").otherwise("auffaellig"), None)


def count_finding(df: DataFrame, cond: Column, objekt: str, spalte: str, pruefung: str,
                  critical: bool = False, layer: str = "core") -> DataFrame:
    """H11-H13 style: count rows matching a condition."""
    c = df.agg(F.count(F.when(cond, 1)).alias("n"))
    bad = "kritisch" if critical else "auffaellig"
    return finding(c, layer, objekt, spalte, pruefung, F.col("n"), "Zeilen", 0,
                   F.when(F.col("n") == 0, "ok").otherwise(bad), None)


def extreme_values(rw: DataFrame) -> DataFrame:
    """Three extreme-value counts with the largest value in the message -- one scan."""
    one = rw.agg(
        F.count(F.when(F.col("dist_total_km") > 1_000_000, 1)).alias("n1"),
        F.max(F.when(F.col("dist_total_km") > 1_000_000, F.col("dist_total_km"))).alias("m1"),
        F.count(F.when(F.col("fc_real") > 100, 1)).alias("n2"),
        F.max(F.when(F.col("fc_real") > 100, F.col("fc_real"))).alias("m2"),
        F.count(F.when(F.col("gap_pct") > 5000, 1)).alias("n3"))
    st = F.stack(F.lit(3),
                 F.lit("dist_total_km"), F.lit("Gefahrene Strecke groesser als 1 Mio. km"), F.col("n1"),
                 F.when(F.col("m1").isNotNull(),
                        F.format_string("Groesster Wert %s km", rnd("m1", 0).cast("bigint").cast("string"))),
                 F.lit("fc_real"), F.lit("Verbrauch groesser als 100 l je 100 km"), F.col("n2"),
                 F.when(F.col("m2").isNotNull(),
                        F.format_string("Groesster Wert %s l/100 km", rnd("m2", 0).cast("bigint").cast("string"))),
                 F.lit("gap_pct"), F.lit("Luecke groesser als 5000 %"), F.col("n3"), F.lit(None).cast("string"))
    long = one.select(st.alias("spalte", "pruefung", "n", "kommentar"))
    return finding(long, "core", "realworld", F.col("spalte"), F.col("pruefung"), F.col("n"), "Zeilen", None,
                   F.when(F.col("n") == 0, "ok").otherwise("auffaellig"), F.col("kommentar"))


def filter_effects(rw: DataFrame, raw_ft: DataFrame) -> DataFrame:
    """Four filter-effect counts -- all four are written (trap T1).
    ``raw_ft`` is the source's fuel-type column before case folding."""
    core = rw.select(F.lit(True).alias("_core"), "eea_verwendbar", "hat_mindestlauf", "fc_wltp", "ft")
    src = raw_ft.select(F.lit(False).alias("_core"), F.lit(None).cast("boolean").alias("eea_verwendbar"),
                        F.lit(None).cast("boolean").alias("hat_mindestlauf"),
                        F.lit(None).cast("double").alias("fc_wltp"), F.col("ft"))
    c = F.col("_core")
    j = core.unionByName(src).agg(
        F.count(F.when(c & ~F.col("eea_verwendbar"), 1)).alias("n1"),
        F.count(F.when(c & ~F.col("hat_mindestlauf"), 1)).alias("n2"),
        F.count(F.when(c & (F.col("fc_wltp").isNull() | (F.col("fc_wltp") <= 0)), 1)).alias("n3"),
        F.countDistinct(F.when(c, F.col("ft"))).alias("core_ft"),
        F.countDistinct(F.when(~c, F.col("ft"))).alias("raw_ft"))
    st = F.stack(F.lit(4),
                 F.lit("used_in_calc"), F.lit("Quelle schliesst den Satz aus"), F.col("n1"), F.lit("Zeilen"),
                 F.lit("dist_total_km"), F.lit("Strecke zu kurz (unter 1000 km)"), F.col("n2"), F.lit("Zeilen"),
                 F.lit("fc_wltp"), F.lit("Laborwert fehlt"), F.col("n3"), F.lit("Zeilen"),
                 F.lit("ft"), F.lit("Schreibweisen, die sich nur in der Gross-/Kleinschreibung unterscheiden"),
                 F.col("raw_ft") - F.col("core_ft"), F.lit("Auspraegungen"))
    long = j.select(st.alias("spalte", "pruefung", "n", "einheit"))
    return finding(long, "core", "realworld", F.col("spalte"), F.col("pruefung"), F.col("n"), F.col("einheit"),
                   None, "auffaellig", None)
