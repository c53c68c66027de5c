"""Star schema: dimensions, partitioned fact, contracts.

Surrogate keys are dense numbers that persist over reloads (``keys.py``). The fact joins its
dimensions on the natural text key and has a dense row key of its own. Dimensions are stored
tables: they are counted, broadcast up to ``BROADCAST_ROWS`` members, and shuffled otherwise. A fact row without a country, or with a code nobody lists, keeps its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import SMALL_GROUPS, unsorted_writes
from . import keys as K

#: Key of the unknown member of the country dimension, which rows without a code belong to.
UNKNOWN_SK = 0
UNKNOWN = "unbekannt"
#: Up to so many members of a stored dimension (key and number) are broadcast to the fact.
BROADCAST_ROWS = 500_000
#: Natural key of each dimension that the fact joins.
NATURAL = {"manufacturer": "schluessel", "model": "schluessel", "powertrain": "schluessel", "country": "ms_code"}


def country_parameters(nation: DataFrame, region: DataFrame, focus: list[str]) -> DataFrame:
    """The country table as data: code, name, region, focus flag."""
    j = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return j.select(F.col("n_name").alias("ms_code"), F.initcap(F.regexp_replace("n_name", "_", " ")).alias("land_name"),
                    F.col("r_name").alias("region"), F.col("n_name").isin(focus).alias("ist_fokusland"))


def dim_country(reg: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """All listed codes and all codes seen; what is not listed (yet) has unknown attributes, but a key of its own."""
    seen = reg.select(F.col("ms").alias("ms_code")).filter(F.col("ms").isNotNull()).distinct()
    if parameters is None:
        parameters = reg.sparkSession.createDataFrame([], "ms_code string, land_name string, region string, ist_fokusland boolean")
    codes = seen.unionByName(parameters.select("ms_code")).distinct()
    return codes.join(parameters, "ms_code", "left").select(
        "ms_code", F.coalesce("land_name", F.lit(UNKNOWN)).alias("land_name"), F.coalesce("region", F.lit(UNKNOWN)).alias("region"),
        F.coalesce("ist_fokusland", F.lit(False)).alias("ist_fokusland"), F.col("land_name").isNotNull().alias("ist_gelistet"))


def unknown_country(dim: DataFrame) -> DataFrame:
    """The member for rows without a code."""
    values = {"country_sk": UNKNOWN_SK, "ms_code": None, "land_name": UNKNOWN, "region": UNKNOWN, "ist_fokusland": False, "ist_gelistet": False}
    return dim.sparkSession.range(1).select(*[F.lit(values[f.name]).cast(f.dataType).alias(f.name) for f in dim.schema])


def keyed(name: str, dim: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A dimension with its surrogate keys: the stored ones, and the next numbers for new members."""
    nat, sk = [NATURAL[name]], f"{name}_sk"
    if stored is not None and name == "country":
        stored = stored.filter(F.col(sk) != UNKNOWN_SK)
    out = K.with_keys(dim, K.extend(stored, dim, nat, sk), nat, sk)
    return out.unionByName(unknown_country(out)) if name == "country" else out


def dim_manufacturer(reg: DataFrame) -> DataFrame:
    d = reg.select("mp_pool", "mh_name", "man_name").distinct()
    return d.select(
        S.pipe_key("mp_pool", "mh_name", "man_name").alias("schluessel"),
        "mp_pool", "mh_name", "man_name",
        S.settlement_unit("mp_pool", "mh_name", "man_name").alias("hersteller_gruppe"),
        F.col("mp_pool").isNotNull().alias("ist_gepoolt"))


def dim_model(reg: DataFrame) -> DataFrame:
    d = reg.select("marke", "handelsname", "marke_norm", "handelsname_norm").distinct()
    return d.select(S.pipe_key("marke", "handelsname").alias("schluessel"),
                    "marke", "handelsname", "marke_norm", "handelsname_norm")


def dim_powertrain(reg: DataFrame) -> DataFrame:
    d = reg.select("ft", "fm", "antriebsklasse", "ist_elektrifiziert", "ist_extern_ladbar").distinct()
    return d.select(S.pipe_key("ft", "fm").alias("schluessel"), "ft", "fm", "antriebsklasse",
                    S.class_label("antriebsklasse").alias("antrieb_label"),
                    "ist_elektrifiziert", "ist_extern_ladbar")


def dim_date(reg: DataFrame) -> DataFrame:
    """One row per day over the whole years the data covers, plus row 0."""
    span = reg.agg(F.min("zulassung_datum").alias("lo"), F.max("zulassung_datum").alias("hi"))
    days = span.select(F.explode(F.sequence(F.trunc("lo", "year"),
                                            F.date_add(F.add_months(F.trunc("hi", "year"), 12), -1),
                                            F.expr("interval 1 day"))).alias("datum"))
    d = days.select(S.date_key("datum").alias("date_sk"), "datum",
                    F.year("datum").alias("jahr"), F.quarter("datum").alias("quartal"),
                    F.month("datum").alias("monat"), F.date_format("datum", "MMMM").alias("monat_name"),
                    F.weekofyear("datum").alias("kw"), (F.weekday("datum") + 1).alias("wochentag"))
    unknown = span.select(F.lit(0).alias("date_sk"), F.lit(None).cast("date").alias("datum"),
                          F.lit(None).cast("int").alias("jahr"), F.lit(None).cast("int").alias("quartal"),
                          F.lit(None).cast("int").alias("monat"), F.lit("unbekannt").alias("monat_name"),
                          F.lit(None).cast("int").alias("kw"), F.lit(None).cast("int").alias("wochentag"))
    return d.unionByName(unknown)


def fact(reg: DataFrame, dims: dict[str, DataFrame] | None = None, stable: bool = False) -> DataFrame:
    """Core joined to its four dimensions on text keys; every core row is a fact row.

    ``dims`` are the dimensions with their keys (without: a first load, made from ``reg``). ``stable``: ``reg`` is a
    plain scan of a finished table."""
    stored = dims is not None
    if dims is None:
        dims = {n: keyed(n, build(reg)) for n, build in (("manufacturer", dim_manufacturer), ("model", dim_model), ("powertrain", dim_powertrain), ("country", dim_country))}
    r = K.numbered(reg, "fact_sk", stable=stable).select(
        "fact_sk", "src_id", "jahr", S.date_key("zulassung_datum").alias("date_sk"), "ms",
        S.pipe_key("mp_pool", "mh_name", "man_name").alias("_manufacturer"),
        S.pipe_key("marke", "handelsname").alias("_model"),
        S.pipe_key("ft", "fm").alias("_powertrain"), F.col("ms").alias("_country"),
        "masse_kg", "pruefmasse_kg", "co2_wltp", "leistung_kw", "strom_wh_km",
        "oeko_gutschrift", "oeko_codes", "data_status", "source_version")
    for name, nat in NATURAL.items():
        one = dims[name].select(F.col(nat).alias(f"_{name}"), f"{name}_sk")
        if stored and dims[name].count() <= BROADCAST_ROWS:
            one = F.broadcast(one)
        r = r.join(one, f"_{name}", "left" if name == "country" else "inner").drop(f"_{name}")
    return r.withColumn("country_sk", F.coalesce("country_sk", F.lit(UNKNOWN_SK)))


def key_checks(dims: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Per dimension rows, distinct natural keys (none is one, too: the unknown member), distinct surrogate keys."""
    out = None
    for name, (df, nat, sk) in dims.items():
        one = df.agg(F.lit(name).alias("dimension"), F.count(F.lit(1)).alias("zeilen"),
                     F.countDistinct(F.struct(nat)).alias("schluessel_distinct"),
                     F.countDistinct(sk).alias("sk_distinct"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", (F.col("zeilen") == F.col("schluessel_distinct")) &
                          (F.col("zeilen") == F.col("sk_distinct")))


def orphans(f: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Per dimension the fact rows whose key (a null one too) it lacks."""
    out = None
    for name, dim in dims.items():
        sk = f"{name}_sk"
        one = f.select(sk).join(dim.select(sk), sk, "left_anti").agg(F.lit(name).alias("fk"), F.count(F.lit(1)).alias("verwaist"))
        out = one if out is None else out.unionByName(one)
    return out


def write_fact(f: DataFrame, path: str, files_per_year: int | None = None) -> None:
    """Year-partitioned fact; dynamic overwrite replaces only the years
    present in ``f`` (idempotent reload of one year, A6), also in a session
    that is set to static. Each task writes the years of its rows, so a year
    holding a third of all rows is written by many tasks, and no row moves. With
    ``files_per_year`` each year is spread over so many tasks by a hash of the row id."""
    if files_per_year:
        f = f.repartition(F.col("jahr"), F.pmod(F.xxhash64("src_id"), F.lit(files_per_year)))
    with unsorted_writes(f.sparkSession):
        f.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**SMALL_GROUPS).partitionBy("jahr").parquet(path)
