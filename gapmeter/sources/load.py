"""Sources, sinks and load bookkeeping.

File readers bind columns by header name, keep every field as text and never
fail on one bad value; quarantine splits malformed rows off instead of
dropping them. Sinks write Parquet (partitioned by year with dynamic
overwrite, so reloading a year replaces exactly that year) or ``;`` CSV.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize


EMPTY_SENTINEL = "\u0000EMPTY\u0000"
# Fixed value: the reference's table-name pattern for year, status and version.
VERSION_PATTERN = r"^co2cars_([0-9]{4})([FP])v([0-9]+)$"


# -- readers -------------------------------------------------------------------

def read_text_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A1: all-text CSV with header; an unquoted empty field is NULL, a quoted
    "" stays the empty string (a sentinel carries it through the reader).
    Quotes inside a field are doubled. ``multi_line`` also reads line breaks
    inside quotes; such files can't be split, so use many files."""
    df = (spark.read.option("header", True).option("sep", sep).option("emptyValue", EMPTY_SENTINEL)
          .option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("inferSchema", False).csv(path))
    return df.select(*[F.when(F.col(c) == EMPTY_SENTINEL, F.lit("")).otherwise(F.col(c)).alias(c)
                       for c in df.columns])


def read_null_word_csv(spark: SparkSession, path: str, null_word: str = "NULL") -> DataFrame:
    """A2/A3: CSV whose missing values are a word; RFC-4180 quotes keep commas."""
    return (spark.read.option("header", True).option("nullValue", null_word).option("quote", '"')
            .option("escape", '"').option("inferSchema", False).csv(path))


def read_by_header(spark: SparkSession, path: str, wanted: list[str] | None = None,
                   min_columns: int = 3) -> DataFrame:
    """A5: bind by header names (never by position); fewer than ``min_columns`` is an error.
    With ``wanted`` the columns are selected by name in that order; missing
    ones are added as NULL (A10)."""
    files = _files(spark, path)
    out = None
    for group in files.values():      # one read per distinct header, not per file
        df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
              .option("inferSchema", False).csv(group))
        if len(df.columns) < min_columns:
            raise ValueError(f"header of {group[0]} has {len(df.columns)} columns, expected >= {min_columns}")
        if wanted is not None:
            df = bind(df, wanted)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def bind(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns in their order; those that ``df`` lacks as NULL (A10)."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in wanted])


def _files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> files below ``path`` that begin with it. Of each file the first line is read, and nothing else."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = root.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    names, todo = [], fs.listFiles(root, True)
    while todo.hasNext():
        f = todo.next()
        if f.getLen() and not f.getPath().getName().startswith(("_", ".")):
            names.append(f.getPath())
    out: dict[str, list[str]] = {}
    for p in sorted(names, key=lambda p: p.toString()):     # a line per file
        stream, codec = fs.open(p), codecs.getCodec(p)
        stream = stream if codec is None else codec.createInputStream(stream)
        try:
            line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"), 4096).readLine()
        finally:
            stream.close()
        out.setdefault(line, []).append(p.toString())
    return out


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    """A10: expected columns the source did not deliver."""
    return [c for c in expected if c not in df.columns]


def quarantine_csv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows with the wrong number of fields into a quarantine frame
    (raw line kept), good rows typed as text. Too few and too many fields
    are both caught by the PERMISSIVE parser's corrupt-record column. The
    header line of each file is no row; commas inside quotes separate nothing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] +
                          [T.StructField("_corrupt", T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
          .option("quote", '"').option("escape", '"').option("enforceSchema", True)
          .option("columnPruning", False)   # a pruned parse doesn't see how many fields a line has
          .option("columnNameOfCorruptRecord", "_corrupt").option("emptyValue", EMPTY_SENTINEL).csv(path))
    df = df.select(*[F.when(F.col(c) == EMPTY_SENTINEL, F.lit("")).otherwise(F.col(c)).alias(c) for c in columns],
                   "_corrupt")
    # Spark requires the corrupt column to be materialised before filtering on it
    df = df.withColumn("_bad", F.col("_corrupt").isNotNull())
    good = df.filter(~F.col("_bad")).select(*columns)
    # the quarantine keeps the raw line and what the parser could read of it
    bad = df.filter(F.col("_bad")).select(F.col("_corrupt").alias("zeile"),
                                          count_fields(F.col("_corrupt")).alias("felder"), *columns)
    return good, bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(datei, zeilennummer, zeile): every line of the text files below ``path`` with its number, from 1.

    Files are read in splits. Lines are counted per split, running totals over a file's splits give each split the
    number it starts after, and a line's place in its split does the rest: no file is read by one task, no line moves."""
    at = F.struct(F.col("_metadata.file_path").alias("datei"), F.col("_metadata.file_block_start").alias("ab"))
    lines = spark.read.text(path).select(F.col("value").alias("zeile"), at.alias("_s"), F.monotonically_increasing_id().alias("_i"))
    splits = lines.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_first"))
    before = Window.partitionBy("_s.datei").orderBy("_s.ab").rowsBetween(Window.unboundedPreceding, -1)
    # one row per split of the input, some dozens of bytes each
    starts = splits.select(F.col("_s").alias("_t"), "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return lines.join(F.broadcast(materialize(starts)), F.col("_s") == F.col("_t")).select(
        F.col("_s.datei").alias("datei"), (F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("zeilennummer"), "zeile")


def bad_lines(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Lines that don't have ``columns`` fields, with file, number, fields and their first 150 characters. The
    first line of a file is its header and must have as many; empty lines are bad."""
    return numbered_lines(spark, path).withColumn("felder", F.when(F.col("zeile") == "", 0).otherwise(count_fields(F.col("zeile")))) \
        .filter(F.col("felder") != columns).select("datei", "zeilennummer", F.col("felder").cast("int").alias("felder"), F.substring("zeile", 1, 150).alias("anfang"))


def first_bad_lines(bad: DataFrame, n: int = 25) -> DataFrame:
    """The report's list: the first ``n`` bad lines by file and line number."""
    return bad.orderBy("datei", "zeilennummer").limit(n)


def count_fields(line: Column) -> Column:
    """Fields of a CSV line: separators outside quotes, plus one."""
    return F.regexp_count(F.regexp_replace(line, '"(?:[^"]|"")*"', ""), F.lit(",")) + 1


def quarantine_report(good: DataFrame, bad: DataFrame, key: str, expected: int) -> DataFrame:
    """One row: good and bad lines, repeated ids among the good ones, difference to the expected count."""
    ids = good.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("gut"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("doppelte_ids"))
    # written first: Spark refuses to parse text for the corrupt line alone
    counts = materialize(bad).agg(F.count(F.lit(1)).alias("quarantaene"), F.min("felder").cast("long").alias("felder_min"), F.max("felder").cast("long").alias("felder_max"))
    one = ids.select("*", F.lit(0).alias("_k")).join(counts.select("*", F.lit(0).alias("_k")), "_k").drop("_k")
    return one.withColumn("differenz", F.col("gut") + F.col("quarantaene") - F.lit(expected))


def read_series_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON document per carrier and week, {"series": [[epoch_ms, value], ...]};
    carrier from the file name (``<carrier>_<week>.json``) or a folder ``traeger=<carrier>``.
    ``multi_line``: a document per file, else per line. Null values are
    dropped; for a repeated instant the later file/position wins; result is
    long form (instant, carrier, value)."""
    schema = "series array<array<double>>"
    raw = (spark.read.schema(schema).option("multiLine", multi_line).json(path)
           .withColumn("_file", F.input_file_name()))
    carrier = F.col("traeger") if "traeger" in raw.columns else F.regexp_extract("_file", r"([^/]+)_[^/_]+\.json$", 1)
    pts = raw.select(carrier.alias("traeger"), "_file",
                     F.posexplode("series").alias("_pos", "p"))
    pts = pts.select("traeger", "_file", "_pos", F.col("p")[0].cast("long").alias("epoch_ms"),
                     F.col("p")[1].alias("wert")).filter(F.col("wert").isNotNull())
    return (pts.groupBy("epoch_ms", "traeger")
            .agg(F.max_by("wert", F.struct("_file", "_pos")).alias("wert")))


def series_long_to_wide(long: DataFrame, carriers: list[str]) -> DataFrame:
    """One row per instant, one column per carrier (pivot over a fixed list)."""
    return long.groupBy("epoch_ms").pivot("traeger", carriers).agg(F.first("wert"))


# -- sinks ---------------------------------------------------------------------

def write_semicolon_csv(df: DataFrame, path: str) -> None:
    """A21: ';'-separated profile file with header."""
    df.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def reload_years(df: DataFrame, path: str, year_col: str = "jahr") -> None:
    """Idempotent reload -- dynamic partition overwrite replaces only the
    years present in ``df``; other years stay untouched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(year_col).parquet(path)


def write_mart(df: DataFrame, path: str) -> None:
    """Drop-and-create a result table (whole overwrite)."""
    df.write.mode("overwrite").parquet(path)


def append_findings(findings: DataFrame, path: str, truncate: bool = False) -> None:
    """Append findings to the findings table; ``truncate`` empties it first
    (the reference clears findings at the start of the raw checks)."""
    findings.write.mode("overwrite" if truncate else "append").parquet(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Empty-input guard -- abort before computing on nothing. One cheap
    action (``isEmpty`` stops at the first row)."""
    if df.isEmpty():
        raise ValueError(f"input '{what}' is empty: step aborted, nothing written")
    return df


def optional_input(spark: SparkSession, path: str, what: str) -> DataFrame | None:
    """Read an optional input; a missing one is skipped with a notice."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        print(f"notice: optional input '{what}' not found at {path}; dependent step skipped")
        return None
    return spark.read.parquet(path)


def insert_if_absent(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target`` appended to ``target``."""
    return target.unionByName(new.join(target.select(*key), key, "left_anti"))


# -- load bookkeeping ------------------------------------------------------------

def parse_version(name_col: str) -> list:
    """Year, status (F/P) and version number from a table name."""
    c = F.col(name_col)
    return [F.regexp_extract(c, VERSION_PATTERN, 1).try_cast("int").alias("jahr_name"),
            F.nullif(F.regexp_extract(c, VERSION_PATTERN, 2), F.lit("")).alias("data_status"),
            F.regexp_extract(c, VERSION_PATTERN, 3).try_cast("int").alias("version")]


def load_audit(raw: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows written per year vs counted at the source, with version
    and status parsed from the file name; non-zero difference = warning."""
    ist = raw.groupBy("jahr").agg(F.max("version_file").alias("version_file"), F.count(F.lit(1)).alias("ist"))
    j = expected.join(ist, "jahr", "left")
    c = F.col("version_file")
    diff = F.coalesce("ist", F.lit(0)) - F.col("soll")
    return j.select("jahr", "version_file",
                    F.regexp_extract(c, VERSION_PATTERN.replace("([0-9]{4})", "[0-9]{4}"), 1).alias("data_status"),
                    F.regexp_extract(c, VERSION_PATTERN.replace("([0-9]{4})", "[0-9]{4}"), 2).try_cast("int")
                    .alias("version"),
                    "soll", F.coalesce("ist", F.lit(0)).alias("ist"), diff.alias("differenz"),
                    F.when(diff == 0, "F").otherwise("P").alias("status"))


def pick_versions(names: DataFrame, name_col: str = "tabelle") -> DataFrame:
    """Per year the final (F) table before a provisional (P) one, then the highest version."""
    # the source publishes a new version only with corrections, so the highest one is taken
    p = names.select(name_col, *parse_version(name_col)).withColumnRenamed("jahr_name", "jahr") \
        .withColumnRenamed("data_status", "status")
    w = Window.partitionBy("jahr").orderBy(F.when(F.col("status") == "F", 0).otherwise(1), F.col("version").desc())
    return (p.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select("jahr", name_col, "status", "version"))


#: Halvings that one round of ``key_windows`` decides.
HALVINGS = 8
#: Up to so many windows are broadcast; more are joined by key.
BROADCAST_WINDOWS = 10_000


def key_windows(df: DataFrame, key: str, rows_per_window: int = 50_000) -> DataFrame:
    """A7 re-aimed: windows [von, bis) over the key range with at most ``rows_per_window`` rows each, and their rows.

    The range is halved, and each half again, as long as it holds too many rows; ranges without rows are left out. So dense
    stretches get narrow windows and gaps none, and only a single key can fill a window beyond
    its bound (``wiederholt``). A round counts the rows of windows that are too full by 256 parts of
    each, which decides eight halvings: at most eight rounds for any 64-bit key. Null keys are in no window.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"))
    s = rows.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    spark = df.sparkSession
    if not s["n"]:
        return spark.createDataFrame([], "von long, bis long, zeilen long, wiederholt boolean")
    depth = max(1, (s["hi"] - s["lo"]).bit_length())
    if depth > 62:
        raise ValueError("the key range exceeds 62 bits")
    place = F.col("_k") - F.lit(s["lo"]).cast("long")
    level, too_full = 0, None
    done = spark.createDataFrame([(0, 0, s["n"])], "level int, id long, n long")
    if s["n"] > rows_per_window:
        done, too_full = done.limit(0), done
    while too_full is not None:
        step = min(HALVINGS, depth - level)
        x = rows
        if level:
            opened = too_full.select(F.col("id").alias("_open"))
            opened = F.broadcast(opened) if too_full.count() <= BROADCAST_WINDOWS else opened
            x = rows.join(opened, F.shiftright(place, depth - level) == F.col("_open"), "left_semi")
        parts = x.groupBy(F.shiftright(place, depth - level - step).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        # rows of each part's ancestors, as many levels up as the round decides: a window per open range
        up = lambda j: F.shiftright("id", step - j)
        held = parts.select("id", "n", *[F.sum("n").over(Window.partitionBy(up(j))).alias(f"n{j}") for j in range(1, step + 1)])
        fits = F.coalesce(*[F.when(F.col(f"n{j}") <= rows_per_window, F.lit(j)) for j in range(1, step + 1)])
        held = held.withColumn("_j", fits)
        found = materialize(held.select(F.coalesce("_j", F.lit(step)).alias("_j"), F.col("_j").isNull().alias("_full"), "id", "n")
                            .withColumn("id", F.expr(f"shiftright(id, {step} - _j)"))
                            .groupBy("_j", "_full", "id").agg(F.sum("n").alias("n")).select((F.col("_j") + level).alias("level"), "id", "n", "_full"))
        level += step
        closed = found if level == depth else found.filter(~F.col("_full"))
        done = done.unionByName(closed.select("level", "id", "n"))
        full = found.filter("_full").select("level", "id", "n")
        too_full = full if level < depth and full.limit(1).count() else None
    von = F.lit(s["lo"]).cast("long") + F.expr(f"shiftleft(id, {depth} - level)")
    return done.select(von.alias("von"), (von + F.expr(f"shiftleft(1L, {depth} - level)")).alias("bis"), F.col("n").alias("zeilen"),
                       (F.col("n") > rows_per_window).alias("wiederholt"))
