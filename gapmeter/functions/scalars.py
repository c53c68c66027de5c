"""Scalar cleaning and derivation functions.

Every function maps Columns to a Column built from ``pyspark.sql.functions``
only, so Catalyst can fold, push down and code-generate them; there is no
Python UDF anywhere on this path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values that must equal the reference for identical results.
# Number shape accepted after comma->dot (B1).
NUMBER_SHAPE = r"\A-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"
# Date prefix shape (B2).
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
# Drive class by fuel type and fuel mode, first matching row wins; None matches anything.
DRIVE_RULES = [
    ("hydrogen", None, "FCEV"),
    (None, "E", "BEV"),
    (None, "P", "PHEV"),
    (None, "H", "HEV"),
    (None, "B", "BIFUEL"),
    (None, "F", "FLEX"),
    ("diesel", "M", "ICE_DIESEL"),
    ("petrol", "M", "ICE_BENZIN"),
    (None, "M", "ICE_SONSTIGE"),
]
NO_DRIVE_RULE = "UNBEKANNT"
# Electrified and chargeable drive classes.
ELECTRIFIED = ["BEV", "PHEV", "HEV", "FCEV"]
CHARGEABLE = ["BEV", "PHEV"]
# Passenger-car vehicle classes kept in core.
CAR_CLASSES = ["M1", "M1G"]
# Display labels per drive class (B20), fixed values.
CLASS_LABELS = {
    "BEV": "Batterieelektrisch",
    "PHEV": "Plug-in-Hybrid",
    "HEV": "Hybrid ohne Stecker",
    "FCEV": "Brennstoffzelle",
    "ICE_DIESEL": "Diesel (rein)",
    "ICE_BENZIN": "Benzin (rein)",
    "ICE_SONSTIGE": "Verbrenner sonstige",
    "BIFUEL": "Bi-Fuel (LPG/Erdgas)",
    "FLEX": "Flex-Fuel (E85)",
}
UNKNOWN_LABEL = "Unbekannt"


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sql_trim(x: ColumnOrName) -> Column:
    """Trim spaces only (PostgreSQL ``btrim`` / Spark ``trim`` agree)."""
    return F.trim(_c(x))


def blank_to_null(x: ColumnOrName) -> Column:
    """Trim, empty string -> NULL."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def parse_number(x: ColumnOrName) -> Column:
    """B1: tolerant number. All commas become dots; the shape must match
    strictly, otherwise NULL (never an error)."""
    t = F.replace(F.trim(_c(x)), F.lit(","), F.lit("."))
    return F.when(t.rlike(NUMBER_SHAPE), t.try_cast("double"))


def parse_date(x: ColumnOrName) -> Column:
    """B2: first 10 chars of trimmed text if shaped yyyy-mm-dd; an impossible
    date (2025-02-30) becomes NULL instead of raising (trap T2)."""
    head = F.substring(F.trim(_c(x)), 1, 10)
    return F.when(head.rlike(DATE_SHAPE), F.try_to_date(head, "yyyy-MM-dd"))


def normalize_name(x: ColumnOrName) -> Column:
    """Keep [A-Za-z0-9], upper case, empty -> NULL. The kept runs are joined: taking out
    the rest, by the negated class, takes ten times as long."""
    runs = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.nullif(F.upper(F.array_join(runs, "")), F.lit(""))


def fuel_mode_letter(fm: ColumnOrName) -> Column:
    """First letter of trimmed fuel mode, upper; NULL -> ''."""
    return F.upper(F.substring(F.trim(F.coalesce(_c(fm), F.lit(""))), 1, 1))


def fold_case(ft: ColumnOrName) -> Column:
    """Lower-case fuel type after blank->NULL."""
    return F.lower(blank_to_null(ft))


def upper_code(x: ColumnOrName) -> Column:
    """Trim + upper of a code."""
    return F.upper(F.trim(_c(x)))


def drive_class(ft: ColumnOrName, fm: ColumnOrName) -> Column:
    """Drive class from fuel type x fuel mode, first matching rule wins.
    The whole fuel-mode text is compared (not only its first letter)."""
    t = F.lower(F.trim(F.coalesce(_c(ft), F.lit(""))))
    m = F.upper(F.trim(F.coalesce(_c(fm), F.lit(""))))
    found = [F.when((F.lit(True) if ft_ is None else t == ft_) & (F.lit(True) if fm_ is None else m == fm_), cls)
             for ft_, fm_, cls in DRIVE_RULES]
    return F.coalesce(*found, F.lit(NO_DRIVE_RULE))


def is_electrified(cls: ColumnOrName) -> Column:
    return _c(cls).isin(ELECTRIFIED)


def is_chargeable(cls: ColumnOrName) -> Column:
    return _c(cls).isin(CHARGEABLE)


def vehicle_class(ct: ColumnOrName) -> Column:
    """B10 key: NULL-safe trimmed upper class code."""
    return F.upper(F.trim(F.coalesce(_c(ct), F.lit(""))))


def is_car_class(ct: ColumnOrName) -> Column:
    return vehicle_class(ct).isin(CAR_CLASSES)


def class_label(cls: ColumnOrName) -> Column:
    """Display label of a drive class."""
    out = None
    for k, v in CLASS_LABELS.items():
        out = (F.when(_c(cls) == k, v) if out is None else out.when(_c(cls) == k, v))
    return out.otherwise(UNKNOWN_LABEL)


def year_guard(x: ColumnOrName, lo: int = 1900, hi: int = 2100) -> Column:
    """Parse, then keep only years inside [lo, hi] before narrowing."""
    n = parse_number(x)
    return F.when(n.between(lo, hi), n.cast("smallint"))


def rnd(x: ColumnOrName, digits: int) -> Column:
    """Round half away from zero through an exact decimal, result double.

    Rounding a double directly differs between engines at .5 boundaries;
    going through decimal(28,10) first makes it deterministic (SURVEY 7.4.1).
    """
    return F.round(_c(x).cast("decimal(28,10)"), digits).cast("double")


def real_consumption(fuel: ColumnOrName, dist: ColumnOrName) -> Column:
    """Unrounded l/100 km from lifetime fuel and distance; only dist > 0."""
    return F.when(_c(dist) > 0, _c(fuel) / _c(dist) * 100)


def gap_columns(fuel: ColumnOrName, dist: ColumnOrName, lab: ColumnOrName) -> dict[str, Column]:
    """Real consumption (3 digits), gap absolute (3) and percent (2),
    all from the unrounded real consumption."""
    real = real_consumption(fuel, dist)
    ok = (_c(dist) > 0) & (_c(lab) > 0)
    return {
        "fc_real": rnd(real, 3),
        "gap_abs": F.when(ok, rnd(real - _c(lab), 3)),
        "gap_pct": F.when(ok, rnd((real - _c(lab)) / _c(lab) * 100, 2)),
    }


def electric_share(cd_off: ColumnOrName, dist: ColumnOrName) -> Column:
    """Share of distance driven electrically, 3 digits."""
    return F.when((_c(dist) > 0) & _c(cd_off).isNotNull(), rnd(_c(cd_off) / _c(dist) * 100, 3))


def usable_flag(used_in_calc: ColumnOrName) -> Column:
    """Three-valued; NULL input stays NULL."""
    return _c(used_in_calc) == "1"


def min_mileage_flag(dist: ColumnOrName, km: float = 1000) -> Column:
    """coalesce(dist, 0) >= km."""
    return F.coalesce(_c(dist), F.lit(0.0)) >= km


def pipe_key(*cols: ColumnOrName) -> Column:
    """NULL-safe composite text key a|b|c (NULL -> '')."""
    return F.concat_ws("|", *[F.coalesce(_c(c), F.lit("")) for c in cols])


def settlement_unit(pool: ColumnOrName, maker: ColumnOrName, legal: ColumnOrName) -> Column:
    """Pool, else maker, else legal name, else '(unbekannt)'."""
    return F.coalesce(_c(pool), _c(maker), _c(legal), F.lit("(unbekannt)"))


def date_key(d: ColumnOrName) -> Column:
    """Yyyymmdd as int, missing -> 0."""
    return F.coalesce(F.date_format(_c(d), "yyyyMMdd").cast("int"), F.lit(0))


def rating(value: ColumnOrName, noticeable_below: float | None = None) -> Column:
    """Ok if 0; 'auffaellig' below a threshold (if given); else 'kritisch'."""
    v = _c(value)
    r = F.when(v == 0, "ok")
    if noticeable_below is not None:
        r = r.when(v < noticeable_below, "auffaellig")
    return r.otherwise("kritisch")


def message(fmt: str, *cols: ColumnOrName) -> Column:
    """Printf-style message."""
    return F.format_string(fmt, *[_c(c) for c in cols])


def strict_number_shape(x: ColumnOrName) -> Column:
    """Raw numeric shape without trimming, comma or dot decimal."""
    return _c(x).rlike(r"\A-?[0-9]+([.,][0-9]+)?([eE][-+]?[0-9]+)?\z")


def year_prefix_mismatch(date_text: ColumnOrName, year: ColumnOrName) -> Column:
    """left(date, 4) <> year."""
    return F.substring(_c(date_text), 1, 4) != _c(year).cast("string")


def in_band(x: ColumnOrName, lo: float, hi: float) -> Column:
    """BETWEEN band."""
    return _c(x).between(lo, hi)


def band_label(x: ColumnOrName, edges=((45, "unter 45 %"), (60, "45 bis 60 %")), rest="ab 60 %") -> Column:
    """Banding, first edge that the value is below wins."""
    out = None
    for edge, label in edges:
        out = F.when(_c(x) < edge, label) if out is None else out.when(_c(x) < edge, label)
    return out.otherwise(rest)


def positive_flag(x: ColumnOrName) -> Column:
    """coalesce(x, 0) > 0."""
    return F.coalesce(_c(x), F.lit(0)) > 0


def squeeze_text(x: ColumnOrName, n: int = 70) -> Column:
    """Collapse whitespace runs, cut to n chars."""
    return F.substring(F.regexp_replace(_c(x), r"\s+", " "), 1, n)


def blank_label(x: ColumnOrName) -> Column:
    """NULL or '' -> '(leer)'."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit("(leer)"))


def thousands(x: ColumnOrName) -> Column:
    """Thousands-separated count."""
    return F.format_number(_c(x).cast("bigint"), 0)
