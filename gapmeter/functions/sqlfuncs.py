"""The cleaning rules as SQL functions, for users who write SQL.

The rules themselves stand in ``scalars`` and ``arrays`` (shapes, drive-class table,
whitelist); here each becomes the body of a temporary SQL function. Spark inlines such
bodies, so no Python runs per row. ``tests/test_scalars.py`` holds both forms against
each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .arrays import ECO_CODE_WHITELIST
from .scalars import DATE_SHAPE, DRIVE_RULES, NO_DRIVE_RULE, NUMBER_SHAPE


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _drive_lookup() -> str:
    """The rule table as data: the first row that fits, by its place."""
    rows = ", ".join(f"struct({'NULL' if a is None else _quoted(a)} AS a, {'NULL' if b is None else _quoted(b)} AS b, {_quoted(c)} AS c)"
                     for a, b, c in DRIVE_RULES)
    fits = "filter(array({rows}), r -> coalesce(r.a = lower(trim(ft)), r.a IS NULL) AND coalesce(r.b = upper(trim(fm)), r.b IS NULL))"
    return f"coalesce(get({fits.format(rows=rows)}, 0).c, {_quoted(NO_DRIVE_RULE)})"


def _eco_codes() -> str:
    """Pairs of digits of the all-digit tokens of even length that the whitelist has: distinct, in order, none: NULL."""
    listed = ", ".join(_quoted(c) for c in ECO_CODE_WHITELIST)
    tokens = r"filter(split(trim(t), '\\s+'), x -> x RLIKE '^[0-9]+$' AND length(x) % 2 = 0)"
    pairs = f"flatten(transform({tokens}, x -> transform(sequence(1, length(x), 2), i -> substr(x, i, 2))))"
    codes = f"array_sort(array_intersect({pairs}, array({listed})))"
    return f"CASE WHEN size({codes}) > 0 THEN {codes} END"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Function name -> (arguments, result type, body)."""
    number, day = "replace(trim(t), ',', '.')", "left(trim(t), 10)"
    return {
        "antriebsklasse": ("ft STRING, fm STRING", "STRING", _drive_lookup()),
        "leer_zu_null": ("t STRING", "STRING", "nullif(trim(t), '')"),
        "norm_name": ("t STRING", "STRING", "nullif(upper(regexp_replace(t, '[^A-Za-z0-9]', '')), '')"),
        "oeko_codes": ("t STRING", "ARRAY<STRING>", _eco_codes()),
        "zu_datum": ("t STRING", "DATE", f"if({day} RLIKE {_quoted(DATE_SHAPE)}, try_to_date({day}, 'yyyy-MM-dd'), NULL)"),
        "zu_zahl": ("t STRING", "DOUBLE", f"if({number} RLIKE {_quoted(NUMBER_SHAPE)}, try_cast({number} AS DOUBLE), NULL)"),
    }


def register_sql_functions(spark: SparkSession) -> None:
    for name, (args, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
