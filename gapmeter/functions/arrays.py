"""Array functions: eco-innovation code tokenising and friends.

Built from higher-order array functions, so the whole tokeniser runs inside
whole-stage codegen with no Python on the row path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import ColumnOrName, _c

# Whitelist of eco-innovation technology codes (must equal the reference).
ECO_CODE_WHITELIST = ["08", "28", "29", "32", "33", "35", "37", "38", "39", "82"]


def eco_codes(x: ColumnOrName, whitelist: list[str] | None = None) -> Column:
    """Split on whitespace; keep all-digit tokens of even length; cut them
    into pairs; keep whitelisted pairs; distinct + sorted; nothing -> NULL."""
    wl = F.array(*[F.lit(c) for c in (whitelist or ECO_CODE_WHITELIST)])
    t = F.trim(_c(x))
    toks = F.filter(F.split(t, r"\s+"),
                    lambda s: s.rlike(r"\A[0-9]+\z") & (F.length(s) % 2 == 0))
    pairs = F.flatten(F.transform(
        toks, lambda s: F.transform(F.sequence(F.lit(1), F.length(s), F.lit(2)),
                                    lambda g: F.substring(s, g, 2))))
    codes = F.sort_array(F.array_distinct(F.array_intersect(pairs, wl)))
    return F.when(t.isNull() | (t == ""), F.lit(None)).otherwise(
        F.when(F.size(codes) > 0, codes))


def code_text_unresolved(raw: ColumnOrName, codes: ColumnOrName) -> Column:
    """C4: text present but no code resolved."""
    return _c(raw).isNotNull() & _c(codes).isNull()


def code_counts(df: DataFrame, codes_col: str = "oeko_codes") -> DataFrame:
    """Unnest codes and count per code (partial aggregation map-side)."""
    return (df.select(F.explode(codes_col).alias("code"))
            .groupBy("code").agg(F.count(F.lit(1)).alias("n")))


def has_code(codes: ColumnOrName, code: str) -> Column:
    """Array contains (NULL array -> NULL -> filtered out)."""
    return F.array_contains(_c(codes), code)
