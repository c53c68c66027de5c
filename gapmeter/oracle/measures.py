"""SQL of grouped measures from their definitions: what is counted, what is averaged, to how many digits."""

from __future__ import annotations

from .adapter import rnd


def n(condition: str | None = None) -> str:
    """Rows, or rows for which the condition holds."""
    return "count()" if condition is None else f"count_if({condition})"


def percent(condition: str, digits: int) -> str:
    """Share of rows for which the condition holds."""
    return rnd(f"100 * avg(coalesce({condition}, FALSE)::INT)", digits)


def mean(value: str, digits: int, where: str | None = None) -> str:
    return rnd(f"avg({value})" if where is None else f"avg(CASE WHEN {where} THEN {value} END)", digits)


def quantile(value: str, share: float, digits: int) -> str:
    return rnd(f"quantile_cont(({value})::DOUBLE, {share})", digits)


def share_of_all(count: str, digits: int, within: str = "") -> str:
    """A count as a share of its total over the result rows (of one ``within``)."""
    return rnd(f"100 * {count} / sum({count}) OVER ({f'PARTITION BY {within}' if within else ''})", digits)


def measures(source: str, by: list[str], where: str | None = None, **columns: str) -> str:
    """One row per ``by`` (none: one row) with the named measures."""
    listed = [*by, *(f"{sql} AS {name}" for name, sql in columns.items())]
    return f"FROM {source} SELECT {', '.join(listed)}{f' WHERE {where}' if where else ''}{' GROUP BY ALL' if by else ''}"
