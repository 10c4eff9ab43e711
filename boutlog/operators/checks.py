"""Invariants that are checked while rows are stored.

A row that violates a check ends the job that reads it; rows that pass cost one expression each, no job and no second pass. Only
after a violation are the rows looked at again, for a report with the first violating values. (Observed metrics would give the
report in the same pass, but a session that has used one can no longer send fitted models to its tasks.)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from boutlog.session import stored

EXAMPLES = 5
TOURNEY_ID = r"^\d{4}-.+"
_MARK = "violated check: "


class Violation(ValueError):
    """An invariant that does not hold."""


@dataclass(frozen=True)
class Check:
    """No row may have ``bad``; ``value`` is shown of those that have. Null counts as fine."""

    name: str
    bad: Column
    value: Column

    def guard(self) -> Column:
        """True; a row with ``bad`` raises."""
        return F.when(self.bad, F.raise_error(F.concat(F.lit(f"{_MARK}{self.name}, "), F.coalesce(self.value.cast("string"), F.lit("null")))).cast("boolean")).otherwise(True)


@dataclass(frozen=True)
class MeanCheck:
    """The mean of a column must be the reported one. Without rows there is no mean, which is a violation unless none is reported."""

    name: str
    column: str
    reported: float | None
    tolerance: float = 1e-8

    def verdict(self, mean: float | None) -> str | None:
        if mean == self.reported or (mean is not None and self.reported is not None and abs(mean - self.reported) <= self.tolerance):
            return None
        return f"{self.name}: mean of {self.column} is {mean}, {self.reported} was reported"


def format_check(column: str, pattern: str = TOURNEY_ID) -> Check:
    """Values that are there must match the pattern."""
    return Check(f"format of {column}", ~F.col(column).rlike(pattern), F.col(column))


def violations(df: DataFrame, check: Check, most: int = EXAMPLES) -> DataFrame:
    """value, n: the first violating values, in order, with their rows, as a report that raises nothing."""
    return df.where(check.bad).groupBy(check.value.cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy("value").limit(most)


def checked(df: DataFrame, checks: Sequence[Check] = (), means: Sequence[MeanCheck] = ()) -> DataFrame:
    """df, stored; raises Violation where a check fails, with up to five values, or where a mean of the stored rows is another."""
    guarded = df
    for c in checks:
        guarded = guarded.where(c.guard())
    try:
        out = stored(guarded)
    except Exception as e:
        if _MARK not in str(e):
            raise
        failed = [f"{c.name}: {[r['value'] for r in found]}" for c in checks if (found := violations(df, c).collect())]
        raise Violation("; ".join(failed)) from e
    if means:
        found = out.agg(*[F.avg(c.column).alias(c.name) for c in means]).first()
        if failed := [v for c in means if (v := c.verdict(found[c.name]))]:
            raise Violation("; ".join(failed))
    return out
