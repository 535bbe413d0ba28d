"""Data-quality rules: a named condition that either counts or drops the rows violating it.

A condition that is NULL for a row counts as violated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wardline.schemas import EVENT_TYPES


@dataclass(frozen=True)
class Expectation:
    name: str
    condition: str
    drop: bool = False

    def holds(self) -> Column:
        return F.coalesce(F.expr(self.condition), F.lit(False))

    def violations(self) -> Column:
        return F.count_if(~self.holds()).alias(self.name)


# The rules of the event and alert tables.
HAS_TS = Expectation("has_ts", "ts IS NOT NULL")
VALID_TYPE = Expectation("valid_type", "type IN ({})".format(
    ", ".join(f"'{name}'" for name in EVENT_TYPES)), drop=True)
VALID_ALERT = Expectation("valid_alert", "id IS NOT NULL AND rule IS NOT NULL")

EVENT_RULES = (HAS_TS, VALID_TYPE)
ALERT_RULES = (VALID_ALERT,)


def expect(
    rows: DataFrame, rules: Sequence[Expectation], observe: Observation | str | None = None
) -> DataFrame:
    """Drop what a dropping rule forbids; count violations of every rule on the way.

    The counts ride along with the job that consumes the result (no extra pass): read them from the
    ``Observation``, or on a stream from ``observedMetrics`` under the given name.
    """
    if observe is not None:
        rows = rows.observe(observe, F.count("*").alias("rows"), *[r.violations() for r in rules])
    for rule in rules:
        if rule.drop:
            rows = rows.where(rule.holds())
    return rows


def violation_counts(rows: DataFrame, rules: Sequence[Expectation], missing_key: str | None = None) -> DataFrame:
    """One row per rule: ``rule, action, rows, violations``. ``missing_key`` names a key column whose
    NULL or empty values are counted too, since all such rows share one key downstream."""
    counts = [(r.name, "drop" if r.drop else "keep", F.count_if(~r.holds())) for r in rules]
    if missing_key:
        absent = F.coalesce(F.col(missing_key), F.lit("")) == ""
        counts.append((f"has_{missing_key}", "keep", F.count_if(absent)))
    row = rows.agg(F.count("*").alias("rows"), *[c.alias(name) for name, _, c in counts])
    lines = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(action).alias("action"),
                 F.col(name).alias("violations"))
        for name, action, _ in counts
    ])
    return row.select("rows", F.inline(lines)).select("rule", "action", "rows", "violations")
