"""Ordered event sequences per key within a time bound, on batch tables.

A rule lists steps. A step taken with ``next`` must be the very next event of the key, whatever its
type; a step taken with ``followed_by`` may skip events that do not match. Every event that matches
the first step may start one match, and the match counts if its last event comes strictly less than
``within`` after its first. Events of a key are ordered by ``(ts, seq)``; ``seq`` must be unique per
key and ``ts``, it decides between events of the same millisecond.

Physical shape
--------------
One lazy plan: step predicates become booleans before the shuffle, so only the key, ``ts``, ``seq`` and
one boolean per step travel, in one hash shuffle on the key and a time bucket, to one sorted window pass,
all JVM-side. A bucket sees its own events and those up to ``within`` past its end, which is all that a
match starting in it can need; the others of its key are other groups. So no group holds more than one
key's events of ``bucket_spans + 1`` times ``within``, in a sort that spills, and a row is copied
``1 / bucket_spans`` times on average.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.times import millis, own_bucket, visible_buckets
from wardline.schemas import INSIDER_EXFIL, INSIDER_TYPES, SMALL_THEN_LARGE, TXN

BUCKET_SPANS = 8


@dataclass(frozen=True)
class Step:
    """One step: a SQL predicate over the event, and whether events may be skipped before it."""

    name: str
    where: str
    skip: bool = False


@dataclass(frozen=True)
class SequenceRule:
    """A named sequence over the events of one ``key`` column."""

    rule: str
    key: str
    steps: tuple[Step, ...]
    within: str

    def __post_init__(self) -> None:
        if len(self.steps) < 2:
            raise ValueError("a sequence has at least two steps")

    @property
    def within_ms(self) -> int:
        return millis(self.within)

    @property
    def only_skips(self) -> bool:
        return all(step.skip for step in self.steps[1:])


def next_step(name: str, where: str) -> Step:
    return Step(name, where)


def followed_by(name: str, where: str) -> Step:
    return Step(name, where, skip=True)


def small_then_large(
    small: float = 5, large: float = 500, within: str = "60 seconds", skip: bool = False
) -> SequenceRule:
    """A payment below ``small``, then one above ``large``, on one card."""
    return SequenceRule(
        SMALL_THEN_LARGE,
        "cardId",
        (
            Step("small", f"type = '{TXN}' AND amount < {small}"),
            Step("large", f"type = '{TXN}' AND amount > {large}", skip),
        ),
        within,
    )


def insider_exfil(within: str = "30 minutes") -> SequenceRule:
    """Privileges raised, data exported in bulk, data shared outside, by one actor."""
    return SequenceRule(
        INSIDER_EXFIL,
        "actor",
        tuple(Step(kind.lower(), f"type = '{kind}'") for kind in INSIDER_TYPES),
        within,
    )


def rule_for_mode(mode: str) -> SequenceRule:
    """``fraud`` selects the payment rule, any other mode the insider rule."""
    return small_then_large() if mode == "fraud" else insider_exfil()


def match_sequence(events: DataFrame, rule: SequenceRule, bucket_spans: int = BUCKET_SPANS) -> DataFrame:
    """All matches: ``id`` (the key), ``rule``, ``ts`` of the last event, ``first_ts``, ``first_seq``.

    Events without ``ts`` have no place in the order and take no part.
    """
    rows = spread_over_buckets(step_flags(events, rule), rule, bucket_spans)
    begun = _scan(rows, rule).where("is_step0").where(F.col("end1") < F.col("ts") + F.lit(rule.within_ms))
    return begun.select(
        "id", F.lit(rule.rule).alias("rule"), F.col("end1").alias("ts"), F.col("ts").alias("first_ts"),
        F.col("seq").alias("first_seq"),
    )


def sequence_timeouts(events: DataFrame, rule: SequenceRule, bucket_spans: int = BUCKET_SPANS) -> DataFrame:
    """Sequences that began and ran out of time: ``id, rule``, ``ts`` (when the time was up), ``first_ts``,
    ``first_seq`` and ``waited_for``, the step that had not come.

    A sequence that a wrong next event broke in time has failed, it is no timeout; what comes at the end of the time or
    later counts for nothing. The table is all there is: what is open at its end has run out of time as well.
    """
    rows = spread_over_buckets(step_flags(events, rule), rule, bucket_spans)
    deadline = F.col("ts") + F.lit(rule.within_ms)
    begun = _courses(rows, rule).where("is_step0").withColumn("deadline", deadline)
    taken = F.size(F.filter("go1.taken", lambda at: at < F.col("deadline")))
    names = F.array(*[F.lit(step.name) for step in rule.steps])
    open_ = begun.withColumn("taken", taken).where(F.col("taken") < len(rule.steps) - 1)
    return open_.where(F.col("go1.broke").isNull() | (F.col("go1.broke") >= F.col("deadline"))).select(
        "id", F.lit(rule.rule).alias("rule"), F.col("deadline").alias("ts"), F.col("ts").alias("first_ts"),
        F.col("seq").alias("first_seq"), F.get(names, F.col("taken") + 1).alias("waited_for"),
    )


def sequence_steps(events: DataFrame, rule: SequenceRule, *emit: str, bucket_spans: int = BUCKET_SPANS) -> DataFrame:
    """All matches with the events they are made of: ``id, rule, ts, first_ts, first_seq`` as in :func:`match_sequence` and
    ``steps``, per step a struct of ``step`` (its name), ``ts``, ``seq`` and the ``emit`` columns of its event.

    The columns travel with the rows through the same shuffle and sort, so that no join back to the events is needed.
    """
    event = F.struct("ts", "seq", *[F.col(name).alias(name) for name in emit]).alias("event")
    rows = spread_over_buckets(step_flags(events, rule, event), rule, bucket_spans)

    def taken(j: int, rest: Column | None) -> Column:
        own = F.array(F.struct(F.lit(rule.steps[j].name).alias("step"), *[F.col("event")[name].alias(name) for name in ("ts", "seq", *emit)]))
        return own if rest is None else F.concat(own, rest)

    begun = _scan(rows, rule, taken).where("is_step0").withColumn("steps", taken(0, F.col("end1")))
    end = F.element_at("steps", -1)["ts"]
    return begun.where(end < F.col("ts") + F.lit(rule.within_ms)).select(
        "id", F.lit(rule.rule).alias("rule"), end.alias("ts"), F.col("ts").alias("first_ts"), F.col("seq").alias("first_seq"), "steps",
    )


def spread_over_buckets(rows: DataFrame, rule: SequenceRule, bucket_spans: int) -> DataFrame:
    """Each row once per ``bucket`` that sees it; it can begin a match in its own bucket only."""
    width = rule.within_ms * bucket_spans
    if rule.only_skips:
        # Rows matching no step can neither extend nor break such a sequence. On a stream, naming the event time
        # keeps this filter above the watermark: such rows need no state, but time passes with them.
        timeless = ["event_time IS NULL"] if rows.isStreaming else []
        rows = rows.where(" OR ".join([*_flags(rule), *timeless]))
    return rows.withColumn(
        "bucket", F.explode(visible_buckets(F.col("ts"), width, ahead=rule.within_ms))
    ).withColumn("is_step0", F.col("is_step0") & (own_bucket(F.col("ts"), width) == F.col("bucket")))


def step_flags(events: DataFrame, rule: SequenceRule, *keep: str | Column) -> DataFrame:
    """The columns matching needs: ``id, ts, seq`` and a never-null boolean per step."""
    flags = [
        F.coalesce(F.expr(step.where), F.lit(False)).alias(flag)
        for step, flag in zip(rule.steps, _flags(rule))
    ]
    return events.select(F.col(rule.key).alias("id"), "ts", "seq", *flags, *keep)


def _flags(rule: SequenceRule) -> list[str]:
    return [f"is_step{i}" for i in range(len(rule.steps))]


def _end_time(j: int, rest: Column | None) -> Column:
    return F.col("ts") if rest is None else rest


def _scan(rows: DataFrame, rule: SequenceRule, taking: Callable[[int, Column | None], Column] = _end_time) -> DataFrame:
    """``end{j}``: when a sequence ends that needs step ``j`` next, from just after each row; NULL if it
    has no end among the rows at hand. ``taking`` may carry something else: what a row that takes step ``j`` makes of
    ``end{j + 1}`` (None at the last step).

    Works from the last step to the first over rows in descending order, where "the next row" and "the
    nearest later row of step j" are a lag and a running last value, so one sort serves all steps.
    """
    backward = Window.partitionBy("id", "bucket").orderBy(F.col("ts").desc(), F.col("seq").desc())
    later = backward.rowsBetween(Window.unboundedPreceding, -1)
    rest = None
    for j, flag in reversed(list(enumerate(_flags(rule)))[1:]):
        end = taking(j, rest)
        if rule.steps[j].skip:
            hit = F.last(F.when(F.col(flag), F.struct(end.alias("end"))), ignorenulls=True).over(later)["end"]
        else:
            hit = F.when(F.lag(flag).over(backward), F.lag(end).over(backward))
        rows = rows.withColumn(f"end{j}", hit)
        rest = F.col(f"end{j}")
    return rows


def _courses(rows: DataFrame, rule: SequenceRule) -> DataFrame:
    """``go{j}``: how a sequence goes on that needs step ``j`` next, from just after each row: when it has ``taken``
    the steps from ``j`` on, and when an event ``broke`` it after these. Works like :func:`_scan`."""
    backward = Window.partitionBy("id", "bucket").orderBy(F.col("ts").desc(), F.col("seq").desc())
    later = backward.rowsBetween(Window.unboundedPreceding, -1)

    def course(taken, broke):
        return F.struct(taken.cast("array<long>").alias("taken"), broke.cast("long").alias("broke"))

    nothing = course(F.array(), F.lit(None))
    go = nothing
    for j, flag in reversed(list(enumerate(_flags(rule)))[1:]):
        taken = course(F.concat(F.array("ts"), go["taken"]), go["broke"])
        if rule.steps[j].skip:
            step = F.last(F.when(F.col(flag), taken), ignorenulls=True).over(later)
        else:
            step = F.lag(F.when(F.col(flag), taken).otherwise(course(F.array(), F.col("ts")))).over(backward)
        rows = rows.withColumn(f"go{j}", F.coalesce(step, nothing))
        go = F.col(f"go{j}")
    return rows


def to_alerts(matches: DataFrame) -> DataFrame:
    """A match as an alert: ``id, rule, ts``."""
    return matches.select("id", "rule", "ts")
