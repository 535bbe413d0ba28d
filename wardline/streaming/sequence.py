"""The sequence rules of ``operators.sequence`` on unbounded streams.

Events may arrive out of order. They are held until the watermark has passed them, then taken in
``(ts, seq)`` order; events behind the watermark are dropped by the stream. Keys are dealt to slots by
hash, and the state of a slot is split by time: a bucket sees its own events and those up to ``within``
past its end, so every sequence that starts in it can be completed there, a busy key spreads over its
buckets, and all state of a bucket goes away once the watermark has left it behind. All keys of a slot
take their steps together, so calls into the state grow with slots and batches, not with keys.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline.operators.sequence import BUCKET_SPANS, SequenceRule, spread_over_buckets, step_flags

# Executors need not have this package installed: the matcher travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NEVER = np.iinfo(np.int64).max
_HELD = pa.schema([("id", pa.string()), ("ts", pa.int64()), ("seq", pa.int64()), ("steps", pa.int64())])
_BEGUN = pa.schema([("id", pa.string()), ("wait", pa.int64()), ("ts", pa.int64()), ("seq", pa.int64())])
_BLOCK_ROWS = 100_000
SLOTS = 128
_MATCH = "id string, rule string, ts long, first_ts long, first_seq long"


def match_sequence_stream(
    events: DataFrame, rule: SequenceRule, delay: str, bucket_spans: int = BUCKET_SPANS, slots: int = SLOTS
) -> DataFrame:
    """The matches of ``operators.sequence.match_sequence`` on a stream of events with ``event_time``.

    ``delay`` is how late an event may come. A match is emitted (append mode) once the watermark has
    passed its last event. Keys share ``slots``: one slot's events of a batch and bucket must fit a task. Their number
    is part of the state and stays with the checkpoint.
    """
    return _followed(events, rule, delay, bucket_spans, slots, timeouts=False)


def sequence_outcomes_stream(
    events: DataFrame, rule: SequenceRule, delay: str, bucket_spans: int = BUCKET_SPANS, slots: int = SLOTS
) -> DataFrame:
    """Matches and, once the watermark has passed their time, the sequences that ran out of it: a timeout names the step it
    ``waited_for`` (null for a match) and has the end of its time as ``ts``, as in ``operators.sequence.sequence_timeouts``.
    """
    return _followed(events, rule, delay, bucket_spans, slots, timeouts=True)


def _followed(events: DataFrame, rule: SequenceRule, delay: str, bucket_spans: int, slots: int, timeouts: bool) -> DataFrame:
    flags = [f"is_step{i}" for i in range(len(rule.steps))]
    rows = step_flags(events, rule, "event_time").withWatermark("event_time", delay)
    spread = spread_over_buckets(rows, rule, bucket_spans)
    return (
        spread.select(F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot"), "bucket", "id", "ts", "seq", *flags, "event_time")
        .groupBy("slot", "bucket")
        .transformWithStateInPandas(
            statefulProcessor=_Matcher(rule, timeouts),
            outputStructType=f"{_MATCH}, waited_for string" if timeouts else _MATCH,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


class _Matcher(StatefulProcessor):
    """Holds, per slot of keys and bucket, the events ahead of the watermark and the sequences begun before it.

    Events come as Arrow batches and are kept so, a block per batch. A timer stands at the earliest held event. Calls into
    the state cost far more than the matching, so a firing reads the blocks once and takes the steps of all keys together.
    A group holds its keys' events of ``bucket_spans + 1`` times ``within``, less what the watermark has passed.
    """

    def __init__(self, rule: SequenceRule, timeouts: bool = False) -> None:
        self.rule = rule.rule
        self.within = rule.within_ms
        self.skips = [step.skip for step in rule.steps]
        self.names = [step.name for step in rule.steps]
        self.timeouts = timeouts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")
        self.begun = handle.getValueState("begun", "block binary")
        self.fired = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for events in rows:
            if len(events):
                steps = sum(events[f"is_step{i}"].to_numpy(np.int64) << i for i in range(len(self.skips)))
                table = pa.Table.from_pandas(events[["id", "ts", "seq"]].assign(steps=steps), schema=_HELD, preserve_index=False)
                self.held.appendValue((_as_bytes(table),))
                earliest.append(int(events["ts"].min()))
        if earliest:
            self.handle.registerTimer(min(earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.fired.get(tuple(key)) == watermark:
            return iter(())  # another timer of this group has done all there is to do
        self.fired[tuple(key)] = watermark
        held = pa.concat_tables([_HELD.empty_table(), *[_as_table(row[0]) for row in self.held.get()]])
        begun = _as_table(self.begun.get()[0]) if self.begun.exists() else _BEGUN.empty_table()
        passed = pc.less_equal(held["ts"], watermark)
        ready, ahead = held.filter(passed), held.filter(pc.invert(passed))
        if len(ready):
            self.held.clear()
            for start in range(0, len(ahead), _BLOCK_ROWS):
                self.held.appendValue((_as_bytes(ahead.slice(start, _BLOCK_ROWS)),))
        # Keys by number; events without a key are one key, as in a group.
        coded = pa.chunked_array([*ready["id"].chunks, *begun["id"].chunks], pa.string()).combine_chunks().dictionary_encode()
        keys = np.append(coded.dictionary.to_numpy(zero_copy_only=False), None)
        who = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        done, out, still = self._advance(
            [who[:len(ready)], *_arrays(ready)], [who[len(ready):], *_arrays(begun)], watermark)
        if len(still[0]):
            self.begun.update((_as_bytes(pa.Table.from_arrays(
                [pa.array(keys[still[0]], pa.string()), *map(pa.array, still[1:])], schema=_BEGUN)),))
        elif len(begun):
            self.begun.clear()
        # The next event held, or the next deadline, by which at the latest no state of this bucket is left.
        waiting = np.concatenate([ahead["ts"].to_numpy(), still[2] + self.within])
        if len(waiting):
            self.handle.registerTimer(int(waiting.min()))
        kinds = [(done, None)] + [(out, np.array(self.names, object)[out[4]])] * self.timeouts
        return iter([self._rows(keys, found, step) for found, step in kinds if len(found[0])])

    def _rows(self, keys: np.ndarray, found: list[np.ndarray], waited_for: np.ndarray | None) -> pd.DataFrame:
        rows = pd.DataFrame({"id": keys[found[0]], "rule": self.rule, **dict(zip(("ts", "first_ts", "first_seq"), found[1:]))})
        if self.timeouts:
            rows["waited_for"] = waited_for
        return rows

    def _advance(
        self, ready: list[np.ndarray], begun: list[np.ndarray], watermark: int
    ) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """From ``ready`` events ``(who, ts, seq, steps)`` and ``begun`` sequences ``(who, wait, first_ts, first_seq)``: the
        matches ``(who, ts, first_ts, first_seq)`` they complete, timeouts ``(who, ts, first_ts, first_seq, wait)``, and what
        stays begun.

        All sequences of all keys take their steps together, step by step. After the events of each key stands a row that
        is never reached in time, for "after the last event".
        """
        some = np.unique(np.concatenate([ready[0], begun[0]]))
        ends = [some, np.full(len(some), _NEVER), np.full(len(some), _NEVER), np.zeros(len(some), np.int64)]
        who, ts, seq, steps = (np.concatenate(pair) for pair in zip(ready, ends))
        order = np.lexsort((np.arange(len(who)) >= len(ready[0]), seq, ts, who))
        who, ts, seq = who[order], ts[order], seq[order]
        flags = steps[order] >> np.arange(len(self.skips))[:, None] & 1 > 0
        first, last = np.searchsorted(who, some), np.searchsorted(who, some, "right") - 1
        starts, n = np.flatnonzero(flags[0]), len(ts)
        # Sequences begun earlier go on at the first row of their key, new ones just after their own.
        owner = np.concatenate([begun[0], who[starts]])
        first_ts = np.concatenate([begun[2], ts[starts]])
        first_seq = np.concatenate([begun[3], seq[starts]])
        wait = np.concatenate([begun[1], np.ones(len(starts), np.int64)])
        place = np.searchsorted(some, owner)
        row = np.concatenate([first[place[:len(begun[0])]], starts + 1])
        deadline, end, failed = first_ts + self.within, np.zeros(len(wait), np.int64), np.zeros(len(wait), bool)
        for j in range(1, len(flags)):
            here = np.flatnonzero((wait == j) & ~failed)
            at = row[here]
            if self.skips[j]:
                following = np.minimum.accumulate(np.where(flags[j], np.arange(n), n)[::-1])[::-1]
                at = np.minimum(following[at], last[place[here]])
            in_time = ts[at] < deadline[here]
            hit = in_time & flags[j][at]
            failed[here] = in_time & ~hit
            went = here[hit]
            wait[went], row[went], end[went] = j + 1, at[hit] + 1, ts[at[hit]]
        done = wait == len(flags)
        open_ = ~done & ~failed
        out, still = open_ & (deadline <= watermark), open_ & (deadline > watermark)
        return (
            [x[done] for x in (owner, end, first_ts, first_seq)], [x[out] for x in (owner, deadline, first_ts, first_seq, wait)],
            [x[still] for x in (owner, wait, first_ts, first_seq)],
        )

    def close(self) -> None:
        pass


def _as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _as_table(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def _arrays(table: pa.Table) -> list[np.ndarray]:
    return [table[name].to_numpy() for name in table.column_names[1:]]
