"""A day's alerts with the payments and activities around them, from the rows of all three held per slot of entities.

A slot is a share of the entities, by hash. It holds a day of their alerts and the points within the band of them, as Arrow
blocks, until the watermark has passed the last point that can belong there. Then the day is worked out at once and its state
goes away, so calls into the state grow with slots and batches, not with rows or entities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Executors need not have this package installed: the processor travels with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAYMENT, ACTIVITY, ALERT = range(3)
DAY_SECONDS = 86_400
DIMS = ["alert_type", "severity"]
OUTPUT = (
    "event_time timestamp, day long, alert_type string, severity string, alert_count long, paid double, amounts long, "
    "cards_involved long, actors_involved long, rules array<string>, types array<string>"
)
_TEXTS = ["id", "name", *DIMS]
_BLOCK = pa.schema([
    ("kind", pa.int32()), ("at", pa.int64()), ("amount", pa.float64()), ("has_amount", pa.bool_()),
    *[(name, pa.string()) for name in _TEXTS],
])


class DayThreats(StatefulProcessor):
    """Per slot and day: rows ``kind, id, at`` (seconds), ``name`` (an alert's rule, an activity's type), ``amount``,
    ``has_amount`` and an alert's dimensions come in; one row per dimensions goes out when the day is over.
    """

    def __init__(self, reach: int) -> None:
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = False
        for frame in rows:
            if len(frame):
                some = True
                self.held.appendValue((_as_bytes(frame),))
        if some:
            self.handle.registerTimer(self._over(key) * 1000)
        return iter(())

    def _over(self, key) -> int:
        return (key[1] + 1) * DAY_SECONDS + self.reach

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        blocks = [pa.ipc.open_stream(row[0]).read_all() for row in self.held.get()]
        self.held.clear()
        found = day_threats(pa.concat_tables(blocks).to_pandas(), self.reach)
        if len(found):
            found.insert(0, "event_time", pd.Timestamp(self._over(key), unit="s", tz="UTC"))
            found.insert(1, "day", key[1])
            yield found

    def close(self) -> None:
        pass


def _as_bytes(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _BLOCK, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(pa.Table.from_pandas(frame[_BLOCK.names], schema=_BLOCK, preserve_index=False))
    return sink.getvalue().to_pybytes()


def day_threats(rows: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Per dimensions of the alerts in ``rows`` their figures over all joined rows. An alert meets the points of its entity at
    most ``reach`` seconds away; no pairs are formed.

    Alerts and payments shrink to one row per entity and second. Counts are differences of running totals; amounts are
    added up for each alert's range by itself, so those outside it, however large or not finite, leave no trace.
    """
    kind, at = rows["kind"].to_numpy(), rows["at"].to_numpy(np.int64)
    # One number line: each entity's seconds lie more than a band from those of the next; without an id below all points.
    who = pd.factorize(rows["id"])[0].astype(np.int64)
    rows = rows.assign(who=who, place=who * (at.max() - at.min() + 2 * reach + 1) + at - at.min() + reach)
    alerts = rows[kind == ALERT].groupby(["place", "who", *DIMS, "name"], dropna=False, sort=False).size()
    alerts = alerts.rename("copies").reset_index().sort_values("place", ignore_index=True)
    if not len(alerts):
        return pd.DataFrame()
    place, copies = alerts["place"].to_numpy(), alerts["copies"].to_numpy(np.int64)

    def seconds(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """The places taken, sorted; where their rows begin; and per alert the range of places it meets."""
        taken, begin = np.unique(part["place"].to_numpy(), return_index=True)
        return taken, begin, np.searchsorted(taken, place - reach), np.searchsorted(taken, place + reach, "right")

    def counts(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[high] - total[low]

    paid = rows[kind == PAYMENT].sort_values("place", kind="stable")
    taken, begin, low, high = seconds(paid)
    payments = counts(np.diff(np.append(begin, len(paid))), low, high)
    has_amount = paid["has_amount"].to_numpy(bool)
    amount = np.where(has_amount, paid["amount"].to_numpy(np.float64), 0.0)
    amounts, sums = np.zeros(len(alerts), np.int64), np.zeros(len(alerts))
    if len(taken):
        amounts = counts(np.add.reduceat(has_amount.astype(np.int64), begin), low, high)
        with np.errstate(invalid="ignore"):
            sums = _range_sums(np.add.reduceat(amount, begin), low, high)

    acted = rows[kind == ACTIVITY].sort_values("place", kind="stable")
    taken, begin, low, high = seconds(acted)
    activities = counts(np.diff(np.append(begin, len(acted))), low, high)
    met = {}
    for name in acted["name"].dropna().unique():
        _, _, low, high = seconds(acted[acted["name"] == name])
        met[name] = high > low

    repeated = copies * np.maximum(activities, 1)
    joined = repeated * np.maximum(payments, 1)
    if (copies * np.maximum(activities, 1.0) * np.maximum(payments, 1.0)).sum() >= 2.0 ** 63:
        raise OverflowError("more joined rows than a long can count")
    out = []
    for dims, part in alerts.groupby(DIMS, dropna=False, sort=False):
        mine, who = part.index.to_numpy(), part["who"].to_numpy()
        counted = mine[amounts[mine] > 0]
        with np.errstate(invalid="ignore"):
            total = float((sums[counted] * repeated[counted]).sum()) if len(counted) else None
        out.append((
            *[None if pd.isna(value) else value for value in dims], int(joined[mine].sum()), total,
            int((amounts[mine] * repeated[mine]).sum()), len(np.unique(who[payments[mine] > 0])),
            len(np.unique(who[activities[mine] > 0])), sorted(part["name"].dropna().unique()),
            sorted(name for name, hit in met.items() if hit[mine].any()),
        ))
    return pd.DataFrame(out, columns=[
        *DIMS, "alert_count", "paid", "amounts", "cards_involved", "actors_involved", "rules", "types"])


def _range_sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The sum of ``values[low:high]`` for each pair, nothing subtracted."""
    out, some = np.zeros(len(low)), high > low
    if some.any():
        out[some] = np.add.reduceat(np.append(values, 0.0), np.column_stack([low[some], high[some]]).ravel())[::2]
    return out
