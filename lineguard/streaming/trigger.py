"""The retraining trigger as a keyed state machine on event time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lineguard import params

TRIGGER_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("window_index", T.LongType()),
        T.StructField("fired_rules", T.StringType()),
        T.StructField("notified", T.BooleanType()),
    ]
)

_COMPARE: dict[str, Callable] = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}


def step_trigger(
    streaks: dict[str, int], last_fired: float | None, row: dict, rules: Sequence[tuple], n: int, cooldown_s: float
) -> tuple[dict[str, int], float | None, list[str], bool]:
    """One window: new streaks, clock, rules at their n-th breach or beyond, and whether to notify."""
    fresh = {}
    for name, metric, op, threshold, _ in rules:
        value = row.get(metric)
        known = value is not None and float("-inf") < value < float("inf")
        fresh[name] = streaks.get(name, 0) + 1 if known and _COMPARE[op](value, threshold) else 0
    fired = sorted(r for r, k in fresh.items() if k >= n)
    notify = bool(fired) and (last_fired is None or row["at"] - last_fired >= cooldown_s)
    return fresh, row["at"] if notify else last_fired, fired, notify


class OrderedTrigger(StatefulProcessor):
    """Windows of one model wait in a list until the watermark passes them and are then replayed in order.

    State: the waiting windows, a breach counter per rule, and the time of the last notification. The list is written
    once per block of input and read once per step of the watermark, and one timer stands at its earliest window, so the
    calls to the state store grow with blocks and steps, not with windows. A window that comes
    again while it waits replaces itself; one that comes after its release is late and never gets here.
    """

    def __init__(self, rules: Sequence[tuple], n: int, cooldown_s: float):
        self.rules, self.n, self.cooldown_s = list(rules), n, cooldown_s
        self.metrics = sorted({metric for _, metric, *_ in rules})

    def init(self, handle) -> None:
        self.handle = handle
        values = ", ".join(["window_index long", "at double", *(f"`{m}` double" for m in self.metrics)])
        self.waiting = handle.getListState("waiting", values)
        self.streaks = handle.getMapState("streaks", "rule string", "breaches int")
        self.clock = handle.getValueState("clock", "last_fired double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if pdf.empty:
                continue
            doubles = pdf.reindex(columns=["at", *self.metrics]).astype("float64").itertuples(index=False, name=None)
            self.waiting.appendList([(int(i), *values) for i, values in zip(pdf["window_index"], doubles)])
            self.handle.registerTimer(_millis(pdf["at"].min()))
        yield pd.DataFrame(columns=TRIGGER_SCHEMA.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All windows that the watermark has passed go at once; the next timer stands at the earliest of the others.
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        latest = {index: (at, index, values) for index, at, *values in self.waiting.get()}
        due = sorted(w for w in latest.values() if _millis(w[0]) <= until)
        rest = [(index, at, *values) for at, index, values in latest.values() if _millis(at) > until]
        out = []
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            streaks = {k[0]: v[0] for k, v in self.streaks.iterator()}
            last = self.clock.get()[0] if self.clock.exists() else None
            for at, index, values in due:
                row = {"at": at, **dict(zip(self.metrics, values))}
                streaks, last, fired, notify = step_trigger(streaks, last, row, self.rules, self.n, self.cooldown_s)
                if fired:
                    out.append((key[0], index, ",".join(fired), notify))
            for rule, breaches in streaks.items():
                self.streaks.updateValue((rule,), (breaches,))
            if last is not None:
                self.clock.update((last,))
        if rest:
            self.handle.registerTimer(_millis(min(w[1] for w in rest)))
        yield pd.DataFrame(out, columns=TRIGGER_SCHEMA.names)

    def close(self) -> None:
        pass


def _millis(at: float) -> int:
    return math.ceil(at * 1000)


def stateful_trigger(
    signals: DataFrame,
    *,
    rules: Sequence[tuple] = params.RULES,
    n: int = params.RETRAINING["consecutive_windows"],
    cooldown_hours: float = params.RETRAINING["cooldown_hours"],
    delay: str = "0 seconds",
) -> DataFrame:
    """Fired rules per window, in window order, with a cooldown between notifications.

    *signals* streams ``(model, window_index, at, metrics...)``, ``at`` being epoch seconds and rising with
    ``window_index``. Windows may come in any order within *delay* of the latest one seen; each is judged when the watermark
    passes it. The query needs the RocksDB state store (``jobs.run_to_table(..., keyed_state=True)``).
    """
    at = F.timestamp_millis(F.ceil(F.col("at") * 1000.0).cast("long"))
    timed = signals.withColumn("_at", at).withWatermark("_at", delay)
    return timed.groupBy("model").transformWithStateInPandas(
        OrderedTrigger(rules, n, cooldown_hours * 3600.0), TRIGGER_SCHEMA, "Append", "EventTime"
    )
