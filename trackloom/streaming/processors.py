"""Stateful operators over event time: rows in order as the watermark passes them, state that ends by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from trackloom.operators.predicates import in_edges, ring_edges

TERMINAL = ("done", "error")


#: A column with nulls reaches pandas as floats; state takes values of its own types only.
_CASTS = {"long": int, "double": float, "boolean": bool, "string": str}


class InOrder(StatefulProcessor):
    """Hands a key's rows to ``step`` in the order of their fields, time first, once the watermark has passed their time.

    Rows wait in a list; one timer a key stands at the earliest of them. When no row waits and the
    watermark is ``patience_ms`` past the last one, ``over`` gives what is still open and all state of the
    key goes. A row that comes later than that begins anew, as does one that follows its predecessor
    by more than that, so the result hangs on the rows' times, not on their arrival, as long as no
    row is later than the watermark.
    """

    fields = "at_ms long"  #: of a waiting row
    state = "last_ms long"  #: of a key
    out = ""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.kept = handle.getValueState("kept", self.state)
        self.due = handle.getValueState("due", "at long")

    def step(self, key, row: tuple, state: tuple | None) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def over(self, key, state: tuple) -> list[tuple]:
        return []

    def flushed(self, key, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple | None]:
        """Output of rows that the watermark has passed, and the state after them."""
        told: list[tuple] = []
        for row in rows:
            if state is not None and row[0] < state[0]:
                continue  # later than the watermark
            if state is not None and row[0] - state[0] > self.patience_ms:
                told += self.over(key, state)
                self.forget()
                state = None
            more, state = self.step(key, row, state)
            told += more
        return told, state

    def forget(self) -> None:
        """Drop what a subclass keeps besides ``state``."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fields = [(n, _CASTS[t]) for n, t in (f.split() for f in self.fields.split(", "))]
        fresh = [r for some in rows for r in zip(*[[None if gone else cast(v) for v, gone in zip(some[n], some[n].isna(), strict=True)] for n, cast in fields], strict=True)]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(r[0] for r in fresh), sooner=True)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.kept.get()) if self.kept.exists() else None
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[0] <= mark), key=lambda r: tuple((v is not None, v) for v in r))
        rest = [r for r in rows if r[0] > mark]
        told, state = self.flushed(key, ready, state)
        if not rest and state is not None and mark >= state[0] + self.patience_ms:
            told += self.over(key, state)
            self.forget()
            state = None
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        if state is None and not rest:
            for held in (self.waiting, self.kept, self.due):
                held.clear()
        else:
            if state is None:
                self.kept.clear()
            else:
                self.kept.update(state)
            self._wake(min(r[0] for r in rest) if rest else state[0] + self.patience_ms)
        yield self._frame(told)

    def _wake(self, at: int, sooner: bool = False) -> None:
        """Move the key's one timer to ``at``, or leave it where it stands sooner."""
        if self.due.exists():
            now = self.due.get()[0]
            if sooner and now <= at:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(int(at))
        self.due.update((int(at),))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in self.out.split(", ")])

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, time: str, watermark: str, processor: InOrder) -> DataFrame:
    """``rows`` with the processor's fields, grouped by ``key``; rows without a key or a time are none."""
    names = [f.split()[0] for f in processor.fields.split(", ")]
    timed = rows.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, watermark)
    # The event time stays a column, which is what makes later rows than the watermark known as such.
    return timed.select(key, time, *names).groupBy(key).transformWithStateInPandas(processor, processor.out, "Append", "EventTime")


class _Gaps(InOrder):
    state = "last_ms long"

    def __init__(self, patience_ms: int, epoch_ms: int, run: str):
        super().__init__(patience_ms)
        self.epoch_ms, self.out = epoch_ms, f"{run} long, from_s long, to_s long"

    def step(self, key, row, state):
        last, now = (None if state is None else state[0] // self.epoch_ms), row[0] // self.epoch_ms
        return [(key[0], last + 1, now - 1)] if last is not None and now > last + 1 else [], (row[0],)

    def over(self, key, state):
        last, end = state[0] // self.epoch_ms, (state[0] + self.patience_ms) // self.epoch_ms
        return [(key[0], last + 1, end)] if end > last else []


def gaps(fixes: DataFrame, run: str, time: str, patience_ms: int, epoch_ms: int = 1000, watermark: str = "10 minutes") -> DataFrame:
    """STR-05: (run, from, to) of epochs of ``epoch_ms`` without a fix, as the watermark passes the fix after them.

    A run that is silent for ``patience_ms`` is over: the gap that is open then is closed at that time, as
    the watermark passes it, and the run's state goes.
    """
    rows = fixes.select(run, time, F.unix_millis(time).alias("at_ms"))
    return _run(rows, run, time, watermark, _Gaps(patience_ms, epoch_ms, run))


class _Laps(InOrder):
    fields = "at_ms long, t double, arc double"
    state = "last_ms long, lap long, began double, last double"

    def __init__(self, patience_ms: int, length: float, run: str):
        super().__init__(patience_ms)
        self.length, self.out = length, f"{run} long, lap long, seconds double"

    def step(self, key, row, state):
        at, t, arc = row
        lap = int(arc // self.length)
        if state is None:
            return [], (at, lap, t, t)
        _, current, began, _ = state
        if lap > current:
            return [(key[0], current, t - began)], (at, lap, t, t)
        return [], (at, current, began, t)

    def over(self, key, state):
        return [(key[0], state[1], state[3] - state[2])]


def laps(samples: DataFrame, run: str, arc: str, time: str, length: float, patience_ms: int, watermark: str = "10 minutes") -> DataFrame:
    """STR-06: (run, lap, seconds) as the watermark passes the first sample of the next lap; a silent run's last lap ends with its last sample. Samples without an arc are none."""
    rows = samples.where(F.col(arc).isNotNull()).select(run, time, F.unix_millis(time).alias("at_ms"), (F.unix_micros(time) / 1e6).alias("t"), F.col(arc).cast("double").alias("arc"))
    return _run(rows, run, time, watermark, _Laps(patience_ms, length, run))


class _Entries(InOrder):
    fields = "at_ms long, seq long, region long"
    state = "last_ms long, last_seq long, inside array<long>, before array<long>"

    def __init__(self, patience_ms: int, run: str, order: str, region: str):
        super().__init__(patience_ms)
        self.out = f"{run} long, {region} long, {order} long, entry long"

    def init(self, handle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "region long", "entries long")

    def forget(self) -> None:
        self.counts.clear()
        self.known, self.told = {}, set()

    def flushed(self, key, rows, state):
        # A count is read once and written once for all rows that the watermark passes at once.
        self.known, self.told, self.stored = {}, set(), state is not None
        out = super().flushed(key, rows, state)
        for region in self.told:
            self.counts.updateValue((region,), (self.known[region],))
        return out

    def step(self, key, row, state):
        at, seq, region = row
        self.stored = self.stored and state is not None  # what was stored goes with the state
        inside, before = ([], []) if state is None else (list(state[2]), list(state[3]))
        if state is not None and (at, seq) != (state[0], state[1]):
            inside, before = [], inside  # the next sample: what was inside so far is what it came from
        told = []
        if region is not None and region not in inside:
            inside.append(region)
            if region not in before:
                if region not in self.known:
                    self.known[region] = self.counts.getValue((region,))[0] if self.stored and self.counts.containsKey((region,)) else 0
                told = [(key[0], region, seq, self.known[region])]
                self.known[region] += 1
                self.told.add(region)
        return told, (at, seq, inside, before)


def entries(points: DataFrame, regions: DataFrame, run: str, time: str, order: str, patience_ms: int, region: str = "region_id", ring: str = "ring", size: float = 50.0, watermark: str = "10 minutes") -> DataFrame:
    """STR-04: (run, region, order, entry): samples of points(run, time, order, x, y) that enter a region, which the one before them was not in, counted for each run and region.

    The stream meets ``regions``, with rings of corners, in buckets of ``size``; a sample in no region
    stays, for it is what ends a visit. Samples are taken in event order, whatever order their files have. A run
    silent for ``patience_ms`` is over, and its counts begin anew.
    """
    met = points.join(_edged(regions, region, ring, size), (F.floor(F.col("x") / size) == F.col("_bx")) & (F.floor(F.col("y") / size) == F.col("_by")) & in_edges("x", "y", F.col("_edges")), "left")
    rows = met.select(run, time, F.unix_millis(time).alias("at_ms"), F.col(order).cast("long").alias("seq"), F.col(region).cast("long").alias("region"))
    return _run(rows, run, time, watermark, _Entries(patience_ms, run, order, region))


def _edged(regions: DataFrame, region: str, ring: str, size: float) -> DataFrame:
    """Each region in the buckets that its box touches, with its edges."""
    corners = F.col(ring)
    ends = {c: (F.floor(F.array_min(F.transform(corners, lambda v: v[c])) / size), F.floor(F.array_max(F.transform(corners, lambda v: v[c])) / size)) for c in "xy"}
    spread = regions.where(F.size(ring) >= 3).select(F.col(region), ring_edges(corners).alias("_edges"), F.explode(F.sequence(*ends["x"])).alias("_bx"), F.sequence(*ends["y"]).alias("_ys"))
    return spread.select(region, "_edges", "_bx", F.explode("_ys").alias("_by"))


class _Watched(InOrder):
    fields = "at_ms long, joins boolean, event_id long, type string, watcher long"
    state = "last_ms long, told_ms long, event_id long, type string, ended boolean"
    out = "task_id long, watcher long, kind string, at_ms long, event_id long, type string"

    def __init__(self, patience_ms: int, lag: int | None):
        super().__init__(patience_ms)
        self.lag = lag

    def init(self, handle) -> None:
        super().init(handle)
        self.watchers = handle.getMapState("watchers", "watcher long", "since long")

    def forget(self) -> None:
        self.watchers.clear()

    def flushed(self, key, rows, state):
        # Who watched before these rows came and lies too far behind sees only where they lead.
        behind = self.lag is not None and sum(not r[1] for r in rows) > self.lag
        self.skipping = {w[0] for w in self.watchers.keys()} if behind else set()
        told, state = super().flushed(key, rows, state)
        if self.skipping and state is not None:
            told += [(key[0], w, "snapshot", *state[1:4]) for w in sorted(self.skipping)]
        return told, state

    def step(self, key, row, state):
        at, joins, event_id, kind, watcher = row
        _, told_ms, last, what, ended = state or (None, None, None, None, False)
        if joins:
            if not ended:
                self.watchers.updateValue((watcher,), (at,))
            return [(key[0], watcher, "snapshot", told_ms, last, what)], (at, told_ms, last, what, ended)
        if ended:
            return [], (at, told_ms, last, what, ended)
        told = [(key[0], w[0], "event", at, event_id, kind) for w in self.watchers.keys() if w[0] not in self.skipping]
        ended = kind in TERMINAL
        if ended:
            self.watchers.clear()
        return told, (at, at, event_id, kind, ended)


def watched(events: DataFrame, joins: DataFrame, time: str = "at", lag: int | None = None, patience_ms: int = 86_400_000, watermark: str = "10 minutes") -> DataFrame:
    """STR-02: (task_id, watcher, kind, at_ms, event_id, type): what watchers see, who join at any time.

    ``events(task_id, at, event_id, type)`` and ``joins(task_id, at, watcher)`` are taken in the order of time,
    events before watchers of the same instant, and event_id. A watcher first sees a snapshot, the task's last event so far (nulls if
    there is none), then each later event once, and nothing after the first terminal one; who joins
    after that sees it as the snapshot and no more. Of more than ``lag`` events that the watermark passes at once, who watched before sees
    only the state that they lead to. A task without a row for ``patience_ms`` is forgotten.
    """
    own = events.select("task_id", time, F.unix_millis(time).alias("at_ms"), F.lit(False).alias("joins"), F.col("event_id").cast("long").alias("event_id"), "type", F.lit(None).cast("long").alias("watcher"))
    seen = joins.select("task_id", time, F.unix_millis(time).alias("at_ms"), F.lit(True).alias("joins"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("type"), F.col("watcher").cast("long").alias("watcher"))
    return _run(own.union(seen), "task_id", time, watermark, _Watched(patience_ms, lag))
