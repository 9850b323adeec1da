"""Keyed state machines over event streams.

Each processor is built inside a function with its parameters; the package must
be on the workers' path.

Files may come in any order. Users are dealt to buckets, and the events of a bucket wait in the state until the watermark has passed
them and are then applied in the order of ``(us, event_id)``, so that what the stream gives is what the
whole log gives up to the watermark. The state holds the events of the time allowed for lateness and a machine
per user, not the log. An event from before the watermark is dropped, as in any watermarked query; one without a time has no place in
the order and is left out. Stroke logs are numbered, not timed: there a row from before the last batch of
its route ends the stream with an error instead of a wrong count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnfell.functions import fixed
from tarnfell.operators.engagement import ORDER, micros

HELD_SCHEMA = "user_id long, us long, event_id long, kind string, meters double, app_version string"
HELD_COLUMNS = ["user_id", "us", "event_id", "kind", "meters", "app_version"]
OPENS_SCHEMA = "user_id long, event_id long, us long, is_open boolean"
PROMPTS_SCHEMA = "user_id long, event_id long, us long, app_version string, number int"
STROKES_SCHEMA = "route_id long, n_strokes int, n_vertices int, last_seq long"
#: How much later than the latest event seen so far an event may come.
LATENESS = "1 day"
#: Keys that users are dealt to. The calls of the state are paid per bucket, and a bucket is read whole when its time has come.
BUCKETS = 512


class TimeOrdered(StatefulProcessor):
    """A machine whose events wait for the watermark; subclasses say what a stretch of a user's ordered events does.

    A key is a bucket of users, since each call of the state costs far more than an event. One timer is set for the
    bucket's earliest waiting event. When the watermark has passed it, everything due is taken
    out, put in order and applied at once user by user, and the timer is set for what still waits.
    """

    machine_schema: str

    def apply(self, machine: tuple | None, events: dict[str, np.ndarray]) -> tuple[tuple, dict[str, np.ndarray]]:
        """The machine after ``events`` of one user, and the columns to emit; ``machine`` is None before the first event."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD_SCHEMA)
        self.machines = handle.getListState("machines", f"user_id long, {self.machine_schema}")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, us: int) -> None:
        """Set the bucket's timer for ``us`` unless it is set for an earlier moment."""
        ms = -(-int(us) // 1000)
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= ms:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for chunk in rows:
            if len(chunk):
                self.held.appendList(list(zip(*(chunk[c].tolist() for c in HELD_COLUMNS), strict=True)))
                first = int(chunk["us"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        held = pd.DataFrame(self.held.get() if self.held.exists() else [], columns=HELD_COLUMNS)
        is_due = held["us"] <= timerValues.getCurrentWatermarkInMs() * 1000
        waiting = held[~is_due]
        if len(waiting):
            self._wake(waiting["us"].min())
        if not is_due.any():
            return
        if len(waiting):
            self.held.put(list(zip(*(waiting[c].tolist() for c in HELD_COLUMNS), strict=True)))
        else:
            self.held.clear()
        due = held[is_due].sort_values(["user_id", *ORDER])
        columns = {c: due[c].to_numpy() for c in HELD_COLUMNS}
        machines = {m[0]: tuple(m[1:]) for m in self.machines.get()} if self.machines.exists() else {}
        begins = np.flatnonzero(np.diff(columns["user_id"], prepend=columns["user_id"][0] - 1))
        out = []
        for low, high in zip(begins, [*begins[1:], len(due)], strict=True):
            user = int(columns["user_id"][low])
            machines[user], shown = self.apply(machines.get(user), {c: x[low:high] for c, x in columns.items()})
            out.append({"user_id": np.full(len(shown["event_id"]), user), **shown})
        self.machines.put([(user, *machine) for user, machine in machines.items()])
        if any(len(o["user_id"]) for o in out):
            yield pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})

    def close(self) -> None:
        pass


def _timed(events: DataFrame, lateness: str, buckets: int) -> DataFrame:
    """Events with ``us``, the watermark on ``_at`` and the ``_bucket`` of their user, of those with a user and a time."""
    timed = events.filter("user_id is not null and ts is not null").withColumn("_at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("_at", lateness).withColumn("us", micros(F.col("ts")))
    return timed.select(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("_bucket"), "_at", *HELD_COLUMNS)


def _run(events: DataFrame, lateness: str, buckets: int, processor: TimeOrdered, schema: str) -> DataFrame:
    return _timed(events, lateness, buckets).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def opens_of(us: np.ndarray, kinds: np.ndarray, launched: bool, background: int | None, gap: int) -> tuple[np.ndarray, np.ndarray, bool, int | None]:
    """Places of the activations among ordered events, whether each counts as an open, and the state after them.

    An activation forgets the background event before it, except the very first, which leaves it to its successor.
    """
    active = np.flatnonzero(kinds == "active")
    latest = np.maximum.accumulate(np.where(kinds == "background", np.arange(len(us)), -1))
    # From which place on a background event counts for each activation; -1 reaches back into the state.
    since = np.concatenate([[-1], active])
    if not launched and len(since) > 1:
        since[1] = -1
    found, reach = latest[active], since[:-1]
    opened = (found > reach) & (us[active] - us[found] >= gap)
    if background is not None:
        opened |= (reach < 0) & (found < 0) & (us[active] - background >= gap)
    if not launched:
        opened[:1] = True
    if latest[-1] > since[-1]:
        background = int(us[latest[-1]])
    elif since[-1] >= 0:
        background = None
    return active, opened, launched or len(active) > 0, background


def open_sessions(events: DataFrame, gap_seconds: int = fixed.OPEN_GAP_SECONDS, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Activations and whether each counts as an app open, once the watermark (``lateness`` behind the latest event) has passed them.

    ``events(user_id, event_id, ts, kind, meters, app_version)``; other columns are not carried.
    """
    gap = gap_seconds * 1_000_000

    class Opens(TimeOrdered):
        machine_schema = "launched boolean, background_us long"

        def apply(self, machine: tuple | None, events: dict[str, np.ndarray]) -> tuple[tuple, dict[str, np.ndarray]]:
            launched, background = machine or (False, None)
            us = events["us"]
            at, opened, launched, background = opens_of(us, events["kind"], launched, background, gap)
            return (launched, background), {"event_id": events["event_id"][at], "us": us[at], "is_open": opened}

    return _run(events, lateness, buckets, Opens(), OPENS_SCHEMA)


def prompt_machine(events: DataFrame, gap_days: float = fixed.PROMPT_GAP_DAYS,
                   gap_seconds: int = fixed.OPEN_GAP_SECONDS, lateness: str = LATENESS, buckets: int = BUCKETS) -> DataFrame:
    """Prompts of every user, from opens, successes, versions and the prompt gap, once the watermark has passed them.

    Events as for ``open_sessions``. The counters of a stretch are running sums; only from prompt to prompt is there a step in Python.
    """
    open_gap, prompt_gap = gap_seconds * 1_000_000, int(gap_days * 86_400 * 1_000_000)
    need_opens, need_measured = fixed.REQUIRED_OPENS, fixed.REQUIRED_MEASUREMENTS
    min_metres = fixed.MIN_MEASUREMENT_M

    class Prompts(TimeOrdered):
        machine_schema = ("launched boolean, background_us long, opens long, downloads long, measurements long, "
                          "version string, prompted_us long, number int")

        def apply(self, machine: tuple | None, events: dict[str, np.ndarray]) -> tuple[tuple, dict[str, np.ndarray]]:
            launched, background, opens, downloads, measured, version, prompted, number = (
                machine or (False, None, 0, 0, 0, None, None, 0))
            us, kinds = events["us"], events["kind"]
            at, opened, launched, background = opens_of(us, kinds, launched, background, open_gap)
            steps = np.zeros(len(us), dtype=np.int64)
            steps[at] = opened
            download = kinds == "download_complete"
            measurement = (kinds == "measurement") & (events["meters"].astype(float) >= min_metres)
            all_opens, all_downloads, all_measured = (
                start + np.cumsum(x) for start, x in ((opens, steps), (downloads, download), (measured, measurement)))
            engaged = (all_opens >= need_opens) & ((all_downloads >= 1) | (all_measured >= need_measured))
            moments = np.flatnonzero((download | measurement) & engaged)
            times, versions, ids = us[moments], events["app_version"].astype(object)[moments], events["event_id"][moments]
            at, i = [], 0
            while i < len(moments):
                if prompted is not None:
                    i = max(i, int(np.searchsorted(times, prompted + prompt_gap)))
                    others = np.flatnonzero(versions[i:] != version)
                    if not len(others):
                        break
                    i += int(others[0])
                version, prompted, number = versions[i], int(times[i]), number + 1
                at.append(i)
                i += 1
            machine = (launched, background, int(all_opens[-1]), int(all_downloads[-1]), int(all_measured[-1]), version, prompted, number)
            numbers = np.arange(number - len(at) + 1, number + 1, dtype=np.int32)
            return machine, {"event_id": ids[at], "us": times[at], "app_version": versions[at], "number": numbers}

    return _run(events, lateness, buckets, Prompts(), PROMPTS_SCHEMA)


def in_order(rows: Iterator[pd.DataFrame], order: list[str], last: int | None) -> pd.DataFrame:
    """A key's rows of one batch by ``order``; an error if they begin before ``last``, where the batch before ended."""
    batch = pd.concat(list(rows)).sort_values(order)
    if last is not None and len(batch) and batch[order[0]].iloc[0] < last:
        raise ValueError(f"rows out of order: {order[0]} {batch[order[0]].iloc[0]} after {last}; give the stream older files first")
    return batch


def stroke_logs(log: DataFrame) -> DataFrame:
    """Strokes and vertices of each edited route after every batch; one route is one document."""

    class Strokes(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.sizes = handle.getValueState("strokes", "sizes array<int>, last_seq long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            sizes, last = self.sizes.get() if self.sizes.exists() else ([], None)
            sizes = list(sizes)
            batch = in_order(rows, ["seq"], last)
            for row in batch.itertuples(index=False):
                if row.op == "clear":
                    sizes = []
                elif row.op == "undo":
                    sizes = sizes[:-1]
                elif row.size_ >= 2:
                    sizes.append(int(row.size_))
            self.sizes.update((sizes, int(batch["seq"].iloc[-1])))
            yield pd.DataFrame([(key[0], len(sizes), sum(sizes), int(batch["seq"].max()))],
                               columns=["route_id", "n_strokes", "n_vertices", "last_seq"])

        def close(self) -> None:
            pass

    shaped = log.select("route_id", "seq", "op", F.col("size").alias("size_"))
    return shaped.groupBy("route_id").transformWithStateInPandas(
        statefulProcessor=Strokes(), outputStructType=STROKES_SCHEMA, outputMode="Update", timeMode="None")
