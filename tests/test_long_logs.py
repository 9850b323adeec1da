"""Operators that must not gather a route or a user, against plain walks, with one key that holds a third of all rows."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import chains, engagement, ordered, routes

UTC = datetime.timezone.utc


def plain_simplified(track, tolerance):
    """Farthest vertex of each span, by looking at all of them."""
    keep, waiting = {0, len(track) - 1}, [(0, len(track) - 1)]
    while waiting:
        low, high = waiting.pop()
        (_, ay, ax), (_, by, bx) = track[low], track[high]
        best, at = -1.0, None
        for i in range(low + 1, high):
            px, py, dx, dy = track[i][2] - ax, track[i][1] - ay, bx - ax, by - ay
            square = dx * dx + dy * dy
            t = min(1.0, max(0.0, (px * dx + py * dy) / square)) if square else 0.0
            off = math.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
            if off > best:
                best, at = off, i
        if at is not None and best > tolerance:
            keep.add(at)
            waiting += [(low, at), (at, high)]
    return [track[i] for i in sorted(keep)]


def tracks(seed):
    maker = random.Random(seed)
    sizes = {0: 900, **{r: maker.choice([1, 2, 3, 40, 90]) for r in range(1, 30)}}
    out = {}
    for route, size in sizes.items():
        y = x = 0
        track, seq = [], maker.randrange(5)
        for _ in range(size):
            track.append((seq, y, x))
            seq, y, x = seq + maker.randrange(1, 9), y + maker.randrange(-30, 31), x + maker.choice([0, 15, 40])
        out[route] = track
    return out


@pytest.mark.parametrize("span", [4, 64, 1024])
def test_simplified_by_rounds(spark, span):
    given = tracks(span)
    df = spark.createDataFrame([(r, *v) for r, t in given.items() for v in t], "route_id long, seq long, lat_e5 long, lon_e5 long").repartition(5)
    want = {(r, *v) for r, t in given.items() for v in plain_simplified(t, 45.0)}
    got = [tuple(r) for r in routes.simplified(df, 45.0, span).collect()]
    assert len(got) == len(want) and set(got) == want


def test_empty_route_table(spark):
    empty = spark.createDataFrame([], "route_id long, seq long, lat_e5 long, lon_e5 long")
    assert routes.simplified(empty, 10.0).collect() == []


def test_chains(spark):
    length = 700
    pointers = [(1, i, i + 3 if i + 3 < length else None) for i in range(length)] + [(2, 5, 9), (2, 9, 11), (2, 6, 9), (3, 1, None)]
    got = chains.followed(spark.createDataFrame([(1, 2), (2, 5), (3, 1)], "key long, node long"),
                          spark.createDataFrame(pointers, "key long, node long, next long"))
    want = {(1, n, k) for k, n in enumerate(range(2, length, 3), 1)} | {(2, 5, 1), (2, 9, 2), (2, 11, 3), (3, 1, 1)}
    assert {tuple(r) for r in got.collect()} == want


def plain_prompts(moments, gap):
    out, last = [], {}
    for user, us, event, version, eligible in sorted(moments, key=lambda m: (str(m[0]), m[1], m[2])):
        before = last.get(user)
        if eligible and (before is None or (us - before[0] >= gap and version != before[1])):
            last[user] = (us, version, before[2] + 1 if before else 1)
            out.append((user, event, us, version, last[user][2]))
    return out


def test_prompts_by_pointer_doubling(spark):
    maker, moments = random.Random(3), []
    for event in range(3_000):
        user = 7 if maker.random() < 0.4 else maker.randrange(60)
        # Many moments share a second, and many a version.
        us = maker.randrange(0, 400) * 1_800_000_000 + maker.choice([0, 0, 1])
        moments.append((user, us, event, maker.choice(["1.0", "1.1", "1.1", "1.2"]), maker.random() < 0.8))
    df = spark.createDataFrame(moments, "user_id long, us long, event_id long, app_version string, eligible boolean").repartition(4)
    gap_days = 0.25
    got = [tuple(r) for r in engagement.prompts(df, gap_days).select("user_id", "event_id", "us", "app_version", "number").collect()]
    assert sorted(got) == sorted(plain_prompts(moments, int(gap_days * 86_400_000_000)))
    assert max(r[4] for r in got) > 20
    assert engagement.prompts(df.limit(0)).collect() == []


def test_next_known_value(spark):
    rows = [(k, i // 3, i, None if (i * 7 + k) % 4 else i * 10) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, chunk long, i long, v long")
    got = {(r.k, r.i): r.out for r in ordered.next_value(df, ["k"], "chunk", ["i"], F.col("v"), "out", skip_null=True).collect()}
    for k, _, i, _ in rows:
        assert got[k, i] == next((v for k2, _, j, v in rows if k2 == k and j > i and v is not None), None)
    plain = {(r.k, r.i): r.out for r in ordered.next_value(df, ["k"], "chunk", ["i"], F.col("v"), "out").collect()}
    for k, _, i, _ in rows:
        assert plain[k, i] == next((v for k2, _, j, v in rows if k2 == k and j == i + 1), None)


@pytest.mark.parametrize("stretch", [3, 50, 1 << 16])
def test_strokes_across_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(routes, "_STRETCH", stretch)
    maker, log = random.Random(stretch), []
    for seq in range(1_500):
        route = 1 if maker.random() < 0.4 else maker.randrange(12)
        op = maker.choices(["append", "undo", "clear"], [6, 5, 0.1 if route != 1 else 0])[0]
        log.append((route, seq, op, maker.randrange(1, 6)))
    stacks = {}
    for route, seq, op, size in log:
        stack = stacks.setdefault(route, [])
        if op == "clear":
            stack.clear()
        elif op == "undo":
            if stack:
                stack.pop()
        elif size >= 2:
            stack.append((route, seq, size))
    df = spark.createDataFrame(log, "route_id long, seq long, op string, size int").repartition(3)
    assert sorted(tuple(r) for r in routes.surviving_strokes(df).collect()) == sorted(s for stack in stacks.values() for s in stack)


def test_chunks_by_count(spark):
    rows = [(7, 5, i) for i in range(4_000)] + [(i % 300, i, i) for i in range(8_000)] + [(None, 1, i) for i in range(500)]
    df = spark.createDataFrame(rows, "user_id long, us long, event_id long").repartition(6)
    got = ordered.counted_chunks(df, ["user_id"], ["us", "event_id"], rows=500)
    assert got.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 1_500
    assert got.groupBy("user_id", "_chunk").count().filter("user_id = 7").count() >= 4
    last = {}
    for r in sorted(got.collect(), key=lambda r: (-1 if r.user_id is None else r.user_id, r.us, r.event_id)):
        assert last.get(r.user_id, -1) <= r._chunk
        last[r.user_id] = r._chunk
    assert got.count() == len(rows) and ordered.counted_chunks(df.limit(0), ["user_id"], ["us"]).count() == 0
