"""Repeated passages of notes, byte by byte, by suffix arrays over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.common import numbered, stored, text_of
from tarnfell.llm.suffixes import repeated_starts

#: Bytes of a gram, whose hash decides where a passage is looked at.
_GRAM = 48
#: Passage starts handled at once.
_CHUNK = 1 << 20
#: Runs of one gram that one shard takes; more are spread over several shards, which are merged.
_CAP = 2_000
#: Bytes that a shard should hold.
_SHARD = 2 << 20

_RANDOM = np.random.default_rng(20_240)
_TABLE = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_ONE, _TWO, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ONE + b * _TWO
    return x ^ (x >> _FOLD)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``_GRAM`` = 32 + 16 bytes from each position on, built by doubling."""
    h = _TABLE[data]
    for step in (1, 2, 4, 8):
        h = _mixed(h[:-step], h[step:])
    sixteen = h
    h = _mixed(h[:-16], h[16:])
    return _mixed(h[:len(h) - 16], sixteen[32:])


def _sliding(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[:len(a) - (width - done)], a[width - done:]) if width > done else a


def _runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of neighbouring passages with the same smallest gram: first start, passages, gram hash, its occurrences.

    Equal passages have the same smallest gram, so those that repeat meet under
    its hash. ``bounds`` are the texts' bounds in ``data``; passages stay inside.
    """
    grams = length - _GRAM + 1
    for at in range(0, len(data) - length + 1, _CHUNK):
        part = data[at:at + _CHUNK + length - 1]
        h = _gram_hashes(part)
        least = _sliding(h, grams, np.minimum)
        starts = np.arange(at, at + len(least))
        texts = np.searchsorted(bounds, starts, side="right")
        inside = starts + length <= bounds[np.minimum(texts, len(bounds) - 1)]
        if not inside.any():
            continue
        least[~inside] = 0
        fresh = inside.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (texts[1:] != texts[:-1])
        first = np.flatnonzero(fresh)
        stop = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
        # Occurrences of the gram: places that are the least of some passage around them.
        pad = np.zeros(grams - 1, np.uint64)
        kept = np.flatnonzero(h == _sliding(np.concatenate([pad, least, pad]), grams, np.maximum))
        low, high = np.searchsorted(kept, first), np.searchsorted(kept, stop - 1 + grams)
        owner = np.repeat(np.arange(len(first)), high - low)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        times = np.bincount(owner, h[kept[place]] == least[first][owner], len(first)).astype(np.int32)
        yield first + at, stop - first, least[first].view(np.int64), times


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[:bounds[-1]] if data is not None else np.zeros(0, np.uint8), bounds


def _runs_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = _bytes_of(batch.column("notes"))
            rows = batch.column("_row").to_numpy()
            for first, count, gram, times in _runs(data, bounds, length):
                text = np.searchsorted(bounds, first, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[text]), pa.array(first - bounds[text]), pa.array(count), pa.array(gram), pa.array(times)],
                    names=["_row", "start", "count", "gram", "times"])
    return run


_PART = "shard bigint, hot boolean, _row bigint, start bigint, part binary"


def _cut_out(length: int):
    """Passages by shard, cut out of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, notes, cuts in zip(batch.column("_row").to_pylist(), batch.column("notes").cast(pa.binary()), batch.column("_cuts")):
                notes = notes.as_py()
                cuts = cuts.values.flatten()
                for shard, hot, start, count in zip(*(c.to_pylist() for c in cuts)):
                    out.append((shard, hot, row, start, notes[start:start + count - 1 + length]))
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)
    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    shard, hot, row, start, part = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(hot, pa.bool_()), pa.array(row, pa.int64()),
                                       pa.array(start, pa.int64()), pa.array(part, pa.binary())], names=["shard", "hot", "_row", "start", "part"])


_FOUND = "_row bigint, from bigint, to bigint, high bigint, low bigint, shard bigint"


def _in_shard(length: int):
    """Repeated stretches of a shard's passages; of hot grams also what other shards must be asked for.

    Rows with a null ``high`` are stretches. The others stand for a different
    passage of the shard each: its hash, and the place if it occurs here once.
    """
    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(p, len(index)) for p in parts), np.int64, len(parts))
        different = list(index)
        sizes = np.fromiter(map(len, different), np.int64, len(different))
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        found = repeated_starts(different, length)
        copies = np.bincount(which, minlength=len(different)) > 1
        row, start = table.column("_row").to_numpy(), table.column("start").to_numpy()
        hot = table.column("hot").to_numpy(zero_copy_only=False)
        shard = table.column("shard")[0].as_py() if len(parts) else 0
        stretches, asked = [], []
        by_part = [found[b:b + s - length + 1] | c for b, s, c in zip(begins, sizes, copies)]
        edges = [np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]]))).reshape(-1, 2) for f in by_part]
        count = np.fromiter((len(edges[w]) for w in which), np.int64, len(which))
        if count.sum():
            each = np.concatenate([edges[w] for w in which])
            base = np.repeat(start, count)
            stretches = [np.repeat(row, count), base + each[:, 0], base + each[:, 1] - 1 + length]
        told: set[bytes] = set()
        for i in np.flatnonzero(hot):
            w = which[i]
            part = different[w]
            if hot[i] and part not in told:
                told.add(part)
                for at in range(len(part) - length + 1):
                    digest = xxhash.xxh3_128_digest(part[at:at + length])
                    asked.append((digest, None if by_part[w][at] else int(row[i]), int(start[i]) + at))
        columns: list[list] = [[], [], [], [], []]
        seen: set[bytes] = set()
        for digest, owner, at in asked:
            if owner is None and digest in seen:
                continue
            seen.add(digest)
            columns[0].append(owner)
            columns[1].append(at)
            columns[2].append(at + length)
            columns[3].append(int.from_bytes(digest[:8], "little", signed=True))
            columns[4].append(int.from_bytes(digest[8:], "little", signed=True))
        n = len(stretches[0]) if len(stretches) else 0
        arrays = []
        for k in range(3):
            near = pa.array(stretches[k], pa.int64()) if n else pa.array([], pa.int64())
            arrays.append(pa.concat_arrays([near, pa.array(columns[k], pa.int64())]))
        for k in (3, 4):
            arrays.append(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(columns[k], pa.int64())]))
        arrays.append(pa.array(np.full(n + len(columns[0]), shard)))
        return pa.Table.from_arrays(arrays, names=["_row", "from", "to", "high", "low", "shard"])
    return run


def _merged(table: pa.Table) -> pa.Table:
    """Passages that occur once in their shard but in another, too: every shard's are looked up among all by binary search."""
    high, low = table.column("high").to_numpy(), table.column("low").to_numpy()
    pairs = np.empty(len(high), dtype=[("h", np.int64), ("l", np.int64)])
    pairs["h"], pairs["l"] = high, low
    everyone = np.sort(pairs)
    once = ~table.column("_row").is_null().to_numpy()
    times = np.searchsorted(everyone, pairs[once], side="right") - np.searchsorted(everyone, pairs[once], side="left")
    rows = table.filter(pa.array(once)).filter(pa.array(times > 1))
    return rows.select(["_row", "from", "to"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept, sizes = [], [], [], []
        for notes, cuts in zip(batch.column("notes").cast(pa.binary()), batch.column("_cuts")):
            notes = notes.as_py()
            pieces, at, gone, runs, end = [], 0, 0, 0, -1
            for cut in sorted((c["from"], c["to"]) for c in cuts.as_py() or ()):
                if cut[0] > end:
                    pieces.append(notes[at:cut[0]])
                    runs += 1
                    end = cut[0]
                gone += max(0, cut[1] - end)
                end = max(end, cut[1])
                at = end
            pieces.append(notes[at:])
            sizes.append(len(notes))
            removed.append(gone)
            spans.append(runs)
            kept.append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)),
                                          pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(pins: DataFrame, length: int = 200) -> DataFrame:
    """Notes without the bytes of passages that occur more than once.

    ``pins`` has ``id`` and ``notes`` of saved pins. Notes are UTF-8 bytes. Every
    byte goes that lies in a string of ``length`` bytes that also starts anywhere
    else, in the same notes or others; strings are judged on the input, overlaps
    count, and no string crosses notes. ``length`` is at least 64.

    Method: neighbouring passages with the same smallest gram are cut out
    together and dealt to shards by that gram, so equal passages share a shard;
    grams that occur once anywhere are left out. Each shard sorts the suffixes of
    its passages (Larsson-Sadakane) and takes common prefixes (Kasai); a prefix
    of ``length`` bytes is a repeat. A gram with more runs than a shard may hold
    is dealt to several, which are merged by binary search over the hashes
    (128 bits) of their different passages.

    Returns one row per input row: ``id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept`` (binary, the bytes that
    stay; characters may be cut). Null notes are empty. Repeated rows are repeats
    of each other. Extra columns are not carried; an empty table gives no rows.
    """
    if length < 64:
        raise ValueError("length must be at least 64")
    notes = numbered(pins.select("id", text_of("notes").alias("notes")), "notes")
    runs = stored(notes.select("_row", "notes").mapInArrow(
        _runs_of(length), "_row bigint, start bigint, count bigint, gram bigint, times int"), "repeat-runs")
    often = stored(runs.groupBy("gram").agg(F.sum("times").alias("_n")).filter("_n > 1"), "repeat-grams")
    total, most = often.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    shards = int(total) * (length + length // 2) // _SHARD + 1
    dealt = runs.drop("times").join(often, "gram").withColumn(
        "_salt", F.pmod(F.xxhash64("_row", "start"), F.ceil(F.col("_n") / _CAP).cast("long")))
    dealt = dealt.select("_row", F.struct(
        F.pmod(F.xxhash64("gram", "_salt"), F.lit(shards)).alias("shard"), (F.col("_n") > _CAP).alias("hot"), "start", "count").alias("_cut"))
    cuts = dealt.groupBy("_row").agg(F.collect_list("_cut").alias("_cuts"))
    parts = notes.select("_row", "notes").join(cuts, "_row").mapInArrow(_cut_out(length), _PART)
    kind = notes.schema["id"].dataType.simpleString()
    found = stored(parts.groupBy("shard").applyInArrow(_in_shard(length), _FOUND), "repeat-stretches")
    stretches = found.filter("high is null").select("_row", "from", "to")
    if most > _CAP:
        asked = found.filter("high is not null")
        buckets = asked.count() // 100_000 + 1
        asked = asked.withColumn("_bucket", F.pmod(F.xxhash64("high"), F.lit(buckets)))
        stretches = stretches.unionByName(asked.groupBy("_bucket").applyInArrow(_merged, "_row bigint, from bigint, to bigint"))
    gone = stretches.groupBy("_row").agg(F.collect_list(F.struct("from", "to")).alias("_cuts"))
    return notes.join(gone, "_row", "left").select("id", "notes", "_cuts").mapInArrow(
        _assembled, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

