"""Tokens of two tokenizers lined up on the bytes they share."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tarnfell.llm.common import stored

#: Fixed value: the word pattern of the byte-level vocabulary.
_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes that are encoded and merged together; a longer note is a batch of its own.
_BATCH_BYTES = 3 << 19
#: A-tokens after which a long note may be entered once more.
_STRIDE = 1024
#: Bits of a token id in a packed pair.
_ID_BITS = 20
_LINK = StructType([StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("n", IntegerType())])


class Vocabulary(NamedTuple):
    """``encode`` gives the ids of texts, ``pieces`` the bytes of an id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def byte_level(file: bytes) -> Vocabulary:
    """A byte-level vocabulary file whose merges stand in the order of their ids; special tokens are plain text."""
    import tiktoken

    letters, model = _byte_letters(), json.loads(file)["model"]
    ranks = {bytes(letters[c] for c in piece): number for piece, number in model["vocab"].items() if all(c in letters for c in piece)}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("merges must stand in the order of their ids")
    ranks = {piece: number for piece, number in ranks.items() if number < 256 + len(merged)}
    encoding = tiktoken.Encoding("byte-level", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, number in ranks.items():
        pieces[number] = piece
    return Vocabulary(lambda texts: [encoding.encode_ordinary(t) for t in texts], pieces)


@functools.lru_cache(2)
def sentence_pieces(file: bytes) -> Vocabulary:
    """A sentence-piece model; it puts the leading space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)

    def piece(number: int) -> bytes:
        text = model.id_to_piece(number)
        return bytes([int(text[1:-1], 16)]) if model.is_byte(number) else text.replace("▁", " ").encode()

    return Vocabulary(lambda texts: model.encode([t.removeprefix(" ") for t in texts], num_threads=1),
                      [piece(i) for i in range(model.get_piece_size())])


class Tokens(NamedTuple):
    """Tokens of a batch of notes, one note after the other: ``ids``, byte ``ends`` and where each note ``starts`` (and the last ends)."""

    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


def _flat(lists: list[list[int]], lengths: np.ndarray) -> Tokens:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    ids = np.fromiter((i for x in lists for i in x), np.int64, starts[-1])
    return Tokens(ids, np.cumsum(lengths[ids]), starts)


def _entries(a: Tokens, b: Tokens, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """A and B tokens at which a pointer pair may start: every note, and long notes once a stride where both sides end."""
    inside = [np.arange(lo + stride, hi, stride) for lo, hi in zip(a.starts[:-1], a.starts[1:]) if hi - lo > stride]
    more = np.concatenate(inside) if inside else np.zeros(0, np.int64)
    at = np.searchsorted(b.ends, a.ends[more - 1])
    common = b.ends[at] == a.ends[more - 1]
    begin = np.flatnonzero(np.diff(a.starts))
    first = np.concatenate([a.starts[begin], more[common]]), np.concatenate([b.starts[begin], at[common] + 1])
    order = np.argsort(first[0], kind="stable")
    return first[0][order], first[1][order]


def lockstep(a: Tokens, b: Tokens, stride: int = _STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping token pairs of all notes and whether both end there: positions in ``a``, in ``b``, cuts.

    One state vector holds a pointer pair for every note. A step links the two
    tokens under each pair, cuts where they end together, and moves whichever
    side ends first (both at a cut). Finished notes leave the vector.
    """
    left, right = _entries(a, b, stride)
    stop = np.append(left[1:], a.starts[-1])
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(left[:0], left[:0], np.zeros(0, bool))]
    while len(left):
        x, y = a.ends[left], b.ends[right]
        links.append((left, right, x == y))
        left, right = left + (x <= y), right + (y <= x)
        alive = left < stop
        if not alive.all():
            left, right, stop = left[alive], right[alive], stop[alive]
    return tuple(np.concatenate(x) for x in zip(*links))


def _texts(a: Tokens, b: Tokens, cut_a: np.ndarray, cut_b: np.ndarray, written: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every note. ``written`` has ids followed by a comma, then by a bar, then by a semicolon."""
    third = len(written) // 3
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    of_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=int(cut_a.sum())))])
    of_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=int(cut_b.sum())))])
    place = np.empty(len(a.ids) + len(b.ids), np.int64)
    place[np.arange(len(a.ids)) + of_b[group_a]] = a.ids + third * cut_a
    place[np.arange(len(b.ids)) + of_a[group_b + 1]] = b.ids + 2 * third * cut_b
    ends = a.starts + b.starts
    return ["".join(map(written.__getitem__, place[lo:hi].tolist()))[:-1] for lo, hi in zip(ends[:-1], ends[1:])]


def _batches(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i + 1 == len(texts):
            yield low, i + 1
            low, size = i + 1, 0


def _aligned_batch(texts: list[str | None], a: Vocabulary, b: Vocabulary, lengths: tuple[np.ndarray, np.ndarray], written: list[str]) -> dict[str, pa.Array]:
    spaced = [" " + t if t else "" for t in texts]
    full = [i for i, t in enumerate(spaced) if t]
    given = [spaced[i] for i in full]
    got = [list(x) for x in zip(full, a.encode(given), b.encode(given), strict=True)]
    lists_a: list[list[int]] = [[] for _ in texts]
    lists_b: list[list[int]] = [[] for _ in texts]
    for i, x, y in got:
        whole = spaced[i].encode()
        if b"".join(map(a.pieces.__getitem__, x)) == whole == b"".join(map(b.pieces.__getitem__, y)):
            lists_a[i], lists_b[i] = x, y
    left, right = _flat(lists_a, lengths[0]), _flat(lists_b, lengths[1])
    at_a, at_b, cuts = lockstep(left, right)
    cut_a, cut_b = np.zeros(len(left.ids), bool), np.zeros(len(right.ids), bool)
    cut_a[at_a[cuts]] = cut_b[at_b[cuts]] = True
    note = np.repeat(np.arange(len(texts)), np.diff(left.starts))
    pair = (note[at_a] << 2 * _ID_BITS) | (left.ids[at_a] << _ID_BITS) | right.ids[at_b]
    pair, times = np.unique(pair, return_counts=True)
    mask = (1 << _ID_BITS) - 1
    links = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in ((pair >> _ID_BITS) & mask, pair & mask, times)], ["a", "b", "n"])
    offsets = np.searchsorted(pair >> 2 * _ID_BITS, np.arange(len(texts) + 1)).astype(np.int32)
    count = functools.partial(np.bincount, minlength=len(texts))
    return {"n_a": pa.array(np.diff(left.starts)), "n_b": pa.array(np.diff(right.starts)), "n_groups": pa.array(count(note[cut_a])),
            "n_links": pa.array(count(note[at_a])), "groups": pa.array(_texts(left, right, cut_a, cut_b, written), pa.string()),
            "links": pa.ListArray.from_arrays(pa.array(offsets), links)}


def note_links(pins: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """All columns of ``pins`` but ``notes``, and ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and
    ``links``: the note's different linked ids ``a``, ``b`` with how often (``n``). See ``aligned_notes``."""
    spark = pins.sparkSession

    def sent(path: str) -> Broadcast:
        with open(path, "rb") as file:
            return spark.sparkContext.broadcast(file.read())

    files = sent(byte_file), sent(piece_file)
    carried = [f for f in pins.schema.fields if f.name != "notes"]
    schema = StructType(carried + [StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
                        + [StructField("groups", StringType()), StructField("links", ArrayType(_LINK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(files[0].value), sentence_pieces(files[1].value)
        if max(len(a.pieces), len(b.pieces)) > 1 << _ID_BITS:
            raise ValueError("a vocabulary has too many tokens")
        lengths = tuple(np.array([len(p) for p in v.pieces], np.int64) for v in (a, b))
        written = [f"{i}{mark}" for mark in ",|;" for i in range(max(len(a.pieces), len(b.pieces)))]
        for batch in batches:
            texts = batch.column("notes").to_pylist()
            for low, high in _batches(texts, _BATCH_BYTES):
                out = _aligned_batch(texts[low:high], a, b, lengths, written)
                kept = [batch.column(f.name).slice(low, high - low) for f in carried]
                yield pa.RecordBatch.from_arrays([*kept, *out.values()], [*(f.name for f in carried), *out])

    return pins.mapInArrow(run, schema)


def aligned_notes(pins: DataFrame, byte_file: str, piece_file: str, shown: dict[str, Column] | None = None,
                  broadcast_bytes: int = 64 << 20) -> DataFrame:
    """How the tokens of a byte-level vocabulary (A) and of sentence pieces (B) line up in every note.

    ``pins`` has ``id`` (of any type) and ``notes`` of saved pins; the files are
    a byte-level vocabulary and a sentence-piece model. A encodes a space and
    the note, B the note (it puts the space itself), both without special tokens. Offsets
    at which tokens of both end cut the note into groups. Tokens whose bytes
    overlap are linked. Over all notes, an id pair counts the notes that hold it linked.

    Method: lockstep merging, one pointer pair a note and a NumPy step for all
    notes of a batch (``lockstep``); batches have a few MB of text. Long notes
    are entered at several places where both sides are seen to end.

    Returns one row per input row: ``id``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links`` (overlapping occurrences), ``n_best`` (links whose pair counts
    most for its A id, ties included), ``count_sum`` (counts summed over links) and
    ``groups``, the ids as ``a1,a2|b1;a3|b2``. ``shown`` gives columns made of ``groups`` to return in its place: groups
    are a few times as long as notes. Null and empty notes, and notes whose tokens don't
    spell them (a piece mark within the text), have no tokens: zeros and an
    empty ``groups``. Repeated rows are separate notes and each counts. Extra
    columns are not carried; an empty table gives no rows. Pair counts are
    broadcast if their counted rows fit ``broadcast_bytes``, else joined by shuffle.
    """
    columns = shown or {"groups": F.col("groups")}
    found = note_links(pins.select("id", F.col("notes").cast("string").alias("notes")), byte_file, piece_file)
    found = stored(found.select("id", "n_a", "n_b", "n_groups", "n_links", "links", *[c.alias(n) for n, c in columns.items()])
                   .withColumn("_row", F.monotonically_increasing_id()), "note-links")
    held = found.select(F.explode("links").alias("link")).groupBy("link.a", "link.b").agg(F.count("*").alias("_count"))
    held = stored(held, "pair-counts")
    most = held.groupBy("a").agg(F.max("_count").alias("_most"))
    held = held.join(most, "a").select("a", "b", "_count", (F.col("_count") == F.col("_most")).alias("_best"))
    held = F.broadcast(held) if held.count() * 48 <= broadcast_bytes else stored(held, "pair-best")
    each = found.select("_row", F.explode("links").alias("link")).select("_row", "link.a", "link.b", "link.n")
    sums = each.join(held, ["a", "b"]).groupBy("_row").agg(
        F.sum(F.when(F.col("_best"), F.col("n").cast("long")).otherwise(F.lit(0))).alias("n_best"),
        F.sum(F.col("n") * F.col("_count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.join(sums, "_row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), *columns)
