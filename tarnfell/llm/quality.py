"""Quality of free-text notes by boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.boosting import Forest, train
from tarnfell.llm.common import BLANKS, split_words, stored, text_of

#: Kinds of bytes whose shares are statistics.
_KINDS = ("upper", "lower", "digit", "blank", "line", "stop", "mark", "symbol", "other")
STATISTICS = ("n_bytes", "n_words", "word_length", "distinct_words", "distinct_lines", "line_words",
              *(f"share_{k}" for k in _KINDS), "marks_per_word", "symbols_per_word", "repeats", "doubled")


def _kind_table() -> np.ndarray:
    table = np.full(256, _KINDS.index("other"), np.uint8)
    for kind, characters in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"),
                             ("digit", "0123456789"), ("blank", " \t\r\f\v"), ("line", "\n"), ("stop", ".,;:'\"()-"),
                             ("mark", "!?"), ("symbol", "#$%&*+/<=>@[\\]^_`{|}~")):
        table[np.frombuffer(characters.encode(), np.uint8)] = _KINDS.index(kind)
    return table


_TABLE = _kind_table()
#: Bytes classified at once.
_CHUNK = 1 << 22


def _byte_shares(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text, and counts by kind (last column: bytes equal to the one before)."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    counts = np.zeros((len(texts), len(_KINDS) + 1), np.int64)
    row = 0
    while row < len(texts):
        # As many whole texts as fit a chunk, at least one.
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK, side="right")) - 1)
        part = data[bounds[row]:bounds[end]]
        owner = np.repeat(np.arange(end - row), np.diff(bounds[row:end + 1]))
        width = len(_KINDS)
        counts[row:end, :width] = np.bincount(owner * width + _TABLE[part], minlength=(end - row) * width).reshape(-1, width)
        if len(part) > 1:
            same = (part[1:] == part[:-1]) & (owner[1:] == owner[:-1])
            counts[row:end, width] = np.bincount(owner[1:][same], minlength=end - row)
        row = end
    return np.diff(bounds), counts


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, kinds = _byte_shares(batch.column("_notes"))
        words, distinct, lines, lines_distinct, same = (
            batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            for c in ("_words", "_distinct", "_lines", "_lines_distinct", "_same"))
        some, per = np.maximum(n_bytes, 1), np.maximum(words, 1)
        k = {name: kinds[:, i] for i, name in enumerate(_KINDS)}
        columns = [n_bytes, words, (n_bytes - k["blank"] - k["line"]) / per, distinct / per, lines_distinct / np.maximum(lines, 1),
                   words / np.maximum(lines, 1), *(k[name] / some for name in _KINDS), k["mark"] / per, k["symbol"] / per,
                   same / per, kinds[:, -1] / some]
        table = np.stack([np.asarray(c, float) for c in columns], axis=1).astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _carried(batch)),
             pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), table.shape[1]).cast(pa.list_(pa.float32()))],
            names=[*_carried(batch), "statistics"])


def _carried(batch: pa.RecordBatch) -> list[str]:
    """``id``, and the row number if there is one."""
    return [c for c in ("id", "_row") if c in batch.schema.names]


def _carried_schema(df: DataFrame, keep: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("id", *keep))


def statistics(pins: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``id``, ``statistics`` (one float per name in ``STATISTICS``) of each pin's whole ``notes``, and ``keep`` (at most ``_row``)."""
    notes, words, lines = F.col("_notes"), F.col("_split"), F.split("_notes", "\n")
    parts = pins.select("id", *keep, text_of("notes").alias("_notes")).withColumn("_split", split_words(notes, BLANKS))
    same = F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
                                      lambda a, b: a == b), lambda x: x))
    counted = parts.select("id", *keep, "_notes", F.size(words).alias("_words"), F.size(F.array_distinct(words)).alias("_distinct"),
                           F.size(lines).alias("_lines"), F.size(F.array_distinct(lines)).alias("_lines_distinct"),
                           same.alias("_same"))
    return counted.mapInArrow(_measure, f"{_carried_schema(counted, keep)}, statistics array<float>")


def fit(measured: DataFrame, ratings: DataFrame, rows: int = 20_000) -> Forest:
    """Train on at most ``rows`` rated pins, those whose ids hash lowest; unrated or null ratings are left out."""
    rated = ratings.filter(F.col("good").isNotNull() & F.col("id").isNotNull()).select("id", F.col("good").cast("int").alias("_good"))
    picked = rated.orderBy(F.xxhash64("id"), "id", "_good").limit(rows)
    sample = picked.join(measured, "id").orderBy(F.xxhash64("id"), "id", "_good", "statistics").limit(rows).toPandas()
    table = np.stack(sample["statistics"].to_list()).astype(np.float32) if len(sample) else np.zeros((0, len(STATISTICS)), np.float32)
    return train(table.astype(float), sample["_good"].to_numpy(float))


def note_quality(pins: DataFrame, ratings: DataFrame, rows: int = 20_000, keep: Sequence[str] = ()) -> DataFrame:
    """Score the quality of each pin's ``notes``.

    ``pins`` has ``id`` and ``notes`` of saved pins; ``ratings`` has ``id`` and
    ``good`` (1 or 0) for some of them, of which at most ``rows`` are used for
    training (the bound keeps the driver's table small; statistics and scores
    cover every row). Only the text is measured.

    Method: histogram gradient boosting over text statistics; the trees are
    flattened into arrays and walked for whole batches at once.

    Returns one row per input row: ``id``, ``score`` (0 to 1, higher is better)
    and ``predicted`` (1 from 0.5 on). Null notes are empty notes and get a
    score too. Without usable ratings every score is 0.5. Repeated ids stay
    repeated; extra columns are not carried, but for ``_row`` if ``keep`` names
    it; an empty table gives no rows.
    """
    measured = stored(statistics(pins, keep), "statistics")
    forest = fit(measured, ratings, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            scores = forest.scores(table.astype(float))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _carried(batch)), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=[*_carried(batch), "score", "predicted"])

    return measured.mapInArrow(score, f"{_carried_schema(measured, keep)}, score double, predicted int")
