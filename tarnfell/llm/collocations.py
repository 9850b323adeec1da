"""Phrases of localised strings whose words stand together more often than by chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.llm.common import stored

#: Bytes that end a piece, and those that end a word within one.
_STOPS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
#: Text bytes cut into words together; a longer string is a batch of its own.
_BATCH_BYTES = 2 << 20
#: Bits of a filter of hashes, 8 MB whatever the input.
FILTER_BITS = 1 << 26
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _STEP


def _chained(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """A hash of a word and the next, from their codes."""
    return _mixed(_mixed(codes) + following)


class Words:
    """Words of a batch of texts in order: ``codes``, the ``note`` and the ``piece`` of each, byte ``starts`` and ``ends``."""

    def __init__(self, texts: list[str | None], seed: int):
        data = [(t or "").encode() for t in texts]
        joined = b"\n".join(data) + b"\n" + bytes(8)
        self.buffer = np.frombuffer(joined, np.uint8)
        upper = (self.buffer >= 65) & (self.buffer <= 90)
        self.buffer = self.buffer + 32 * upper.astype(np.uint8)
        kind = np.zeros(256, np.uint8)
        kind[list(_BLANKS)], kind[list(_STOPS)] = 1, 2
        kinds = kind[self.buffer[:-8]]
        edges = np.diff((kinds == 0).astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.piece = np.cumsum(kinds == 2)[self.starts]
        ends = np.cumsum([len(d) + 1 for d in data])
        self.note = np.searchsorted(ends, self.starts, side="right")
        self.codes = self._hashed(seed)

    def _hashed(self, seed: int) -> np.ndarray:
        """A 64-bit code of each word's bytes, eight bytes of all words at a time; long words one by one."""
        sizes = self.ends - self.starts
        eights = np.ndarray(len(self.buffer) - 7, "<u8", self.buffer, strides=(1,))
        codes = _mixed(sizes.astype(np.uint64) + np.uint64(seed) * _STEP)
        active, at = np.flatnonzero(sizes <= 64), 0
        while len(active):
            left = np.minimum(sizes[active] - at, 8).astype(np.uint64)
            taken = eights[self.starts[active] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
            codes[active] = _mixed(codes[active] ^ taken)
            at += 8
            active = active[sizes[active] > at]
        for i in np.flatnonzero(sizes > 64):
            codes[i] = xxhash.xxh64_intdigest(self.buffer[self.starts[i]:self.ends[i]].tobytes(), seed=seed)
        return codes

    def text(self, i: int) -> str:
        return self.buffer[self.starts[i]:self.ends[i]].tobytes().decode()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str | None]]]:
    """Locales and texts, a few MB at a time."""
    for batch in batches:
        locales, texts = batch.column("locale").to_pylist(), batch.column("value").to_pylist()
        low = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= _BATCH_BYTES or i + 1 == len(texts):
                yield locales[low:i + 1], texts[low:i + 1]
                low, size = i + 1, 0


def _numbered(locales: list[str]) -> tuple[np.ndarray, list[str]]:
    names = sorted(set(locales))
    number = {n: i for i, n in enumerate(names)}
    return np.array([number[x] for x in locales], np.int64), names


def _signed(codes: np.ndarray) -> pa.Array:
    return pa.array(codes.view(np.int64))


def _grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First position and count of each different row."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        ranked = c[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def _passes(bits: np.ndarray | None, codes: np.ndarray) -> np.ndarray:
    at = (codes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def code_filter(codes: DataFrame) -> Broadcast:
    """A bit table of fixed size in which the given ``code`` values are set; others may pass, none of these is stopped."""
    at = codes.select(F.col("code").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 64, "<i8")
    set_words = words.toArrow()  # at most FILTER_BITS / 64 rows
    table[set_words["word"].to_numpy()] = set_words["bits"].to_numpy()
    return codes.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def _word_rows(locales: list[str], texts: list[str | None], seed: int) -> pa.RecordBatch:
    """``locale``, ``code``, ``word`` and ``n`` of the different words of a batch."""
    number, names = _numbered(locales)
    words = Words(texts, seed)
    # A second code parts words of one code within the batch; between batches their texts do.
    first, n = _grouped([number[words.note], words.codes, words._hashed(seed + (1 << 20))])
    return pa.RecordBatch.from_arrays([
        pa.array(names, pa.string()).take(pa.array(number[words.note[first]])), _signed(words.codes[first]),
        pa.array([words.text(i) for i in first], pa.string()), pa.array(n)], ["locale", "code", "word", "n"])


def word_counts(strings: DataFrame, seed: int) -> DataFrame:
    """``locale``, ``code``, ``word``, ``n`` of every word; ``clash`` if another word of the locale has its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for locales, texts in _slices(batches):
            yield _word_rows(locales, texts, seed)

    found = strings.mapInArrow(run, "locale string, code bigint, word string, n bigint")
    summed = found.groupBy("locale", "code").agg(F.min("word").alias("word"), F.max("word").alias("_other"), F.sum("n").alias("n"))
    return summed.select("locale", "code", "word", "n", (F.col("word") != F.col("_other")).alias("clash"))


def _windows(words: Words, shortest: int, longest: int, known: np.ndarray, pairs: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Lead columns of windows of ``shortest`` words or more: where they start, the codes of their words, and which of them are padding.

    A window ends with its piece, before a word that isn't ``known``, or between two that no frequent pair joins.
    """
    joined = np.zeros(len(words.codes) + longest, bool)
    inside = joined[:max(0, len(words.codes) - 1)]
    inside[:] = (words.piece[1:] == words.piece[:-1]) & (words.note[1:] == words.note[:-1]) & known[1:] & known[:-1]
    if pairs is not None:
        inside &= _passes(pairs, _chained(words.codes[:-1], words.codes[1:]))
    wide = np.logical_and.reduce([joined[k:len(words.codes) + k] for k in range(shortest - 1)])
    at = np.flatnonzero(wide)
    columns, padded, open_ = [words.codes[at]], [np.zeros(len(at), bool)], np.ones(len(at), bool)
    for step in range(1, longest):
        open_ = open_ & joined[at + step - 1]
        columns.append(words.codes[np.minimum(at + step, len(words.codes) - 1)])
        padded.append(~open_)
    return at, columns, padded


def lead_windows(strings: DataFrame, seed: int, shortest: int, longest: int, words: Broadcast, pairs: Broadcast | None) -> DataFrame:
    """``locale`` and ``w1`` ..: the longest window at every word, padded with null where it ends early."""
    names_of = [f"w{i + 1}" for i in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for locales, texts in _slices(batches):
            number, names = _numbered(locales)
            found = Words(texts, seed)
            at, columns, padded = _windows(found, shortest, longest, _passes(words.value, found.codes), pairs.value if pairs else None)
            yield pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()).take(pa.array(number[found.note[at]])),
                *[pa.array(c.view(np.int64), mask=p) for c, p in zip(columns, padded)]], ["locale", *names_of])

    return strings.mapInArrow(run, f"locale string, {', '.join(f'{w} bigint' for w in names_of)}")


def _pair_codes(pairs: DataFrame) -> DataFrame:
    """``code`` of each pair, as windows look it up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([_signed(_chained(first, second))], ["code"])

    return pairs.select(F.col("words")[0].alias("w1"), F.col("words")[1].alias("w2")).mapInArrow(run, "code bigint")


def prefix_sums(windows: DataFrame, shortest: int, longest: int, least: int) -> DataFrame:
    """``locale``, ``words`` (codes) and ``f`` of every phrase of ``shortest`` words or more that occurs ``least`` times.

    ROLLUP over the columns of the longest windows counts them by successively
    shorter prefixes: each occurrence of a phrase is the prefix of one window.
    """
    names = [f"w{i + 1}" for i in range(longest)]
    head, rest = names[:shortest], names[shortest:]
    rolled = windows.rollup(F.struct("locale", *head).alias("_head"), *rest).agg(F.count("*").alias("f"), F.grouping_id().alias("_level"))
    # A level with j columns summed away has the grouping id 2 ** j - 1.
    kept = F.col("_level") == (1 << len(rest)) - 1
    for size, name in enumerate(rest, 1):
        kept = kept | ((F.col("_level") == (1 << (len(rest) - size)) - 1) & F.col(name).isNotNull())
    words = F.filter(F.array(*[F.col(f"_head.{w}") for w in head], *rest), lambda w: w.isNotNull())
    return rolled.filter(kept & (F.col("f") >= least)).select(F.col("_head.locale").alias("locale"), words.alias("words"), "f")


def _scores(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase: ``a``, ``l``, ``r``, ``n``, ``score``."""
    size = F.size("words")
    cuts = phrases.select("locale", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("_k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("_k")).alias("_first"),
                       F.slice("words", F.col("_k") + 1, size - F.col("_k")).alias("_rest"))
    left = counts.select("locale", F.col("words").alias("_first"), F.col("f").alias("l"))
    right = counts.select("locale", F.col("words").alias("_rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["locale", "_first"]).join(right, ["locale", "_rest"]).join(F.broadcast(totals), "locale")

    def wide(*factors: Column) -> Column:
        product = factors[0].cast("decimal(38,0)")
        for x in factors[1:]:
            product = (product * x.cast("decimal(38,0)")).cast("decimal(38,0)")
        return product

    both = both.withColumn("_over", wide(F.lit(1000), F.col("a"), F.col("n"))).withColumn("_under", wide(F.col("l"), F.col("r")))
    scored = both.withColumn("score", F.expr("_over div _under"))
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "_k")).alias("_best")
    return scored.groupBy("locale", "words", "a").agg(best).select("locale", "words", "a", "_best.*")


def _covered(phrases: DataFrame, share: int) -> DataFrame:
    """``locale``, ``words`` of phrases that stand inside a longer one with ``share`` percent of their occurrences."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("words", i, n))))
    longer = phrases.filter(size > 2).select("locale", F.col("f").alias("_longer"), F.explode(inner).alias("words"))
    longer = longer.groupBy("locale", "words").agg(F.max("_longer").alias("_longer"))
    return phrases.join(longer, ["locale", "words"]).filter(100 * F.col("_longer") >= share * F.col("f")).select("locale", "words")


def collocations(strings: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """The phrases of each locale whose words attract each other most.

    ``strings`` has ``locale`` and ``value`` of a string catalogue (other
    columns, the ``key`` among them, are not used). A-Z count as lower case;
    values are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into
    words at blanks and tabs. Phrases have 2 to ``longest`` words of one piece and occur
    at least ``least`` times, overlaps included. With ``n`` words in the locale, a phrase of ``a``
    occurrences cut into parts of ``l`` and ``r`` occurrences scores
    floor(1000 a n / (l r)), in exact arithmetic; its lowest-scoring cut counts, the first
    of equals. A phrase goes if a longer one that contains it has at least
    ``share`` percent of its occurrences, whether that one is kept or not.

    Method: top-order marginalisation. Only longest windows are counted, as
    lead columns padded where they end; ROLLUP counts them by shorter prefixes. Run
    once with windows of two, it gives the frequent pairs; then windows of three
    to ``longest`` words end where no frequent word or pair goes on, for no phrase
    that counts is longer. Both kinds of frequent things are looked up in bit tables of 8 MB that
    may let more through but stop none, so results are the same at any size.
    Words are 64-bit codes, checked to differ for different words, else coded anew.

    Returns ``locale``, ``rank`` (from 1), ``phrase`` (joined by spaces), ``a``,
    ``l``, ``r``, ``n``, ``score``: the first ``top`` of each locale by score, then ``a``,
    falling, then phrase in byte order. Null values have no words; a null
    locale is ``und``. Repeated rows count each time. An empty table gives no rows.
    """
    strings = strings.select(F.coalesce(F.col("locale"), F.lit("und")).alias("locale"), "value")
    seed = 0
    words = stored(word_counts(strings, seed), "word-counts")
    while not words.filter("clash").isEmpty():
        seed += 1
        words = stored(word_counts(strings, seed), "word-counts")
    totals = words.groupBy("locale").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= least)
    known = code_filter(frequent.select("code"))
    pairs = phrases = stored(prefix_sums(lead_windows(strings, seed, 2, 2, known, None), 2, 2, least), "pair-counts")
    if longest > 2:
        windows = lead_windows(strings, seed, 3, longest, known, code_filter(_pair_codes(pairs)))
        phrases = pairs.unionByName(stored(prefix_sums(windows, 3, longest, least), "phrase-counts"))
    single = frequent.select("locale", F.array("code").alias("words"), F.col("n").alias("f"))
    scored = _scores(phrases, phrases.unionByName(single), totals)
    kept = stored(scored.join(_covered(phrases, share), ["locale", "words"], "left_anti"), "phrase-scores")
    each = kept.select("locale", "words", F.posexplode("words").alias("_at", "code"))
    spelled = each.join(frequent.select("locale", "code", "word"), ["locale", "code"]).groupBy("locale", "words").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("locale").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelled, ["locale", "words"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("locale", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
