"""Archives of tiles, aligned tokens and collocations against their plain versions and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tarnfell.llm import alignment, collocations, sharding  # noqa: E402
from tarnfell.llm.queries import PLANS, TOKENIZERS, pins  # noqa: E402
from tarnfell.sources.tables import table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
FILES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


# Archives

TILE = "server int, z int, x bigint, y int, data binary"


def tiles_of(spark, images):
    rows = [(0, 1, i, 2, image) for i, image in enumerate(images)]
    return spark.createDataFrame(rows, TILE).withColumn("image", F.lit("clash")).withColumn("archive", F.lit("clash")).repartition(3)


def plain_best_fit(sizes, capacity):
    """Best-fit by looking at every bin."""
    room, placed = [], []
    for size in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        i = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(max(capacity, size))
        room[i] -= size
        placed.append(i)
    return placed


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_that_of_all_bins(seed):
    maker = random.Random(seed)
    sizes = sorted((maker.choice([maker.randrange(1, 30), maker.randrange(1, 130), 50]) for _ in range(400)), reverse=True)
    assert sharding.best_fit(np.array(sizes), 100) == plain_best_fit(sizes, 100)
    assert sharding.best_fit(np.array(sizes), 100, most=3) is None


def test_tree_stays_balanced():
    tree, keys = None, [((i * 7919) % 1009, i) for i in range(1009)]
    for k in keys:
        tree = sharding._with(tree, k)
    for k in keys[::2]:
        tree = sharding._without(tree, k)
    left = sorted(keys[1::2])
    assert tree[3] <= 13
    for size in range(0, 1010, 7):
        assert sharding._tightest(tree, size) == next((k for k in left if k[0] >= size), None)


def check_archives(got, images, overhead=1):
    by = defaultdict(list)
    for r in got:
        by[r.archive].append(r)
    assert len(got) == len(images)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    homes = defaultdict(set)
    for r in got:
        image = images[r.x] or b""
        assert r.bytes == len(image) + overhead and (r.server, r.z, r.y) == (0, 1, 2)
        homes[image].add(r.archive)
    assert all(len(h) == 1 for h in homes.values())
    return {a: sum(r.bytes for r in part) for a, part in by.items()}


def test_archives_of_fixed_capacity(spark):
    maker = random.Random(1)
    images = [bytes(maker.randrange(256) for _ in range(maker.randrange(1, 200))) for _ in range(500)]
    images += [b"sea" * 30] * 300 + [None, b"", b"", b"x" * 5000]
    filled = check_archives(sharding.archives(tiles_of(spark, images), 4_000).collect(), images)
    groups = Counter()
    for image in images:
        groups[image or b""] += len(image or b"") + 1
    oversize = sum(1 for n in groups.values() if n > 4_000)
    assert sum(n > 4_000 for n in filled.values()) == oversize == 2
    rest = sum(n for n in filled.values() if n <= 4_000)
    assert sorted(filled) == list(range(len(filled))) and len(filled) - oversize <= 1.03 * rest / 4_000 + 1


def test_archives_by_regions(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_REGION", 3)
    monkeypatch.setattr(sharding, "_GRAIN", 16)
    maker = random.Random(2)
    images = [maker.randbytes(maker.choice([20, 60, 150, 330])) for _ in range(700)]
    filled = check_archives(sharding.archives(tiles_of(spark, images), 1_000).collect(), images)
    assert max(filled.values()) <= 1_000 and sum(2 * n < 1_000 for n in filled.values()) <= 1


def test_equal_archives(spark, monkeypatch):
    monkeypatch.setattr(sharding, "_PIECES", 512)
    maker = random.Random(4)
    images = [maker.randbytes(maker.randrange(1, 90)) for _ in range(2_000)] + [b"sea" * 9] * 200
    filled = check_archives(sharding.equal_archives(tiles_of(spark, images), 8).collect(), images)
    assert set(filled) <= set(range(8)) and max(filled.values()) - min(filled.values()) < 0.02 * sum(filled.values())


def test_archives_of_awkward_tables(spark):
    empty = spark.createDataFrame([], TILE)
    assert sharding.archives(empty, 10).collect() == [] == sharding.equal_archives(empty, 8).collect()
    keyless = spark.createDataFrame([(None, None, None, None, b"a"), (None, None, None, None, b"a"), (1, 1, 1, 1, None)], TILE)
    got = sharding.equal_archives(keyless, 8).collect()
    assert sorted(r.bytes for r in got) == [1, 2, 2]
    with pytest.raises(ValueError):
        sharding.equal_archives(keyless, 0)


def test_archives_query(spark):
    documents = table(spark, SF_DIR, "documents")
    got = PLANS["op11_archives"](spark, SF_DIR)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.join(documents.select("doc_id", "text"), "doc_id").collect()
    import zlib

    total, homes = Counter(), defaultdict(set)
    for r in rows:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
        total[r.shard] += r.size
        homes[data].add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and set(total) == set(range(8))
    assert max(total.values()) < 1.02 * sum(total.values()) / 8
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s in total for i in range(sum(r.shard == s for r in rows)))


# Aligned tokens


def plain_alignment(notes):
    """Two tokenizers of other make, and every pair of tokens looked at in a plain merge."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(FILES[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = alignment._byte_letters()

    def piece_of(i):
        return bytes([int(two.id_to_piece(i)[1:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()

    out, pairs, counts = [], [], Counter()
    for note in notes:
        a = one.encode(" " + note, add_special_tokens=False).ids if note else []
        b = two.encode(note) if note else []
        parts_a, parts_b = [bytes(letters[c] for c in one.id_to_token(i)) for i in a], [piece_of(i) for i in b]
        if note and not b"".join(parts_a) == b"".join(parts_b) == (" " + note).encode():
            a, b, parts_a, parts_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
        links, groups = [], []
        i = j = first_i = first_j = 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[first_i:i])) + "|" + ",".join(map(str, b[first_j:j])))
                first_i, first_j = i, j
        assert len(links) == sum(max(lo_a, lo_b) < min(hi_a, hi_b) for lo_a, hi_a in zip([0] + ends_a, ends_a)
                                 for lo_b, hi_b in zip([0] + ends_b, ends_b)) or len(a) > 500
        counts.update(set(links))
        pairs.append(links)
        out.append([len(a), len(b), len(groups), len(links), ";".join(groups)])
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(*o[:4], sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), o[4]) for o, links in zip(out, pairs)]


ODD = ["a▁b", " " * 3_000 + "x", "x" * 4_000, "<|endoftext|> and </s> <unk>", "\x00 é\n\n  b　", None, "", " ", "same text", "same text", "\U0001F600\U0001F468‍\U0001F469", "don't we'll",
       " ".join(f"word{i % 89}" for i in range(4_000)), "Ünïcode ÅÄÖ çà 你好"]


def test_alignment_of_odd_notes(spark, monkeypatch):
    monkeypatch.setattr(alignment, "_STRIDE", 64)
    df = spark.createDataFrame([(f"id-{i}" if i else None, n, "x") for i, n in enumerate(ODD)], "id string, notes string, n_a string").repartition(2)
    got = alignment.aligned_notes(df, *FILES)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = {(f"id-{i}" if i else None): w for i, w in enumerate(plain_alignment(ODD))}
    assert {r.id: tuple(r)[1:] for r in got.collect()} == want
    assert want[None] == (0, 0, 0, 0, 0, 0, "")
    shuffled = alignment.aligned_notes(df, *FILES, broadcast_bytes=0)
    assert {r.id: tuple(r)[1:] for r in shuffled.collect()} == want
    assert alignment.aligned_notes(df.limit(0), *FILES).collect() == []


def test_lockstep_enters_long_notes_anywhere():
    maker = random.Random(9)

    def tokens(total):
        cuts = sorted(maker.sample(range(1, total), total // 3))
        return np.diff([0, *cuts, total])

    totals = [maker.randrange(4, 900) for _ in range(30)]
    sides = []
    for _ in range(2):
        lengths = [tokens(n) for n in totals]
        flat = np.concatenate(lengths)
        sides.append(alignment.Tokens(np.zeros(len(flat), np.int64), np.cumsum(flat), np.concatenate([[0], np.cumsum([len(x) for x in lengths])])))
    plain = alignment.lockstep(*sides, stride=10 ** 9)
    for stride in (1, 3, 50):
        got = alignment.lockstep(*sides, stride=stride)
        assert sorted(zip(*map(np.ndarray.tolist, got))) == sorted(zip(*map(np.ndarray.tolist, plain)))


def test_alignment_query(spark):
    given = [tuple(r) for r in pins(table(spark, SF_DIR, "documents")).collect()]
    want = {i: w for (i, _), w in zip(given, plain_alignment([n for _, n in given]))}
    got = {r.doc_id: r for r in PLANS["op12_token_alignment"](spark, SF_DIR).collect()}
    for i, w in want.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


# Collocations


def plain_collocations(strings, least, longest=5, top=2000, share=100):
    """Every phrase of every size, counted one by one."""
    counts, totals = Counter(), Counter()
    for locale, value in strings:
        locale = "und" if locale is None else locale
        totals[locale] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (value or "").translate(brute.UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[locale] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[locale, tuple(words[i:i + k])] += 1
    known = {p: f for p, f in counts.items() if f >= least and len(p[1]) > 1}
    out = defaultdict(list)
    for (locale, words), a in known.items():
        if any(words == q[i:i + len(words)] and 100 * f >= share * a for (other, q), f in known.items() if other == locale and len(q) > len(words)
               for i in range(len(q) - len(words) + 1)):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[locale, words[:k]], counts[locale, words[k:]]
            cuts.append((1000 * a * totals[locale] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[locale].append((-score, -a, " ".join(words).encode(), left, right))
    result = set()
    for locale, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.add((locale, rank, phrase.decode(), -a, left, right, totals[locale], -score))
    return result


def made_strings():
    maker = random.Random(6)
    words = ["the", "trail", "To", "hut", "é", "snow-bridge", "\x00", "a" * 90, "a" * 89 + "b", "north", "x1"]
    rows = []
    for _ in range(700):
        text = "".join(maker.choice(words) + maker.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]) for _ in range(maker.randrange(25)))
        rows.append((maker.choice(["sv", "nb", None, "und"]), text + maker.choice(["", "the old hut on the ridge", "ha ha ha ha ha ha ha"])))
    return [*rows, ("sv", None), ("sv", ""), ("se", " .\t"), (None, "; ")]


@pytest.mark.parametrize("least, longest, share, top", [(20, 5, 100, 2000), (5, 5, 60, 15), (3, 3, 100, 2000), (30, 2, 100, 2000)])
def test_collocations(spark, monkeypatch, least, longest, share, top):
    monkeypatch.setattr(collocations, "_BATCH_BYTES", 500)
    strings = made_strings()
    df = spark.createDataFrame([(f"k{i}", *s, 1) for i, s in enumerate(strings)], "key string, locale string, value string, n int").repartition(3)
    got = collocations.collocations(df, least, longest, top, share)
    assert {tuple(r) for r in got.collect()} == plain_collocations(strings, least, longest, top, share)
    assert got.dtypes == [("locale", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]


def test_collocations_of_awkward_tables(spark):
    schema = "key string, locale string, value string"
    for rows in ([], [("k", None, None)], [("k", "sv", "")], [("k", "sv", "one")]):
        assert collocations.collocations(spark.createDataFrame(rows, schema), 1).collect() == []
    text = "up the long ridge and " * 20_000
    got = collocations.collocations(spark.createDataFrame([("k", "en", text)], schema), 100).collect()
    assert {tuple(r) for r in got} == plain_collocations([("en", text)], 100)


def test_words_that_share_a_code(monkeypatch):
    hashed = collocations.Words._hashed
    monkeypatch.setattr(collocations.Words, "_hashed", lambda self, seed: hashed(self, seed) if seed else np.zeros(len(self.starts), np.uint64))
    got = collocations._word_rows(["sv", "sv"], ["one two one", None], 0)
    assert sorted(zip(got.column("word").to_pylist(), got.column("n").to_pylist())) == [("one", 2), ("two", 1)]
    assert set(got.column("code").to_pylist()) == {0}
    assert len(set(collocations._word_rows(["sv"], ["one two one"], 1).column("code").to_pylist())) == 2


def test_scores_beyond_64_bits(spark):
    big = 10 ** 12
    phrases = spark.createDataFrame([("sv", [1, 2], big)], "locale string, words array<bigint>, f bigint")
    counts = phrases.unionByName(spark.createDataFrame([("sv", [1], 3 * big), ("sv", [2], 7 * big)], phrases.schema))
    totals = spark.createDataFrame([("sv", 10 ** 15)], "locale string, n bigint")
    r = collocations._scores(phrases, counts, totals).first()
    assert (r.a, r.l, r.r, r.score) == (big, 3 * big, 7 * big, 1000 * big * 10 ** 15 // (21 * big * big))
