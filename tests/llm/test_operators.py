"""Every text operator against its plain version, on a given table and on awkward rows."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from tarnfell.llm import decontamination, fingerprints, licences, lines, mixing, pages, personal, quality, repeats, simhash  # noqa: E402
from tarnfell.llm.queries import PLANS, pins  # noqa: E402
from tarnfell.sources.tables import table  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu."), (2, None), (3, ""), (4, "   \t\n \n"),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu."), (6, LONG), (7, LONG + " end"), (8, "One"),
    (9, "Ünïcode ÅÄÖ çà 你好 \U0001F600 text\nÜnïcode ÅÄÖ çà 你好 \U0001F600 text"), (None, "a note without an id, long enough"),
    (11, "é" * 300), (12, "ab" * 400), (13, "same line here ok\nsame line here ok\nSAME LINE HERE OK"), (14, "\x0b x \x0c y\r\nz "),
]
SCHEMA = "id bigint, notes string, _row string, _words int, text string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return pins(table(spark, SF_DIR, "documents"))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, long and repeated notes, and extra columns with the names that operators use inside."""
    return spark.createDataFrame([(i, n, "x", 1, "y", "z") for i, n in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return [tuple(r) for r in df.select("id", "notes").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(got, want):
    assert sorted(want, key=repr) == got


# Fingerprints


def test_fingerprints_add_up(spark, awkward):
    got = fingerprints.note_fingerprints(awkward.filter("id is not null"))
    want = [(i, *brute.fingerprint(n), brute.written(*brute.fingerprint(n))) for i, n in AWKWARD if i is not None]
    assert {r.id: (list(r.lanes), list(r.checks), r.fingerprint) for r in got.collect()} == {i: (a, b, c) for i, a, b, c in want}


def test_paragraphs_go_in_and_out(spark):
    parts = ["first paragraph of words", "second one", "third, longer paragraph of some words"]
    df = spark.createDataFrame([(1, "\n".join(parts)), (2, "\n".join(reversed(parts))), (3, "\n".join(parts[:2])), (4, parts[2])], "id bigint, notes string")
    f = {r.id: r for r in fingerprints.note_fingerprints(df).collect()}
    assert f[1].fingerprint == f[2].fingerprint != f[3].fingerprint
    pair = fingerprints.note_fingerprints(df).alias("x").crossJoin(fingerprints.note_fingerprints(df).alias("y")).filter("x.id = 3 and y.id = 4")
    r = pair.select(fingerprints.added(F.col("x.lanes"), F.col("y.lanes")).alias("l"), fingerprints.checks_added(F.col("x.checks"), F.col("y.checks")).alias("c")).first()
    assert (list(r.l), list(r.c)) == (list(f[1].lanes), list(f[1].checks))


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_edited_fingerprints(which, request):
    df = request.getfixturevalue(which)
    pairs, notes = listed(df), dict(listed(df))
    prints = {p: brute.fingerprint(n) for p, n in pairs}
    got = {r.id: r for r in fingerprints.edited_fingerprints(df).collect()}
    assert len(got) == len(pairs)
    for pin, text, following in brute.edited(pairs):
        r, e = got[pin], brute.fingerprint(text)
        assert (r.n_chars, r.edited_sha256) == (len(notes[pin] or ""), brute.sha(text))
        assert (r.fingerprint, r.edited_fingerprint) == (brute.written(*prints[pin]), brute.written(*e))
        assert r.near_edited == pytest.approx(brute.likeness(prints[pin], e)) and 0 <= r.near_next <= 1
        assert r.near_next == pytest.approx(brute.likeness(prints[pin], brute.fingerprint(following)))


def test_likeness_tells_edits_from_others(docs):
    got = fingerprints.edited_fingerprints(docs).filter("n_chars > 400").toPandas()
    assert (got.near_edited > 0.25).mean() > 0.95 and (got.near_next < 0.35).mean() > 0.9


def test_likeness_of_repeated_passages(spark):
    maker = random.Random(3)
    passage = " ".join("".join(maker.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    df = spark.createDataFrame([(1, "\n".join([passage] * 10_000)), (2, "\n".join([passage] * 5_000))], "id bigint, notes string")
    prints = fingerprints.note_fingerprints(df)
    both = prints.alias("x").join(prints.alias("y"), F.expr("x.id = 1 and y.id = 2"))
    near = both.select(fingerprints.likeness(F.col("x.lanes"), F.col("x.checks"), F.col("y.lanes"), F.col("y.checks")).alias("n"),
                       fingerprints.likeness(fingerprints.added(F.col("y.lanes"), F.col("y.lanes")), F.col("x.checks"), F.col("x.lanes"), F.col("x.checks")).alias("twice")).first()
    assert near.n == pytest.approx(1) and near.twice == 1


# Mixing


def check_mix(df, got):
    sizes, by = {}, {r.key: r for r in got}
    given = [tuple(r) for r in df.select("key", "locale", "value").collect()]
    for _, locale, value in given:
        sizes[locale] = sizes.get(locale, 0) + len(brute.blank_words(value))
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for key, locale, value in given:
        n = len(brute.blank_words(value))
        assert (by[key].size, by[key].locale_size) == (n, sizes[locale]) and by[key].target == pytest.approx(want[locale])
        assert 0 <= by[key].taken <= 2 * n
        taken[locale] += by[key].taken
    for locale in sizes:
        assert abs(taken[locale] - want[locale]) <= 32 + 0.01 * want[locale]
    assert len(given) == len(got)


def test_mix_meets_targets(spark):
    strings = table(spark, SF_DIR, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("locale"), F.col("text").alias("value"))
    got = mixing.mixed(strings).collect()
    check_mix(strings, got)
    assert rows(mixing.mixed(strings)) == sorted((tuple(r) for r in got), key=repr)


def test_mix_of_awkward_rows(spark, nothing):
    data = [(i, [None, "sv", "nb", "é"][i % 4], n) for i, (_, n) in enumerate(AWKWARD * 3)]
    strings = spark.createDataFrame(data, "key bigint, locale string, value string").withColumn("target", F.lit("clash"))
    check_mix(strings, mixing.mixed(strings).collect())
    empty = nothing.select(F.col("id").alias("key"), F.col("text").alias("locale"), F.col("notes").alias("value"))
    assert mixing.mixed(empty).collect() == []
    wordless = spark.createDataFrame([(1, "sv", None), (2, None, " ")], "key bigint, locale string, value string")
    assert [r.taken for r in mixing.mixed(wordless).collect()] == [0, 0]


@pytest.mark.parametrize("count", [1, 2, 3, 10, 97])
def test_permutation_is_one_to_one(spark, count):
    df = spark.range(count).select(mixing._permuted(F.col("id"), F.lit(count).cast("long"), F.lit(5)).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(count))


# Personal data


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_base_spans(which, request):
    df = request.getfixturevalue(which)
    got = {(r.id): [tuple(s) for s in r.spans if s.kind in personal.BASE] for r in personal.personal_data(df).collect()}
    assert got == {i: brute.base_spans(n) for i, n in listed(df)}


def test_spans_of_made_up_notes(spark):
    maker = random.Random(5)
    alphabet = ["a", "b.c", "@", ".", "-", " ", "+", "4", "12", "255", "256", "4111111111111111", "(", ")", "x@y.zz", "_", "é", "\n", "1.2.3.4", "+47 123 45 678", "%"]
    data = [(i, "".join(maker.choice(alphabet) for _ in range(maker.randrange(40)))) for i in range(1500)]
    df = spark.createDataFrame([*data, (9_000, "7" * 50_000), (9_001, "a" * 60_000 + "@b.c"), (9_002, "1." * 20_000), (9_003, "+1" * 20_000)], "id bigint, notes string")
    got = {r.id: [tuple(s) for s in r.spans if s.kind in personal.BASE] for r in personal.personal_data(df).collect()}
    assert got == {i: brute.base_spans(n) for i, n in listed(df) if i != 9_001} | {9_001: [("email", 0, 60_004)]}


def test_context_and_checksums(spark):
    df = spark.createDataFrame([(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "GB83 WEST 1234 5698 7654 32"), (3, "personnummer 811228-9874"),
                                (4, "number 811228-9874"), (5, "personnummer 811228-9875")], "id bigint, notes string")
    got = {r.id: [s.kind for s in r.spans if s.kind not in personal.BASE] for r in personal.personal_data(df).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["personal_number"], 4: [], 5: []}


def test_ibans_end_where_they_end(spark):
    numbers = {"NO9386011117947": ["", " Bank", " 2024", ". Next"], "NO93 8601 1117 947": [" BIC DNBANOKK", " 12 kr"],
               "GB82 WEST 1234 5698 7654 32": [" Please", " 5 days", " BIC"], "DE89370400440532013000": [" BIC COBADEFF", " DE89370400440532013000", "\n2024"],
               "MT84MALT011000012345MTLCAST001S": [" A", " 7"], "LC55HEMM000100010012001200023015": [" Call 112"]}
    data, want = [], {}
    for number, ends in numbers.items():
        for end in ends:
            text = f"IBAN {number}{end}"
            want[len(data)] = [(5, 5 + len(number))] + ([(text.rindex("DE"), len(text))] if end.startswith(" DE") else [])
            data.append((len(data), text))
    for text in ("IBAN NO9386011117948 Bank", "IBAN NO93860111179470", "IBAN NO938601111794 7X"):  # wrong sum, too long, no end
        want[len(data)] = []
        data.append((len(data), text))
    df = spark.createDataFrame(data, "id bigint, notes string")
    assert {r.id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in personal.personal_data(df).collect()} == want


def test_personal_data_query(spark):
    given = dict(listed(pins(table(spark, SF_DIR, "documents"))))
    for r in PLANS["op3_personal_data"](spark, SF_DIR).collect():
        spans = brute.base_spans(given[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = brute.counted(spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in brute.BASE)
        assert r.base_sha256 == brute.sha(text) and r.spans.startswith(text)


# Repeated passages


def brute_repeats(given, length):
    texts = [(i, (n or "").encode()) for i, n in given]
    seen = {}
    for _, t in texts:
        for at in range(len(t) - length + 1):
            seen[t[at:at + length]] = seen.get(t[at:at + length], 0) + 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for at in range(len(t) - length + 1):
            if seen[t[at:at + length]] > 1:
                gone[at:at + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_repeated_bytes(which, request):
    df = request.getfixturevalue(which)
    got = repeats.without_repeats(df).withColumn("kept", F.sha2("kept", 256))
    same(rows(got), brute_repeats(listed(df), 200))


def test_repeats_across_shards(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CAP", 3)
    monkeypatch.setattr(repeats, "_SHARD", 2_000)
    maker = random.Random(3)
    piece = lambda n: "".join(maker.choice("abcdefgh ") for _ in range(n))
    shared, other = piece(260), piece(230)
    data = [(i, piece(maker.randrange(50)) + (shared if i % 2 else other) + piece(maker.randrange(150))) for i in range(60)]
    data += [(100, shared[:210] + "z" + shared[5:]), (101, "q" * 900), (102, piece(5_000))]
    df = spark.createDataFrame(data, "id bigint, notes string").repartition(4)
    same(rows(repeats.without_repeats(df).withColumn("kept", F.sha2("kept", 256))), brute_repeats(data, 200))


# Lines


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_lines(which, request):
    df = request.getfixturevalue(which).filter("id is not null")
    got, want = rows(lines.deduplicated_lines(df)), sorted(brute.deduplicated_lines(listed(df)), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    # No line goes that all pairs would keep, but for a group that falls apart; nearly all go that should.
    assert sum(g[2] for g in got) <= sum(w[2] for w in want) <= sum(g[2] for g in got) + max(2, 0.02 * sum(w[2] for w in want))
    same_rows = sum(g == w for g, w in zip(got, want))
    assert same_rows >= 0.98 * len(want)


def test_lines_with_equal_text_go(spark):
    data = [(2, "One\ntwo\n\nONE "), (1, "two"), (None, "two\nthree"), (3, None), (4, ""), (4, "three")]
    got = lines.deduplicated_lines(spark.createDataFrame(data, "id bigint, notes string"))
    assert rows(got) == sorted([(2, 3, 2, "One\n"), (1, 1, 1, ""), (None, 2, 0, "two\nthree"), (3, 0, 0, None), (4, 0, 0, ""), (4, 1, 1, "")], key=repr)


def made_lines(maker, words):
    """A line and what becomes of it with a few words changed, left out or added, at an edit similarity of 0.8 or more."""
    word = lambda: "".join(maker.choice("abcdefghijklmnop") for _ in range(maker.randrange(2, 9)))
    while True:
        base = [word() for _ in range(words)]
        edited = list(base)
        for _ in range(maker.randrange(1, 2 + words // 12)):
            at = maker.randrange(len(edited))
            edited[at:at + 1] = maker.choice([[word()], [], [edited[at], word()], [edited[at] + "s"]])
        a, b = " ".join(base), " ".join(edited)
        most = int(max(len(a), len(b)) * 0.2 + 1e-9)
        if a != b and brute.levenshtein(a, b, most) <= most:
            return a, b


@pytest.mark.parametrize("words, least", [(2, 0.85), (4, 0.9), (8, 0.9), (15, 0.9), (28, 0.9), (60, 0.95), (200, 0.97)])
def test_share_of_near_lines_found(spark, words, least):
    maker = random.Random(words)
    pairs = [made_lines(maker, words) for _ in range(200)]
    data = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    got = lines.deduplicated_lines(spark.createDataFrame(data, "id bigint, notes string").repartition(3)).collect()
    assert sum(r.n_removed for r in got) >= least * len(pairs)


def beginning(maker, head, n, letters="abcdefghijklmnop"):
    return head + "".join(maker.choice(letters) for _ in range(n))


def test_near_lines_meet_behind_the_first_of_a_block(spark):
    """Two near lines of each family share only their beginning, which forty others have too."""
    maker, data = random.Random(21), []
    for family in range(5):
        head = beginning(maker, "", 8)
        near = beginning(maker, head, 11)
        data.append((2 * family, "\n".join([beginning(maker, head, 12) for _ in range(20)] + [near + "x"])))
        data.append((2 * family + 1, "\n".join([near + "y"] + [beginning(maker, head, 12) for _ in range(20)])))
    want = brute.deduplicated_lines(data)
    assert [w[2] for w in want] == [0, 1] * 5
    same(rows(lines.deduplicated_lines(spark.createDataFrame(data, "id bigint, notes string").repartition(3))), want)


@pytest.mark.parametrize("side", [2, 256])
def test_all_lines_of_a_block_meet(spark, monkeypatch, side):
    """Chains of near lines in one block: every group of all pairs is found, with few or many lines to a part."""
    monkeypatch.setattr(lines, "_SIDE", side)
    maker, made = random.Random(3), []
    for group in range(12):
        line = beginning(maker, "samehead", 12)
        for _ in range(30 if group == 0 else 4):
            made.append(line)
            cut = maker.randrange(8, 20)
            line = line[:cut] + maker.choice("qrstuv") + line[cut + 1:]
    maker.shuffle(made)
    data = [(i, line) for i, line in enumerate(made)]
    same(rows(lines.deduplicated_lines(spark.createDataFrame(data, "id bigint, notes string").repartition(3))), brute.deduplicated_lines(data))


def test_letters_part_no_near_lines(spark):
    maker, data = random.Random(4), []
    for i in range(600):
        a = beginning(maker, "", maker.randrange(5, 60), "etaoinsrhlbé你")
        b = list(a)
        for _ in range(maker.randrange(0, 2 + len(a) // 4)):
            at = maker.randrange(len(b))
            b[at:at + 1] = maker.choice([[], ["e"], [b[at], "z"], ["你"]])
            b = b or ["a"]
        data.append((a, "".join(b)))
    # More of a character than a count holds.
    data.append(("e" * 70_000 + "ab", "e" * 69_990 + "ba"))
    signs = lambda c, side: [x.alias(f"{side}{n}") for x, n in zip([F.char_length(c), *lines._letters(F.col(c))], lines._SIGNS)]
    got = spark.createDataFrame(data, "a string, b string").select("a", "b", *signs("a", "l"), *signs("b", "r"))
    got = got.select("a", "b", lines._may_be_near("l", "r", 0.8).alias("may")).collect()
    near = [brute.levenshtein(r.a, r.b, most) <= most for r in got for most in [int(max(len(r.a), len(r.b)) * 0.2 + 1e-9)] if len(r.a) < 100]
    may = [r.may for r in got if len(r.a) < 100]
    assert not any(n and not m for n, m in zip(near, may)) and sum(may) < len(may) and any(near)
    assert all(r.may for r in got if len(r.a) >= 100)


def test_fuzzy_lines_share_no_more_than_they_should(spark):
    maker = random.Random(8)
    base = [" ".join("".join(maker.choice("abcdefghij") for _ in range(4)) for _ in range(60)) for _ in range(6)]
    data = []
    for i in range(80):
        words = maker.choice(base).split(" ")
        for _ in range(maker.randrange(3)):
            words[maker.randrange(60)] = "".join(maker.choice("klm") for _ in range(4))
        data.append((i, "\n".join([" ".join(words), maker.choice(["Own line", "  own LINE ", f"{words[0]} line {i}"])])))
    same(rows(lines.deduplicated_lines(spark.createDataFrame(data, "id bigint, notes string"))), brute.deduplicated_lines(data))


def test_distances(spark):
    maker = random.Random(4)
    data = []
    for _ in range(120):
        a = "".join(maker.choice("abc é") for _ in range(maker.choice([0, 5, 100, 400, 900])))
        b = list(a)
        for _ in range(maker.choice([0, 1, 5, 30])):
            b.insert(maker.randrange(len(b) + 1), maker.choice("xyz"))
        data.append((a, "".join(b)[maker.randrange(3):]))
    df = spark.createDataFrame(data, "a string, b string").repartition(2)
    for most in (3, 20, 300, 10_000):
        got = df.select("a", "b", lines.distance(F.col("a"), F.col("b"), F.lit(most)).alias("d")).collect()
        for r in got:
            want = brute.levenshtein(r.a, r.b)
            assert r.d == want or min(r.d, want) > most


# Pages


def test_held_out_pages():
    from tarnfell.llm.blocks import blocks, features
    from tarnfell.llm.pagemodel import labelled_pages, trained

    field, wrong, count = trained(), 0, 0
    for page, labels in labelled_pages(200, seed=50_000):
        parts = blocks(page)
        want = [labels.get(p.text, 0) for p in parts]
        wrong += sum(a != b for a, b in zip(field.labels(features(parts)), want, strict=True))
        count += len(want)
    assert wrong < 0.01 * count


def test_page_texts(spark):
    page = ("<html><head><title>T</title><script>x='<p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A&amp;B  title</h1>"
            "<p>One <b>bold</b>\n text.<p>Two &lt;tag&gt; here.</p><div class=ad>Buy this now.</div></article><div class=\"comments\"><p>Nice one.</p></div>"
            "<footer>&copy; site</footer>")
    df = spark.createDataFrame([(1, page, "old"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (1, page, "old")], "path bigint, html string, text string")
    got = sorted((r.path, r.text) for r in pages.page_texts(df).collect())
    text = "A&B title\nOne bold text.\nTwo <tag> here."
    assert got == [(1, text), (1, text), (2, ""), (3, ""), (4, "")]
    assert pages.page_texts(df.limit(0)).collect() == []


# Licences


def test_licences(spark, nothing):
    data = [(i, f"some words before it {i}. {n} and then some more words") for i, n in enumerate(licences.NOTICES.values())]
    data += [(50, None), (51, ""), (52, "Released under"), (53, "released under the mit\nlicense"), (None, "Released under the MIT License.")]
    got = licences.licences_found(spark.createDataFrame(data, "id bigint, notes string").withColumn("licence", F.lit("clash")))
    found = {(r.id, r.licence) for r in got.collect()}
    assert found == {(i, k) for i, k in enumerate(licences.NOTICES)} | {(53, "MIT"), (None, "MIT")}
    assert licences.licences_found(nothing).collect() == []


def test_licences_in_documents(spark, docs):
    def shingles(text):
        words = brute.passage_words((text or "").lower())
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    want = set()
    for i, n in listed(docs):
        have = shingles(n)
        for name, notice in licences.NOTICES.items():
            need = shingles(notice)
            if len(need & have) >= 0.8 * len(need):
                want.add((i, name))
    assert want and {(r.id, r.licence) for r in licences.licences_found(docs).collect()} == want


# SimHash groups


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_near_pins(which, request):
    df = request.getfixturevalue(which)
    same(rows(simhash.near_pins(df)), brute.near_pins(listed(df)))


def test_links_are_all_pairs(spark):
    maker = random.Random(2)
    seeds = [maker.getrandbits(64) for _ in range(6)]
    prints = set()
    for _ in range(400):
        x = maker.choice(seeds)
        for _ in range(maker.randrange(4)):
            x ^= 1 << maker.randrange(64)
        prints.add(x)
    nodes = sorted(brute.signed(p) for p in prints)
    want = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if ((a ^ b) & brute.MASK).bit_count() <= 2]
    got = simhash.links(spark.createDataFrame([(n,) for n in nodes], "fingerprint bigint"))
    same(rows(got), want)


# Decontamination


@pytest.mark.parametrize("which", ["docs", "awkward"])
def test_repeated_passages(spark, which, request):
    df = request.getfixturevalue(which)
    strings = [tuple(r) for r in table(spark, SF_DIR, "benchmark").collect()]
    strings += [(9001, "alpha BETA gamma"), (9002, "One"), (9003, None), (9004, " .,"), (9005, " ".join(LONG.split(" ")[5_000:5_040])), (9006, "ab " * 30),
                (9007, "Alpha-beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (9005, "one")]
    table_ = spark.createDataFrame(strings, "key bigint, value string").withColumn("_text", F.lit("clash"))
    same(rows(decontamination.repeated_passages(df, table_)), brute.repeated_passages(listed(df), strings))


# Quality


def test_quality_on_held_out_rows(spark):
    got = PLANS["op10_quality"](spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == got.quality).mean() > 0.95) and len(got) > 50
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_quality_of_awkward_rows(spark, awkward, nothing):
    ratings = spark.createDataFrame([(1, 1), (6, 0), (6, 0), (3, None), (None, 1), (99, 1)], "id bigint, good int")
    got = quality.note_quality(awkward, ratings).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in quality.note_quality(awkward, ratings.limit(0)).collect()} == {0.5}
    assert quality.note_quality(nothing, ratings).collect() == []


# All


def test_empty_tables(nothing):
    empty = nothing
    for operator in (fingerprints.note_fingerprints, fingerprints.edited_fingerprints, personal.personal_data, repeats.without_repeats,
                     lines.deduplicated_lines, simhash.near_pins, lambda d: decontamination.repeated_passages(d, d.select(F.col("id").alias("key"), F.col("notes").alias("value")))):
        assert operator(empty).collect() == []


def test_repeated_rows_keep_their_count(spark):
    df = spark.createDataFrame([(1, "a@b.se and the words that follow it here")] * 3, "id bigint, notes string")
    strings = spark.createDataFrame([(1, "the words that follow")], "key bigint, value string")
    assert fingerprints.edited_fingerprints(df).count() == 3
    assert [len(r.spans) for r in personal.personal_data(df).collect()] == [1, 1, 1]
    assert [r.component_id for r in simhash.near_pins(df).collect()] == [1, 1, 1]
    assert [r.n_hit for r in decontamination.repeated_passages(df, strings).collect()] == [4, 4, 4]
    assert sorted(r.n_removed for r in lines.deduplicated_lines(df).collect()) == [0, 1, 1]
