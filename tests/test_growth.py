"""Plans and results that must hold when tables grow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import gazetteer, raster, search, search_index
from tarnfell.sources import register_xml


def plan_of(df):
    """The plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("warp", ["nearest", "bilinear"])
def test_pixels_are_never_broadcast(spark, warp):
    """Rows are multiplied below the join, and their estimate isn't."""
    pixels = spark.range(2).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        "x", F.lit(1).alias("y"), F.col("id").alias("px_row"), F.col("x").alias("px_col"),
        (F.col("x") + 0.5).alias("gx"), (F.col("id") + 0.5).alias("gy"))
    cells = spark.range(200).selectExpr("cast(id div 10 as int) AS row", "cast(id % 10 as int) AS col", "cast(id as double) AS height")
    found = raster.nearest_warp(pixels, cells, "height") if warp == "nearest" else raster.bilinear_warp(pixels, cells)
    plan = plan_of(found)
    assert "Broadcast" not in plan
    assert {(r.px_row, r.px_col): r.height for r in found.collect()} == {(i, x): 10.0 * i + x for i in range(2) for x in range(10)}


PLACES = "place_id long, name string, kind int, rank int, country int, lat_e5 long, lon_e5 long, muni long"
ASKED = ["stor", "STOR ", "stor sj", "sj stor", "å", "nothing"]


@pytest.fixture(scope="module")
def searched(spark):
    names = ["Storsjön", "Stor sjö", "Å", "Lilla stor", "Sjö"]
    places = spark.createDataFrame([(i + 1, names[i % 5], i % 7, i % 13, 0, 0, 0, 1) for i in range(60)], PLACES)
    aliases = spark.createDataFrame([(10_000_000 + i, i + 1, f"Sjö stor {i}") for i in range(0, 60, 3)], "alias_id long, place_id long, name string")
    return search.query_frame(spark, ASKED), places, aliases, spark.createDataFrame([(1, "a", "b")], "muni long, adm string, region string")


def test_a_question_is_answered_once(searched):
    wanted = search.asked(searched[0])
    assert wanted.count() == 6 and search.questions(wanted).count() == 4


def test_hits_are_not_dealt_out(searched):
    queries, places, aliases, _ = searched
    for found in (search.prefix_matches(queries, search.index_input(places, aliases)), search.hits(queries, places, aliases),
                  search.best_hits(queries, places, aliases)):
        above = plan_of(found).split("forall(")[0]
        assert "hashpartitioning" not in above and "rangepartitioning" not in above


def test_best_hits_cap_and_search_against_all_hits(searched):
    queries, places, aliases, munis = searched
    hits = [r.asDict() for r in search.hits(queries, places, aliases).collect()]
    matches = search.prefix_matches(queries, search.index_input(places, aliases))
    assert sorted((r.query_id, r.owner_id) for r in matches.collect()) == sorted((h["query_id"], h["owner_id"]) for h in hits)
    best, owners = {}, {}
    for h in hits:
        key = h["query_id"], h["place_id"]
        best[key] = min(best.get(key, (1e9, 0)), (h["score"], h["owner_id"]))
        owners.setdefault(h["query_id"], []).append(h["owner_id"])
    assert best == {(r.query_id, r.place_id): (r.score, r.owner_id) for r in search.best_hits(queries, places, aliases).collect()}
    top = search.search(queries, places, aliases, munis, limit=5)
    assert top.columns[:3] == ["query_id", "position", "place_id"]
    want = [(q, p) for q in owners for _, p in sorted((best[k][0], k[1]) for k in best if k[0] == q)[:5]]
    assert sorted((r.query_id, r.place_id) for r in top.collect()) == sorted(want)
    for cap in (1, 7, 1000):
        few = search.capped_matches(queries, search.index_input(places, aliases), cap)
        assert sorted((r.query_id, r.owner_id) for r in few.collect()) == sorted((q, o) for q in owners for o in sorted(owners[q])[:cap])


def test_register_files_are_bounded(spark, tmp_path):
    place = "named_struct('Point', named_struct('pos', '1 2')) AS posisjon"
    records = spark.range(50).coalesce(1).selectExpr("id AS stedsnummer", "'terreng' AS navneobjekthovedgruppe", place)
    path = f"{tmp_path}/register"
    register_xml.write_register(records, path, file_records=20)
    written = [p.read_text(encoding="utf-8").count(f"<{register_xml.ROW_TAG}>") for p in (tmp_path / "register").glob("part-*")]
    assert sum(written) == 50 and max(written) <= 20
    assert sorted(r.native_id for r in register_xml.read_register(spark, path).collect()) == list(range(50))


def test_cells_are_measured_along_their_near_edges(spark):
    """Ten times the places of one name: pairs of cells are decided by boxes and outermost places, few positions are left to measure."""
    maker = random.Random(5)
    counts = []
    for n in (600, 6000):
        rows = [(i, "a", 6_000_000 + maker.randrange(2000), 1_500_000 + maker.randrange(4000)) for i in range(n)]
        celled, anchors = gazetteer._cells(spark.createDataFrame(rows, "place_id long, name string, lat_e5 long, lon_e5 long"), 1000.0)
        pairs = gazetteer._neighbour_cells(anchors.drop("n"), 1000.0)
        counts.append(gazetteer._facing(pairs.filter("NOT sure"), celled, 1000.0).count())
    assert counts[1] <= 10 * max(counts[0], 60)


def test_names_that_are_alike_are_listed_once(spark):
    """Copies of a name are not multiplied into prefixes, and the lists are those of all names."""
    rows = []
    for copies in (2, 60):
        places = spark.createDataFrame([(i + 1, ["Stor sjö", "Sjö", "Lilla"][i % 3], i % 7, i % 13, 0, 0, 0, 1) for i in range(3 * copies)], PLACES)
        aliases = spark.createDataFrame([(10_000_000 + i, i + 1, "Sjö") for i in range(copies)], "alias_id long, place_id long, name string")
        names = search_index.entries(places, aliases).collect()
        given = spark.createDataFrame(names, "owner_id long, place_id long, n_chars int, static long, terms array<string>")
        rows.append(search_index._offered(search_index._alike(given)).count())
    assert rows[0] == rows[1]
    lists = {}
    for r in names:
        for prefix in {t[:n] for t in r.terms for n in range(1, len(t) + 1)}:
            for length in (0, r.n_chars):
                lists.setdefault((prefix, length), []).append(r)
    want = {}
    for key, hits in lists.items():
        best = {}
        for r in hits:
            best[r.place_id] = min(best.get(r.place_id, (1 << 40, 0)), (r.static, r.owner_id))
        if sum(r.n_chars >= 0 for r in lists[key[0], 0]) > 10:
            want[key] = len(hits), min(len(best), 6), sorted((s, p, o) for p, (s, o) in best.items())[:5]
    index = search_index.build(places, aliases, depth=5, cap=10)
    assert index.names.count() <= 4 * 6  # four kinds of names
    heads = index.heads.collect()
    assert {(r.prefix, r.length): (r.total, r.places, sorted((h.static, h.place_id, h.owner_id) for h in r.best)) for r in heads} == want
