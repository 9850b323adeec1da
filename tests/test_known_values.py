"""Small literal cases with known answers."""

import pytest
from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo, text
from tarnfell.operators import documents, gazetteer, raster, routes, search, telemetry, tiles


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*xs):
    return [F.lit(float(x)) for x in xs]


@pytest.mark.parametrize("points, low, high", [
    ((59.3293, 18.0686, 57.7089, 11.9746), 393_000, 403_000),  # Stockholm to Gothenburg
    ((68.35, 18.83, 68.35, 19.83), 40_300, 42_300),            # one degree of longitude far north
    ((68.35, 18.83, 68.36, 18.83), 1_100, 1_130),
    ((60.0, 179.999, 60.0, -179.999), 100, 120),               # across the date line
])
def test_distance(spark, points, low, high):
    assert low < value(spark, geo.geodesic_m(*lits(*points))) < high


def test_closed_form_and_iteration_agree(spark):
    args = lits(61.0, 12.0, 61.15, 12.35)
    assert value(spark, geo.geodesic_m(*args)) == pytest.approx(value(spark, geo._vincenty_m(*args)), abs=1e-4)


@pytest.mark.parametrize("length, spacing", [(12_000, 1_000), (200_000, 5_000), (2_000_000, 50_000), (10**8, 100_000)])
def test_marker_spacing(spark, length, spacing):
    assert value(spark, geo.marker_spacing(F.lit(float(length)))) == spacing


def test_height_tile_position(spark):
    pixel = geo.tile_pixel(*lits(12.15, 61.05), 12)
    assert (value(spark, pixel["tile_x"]), value(spark, pixel["tile_y"])) == (2186, 1165)


def test_height_packing_round_trip(spark):
    heights = spark.createDataFrame([(h,) for h in (0.0, 1.0, 255.0, 256.0, 1489.0, -5.0, 2469.0, None)], "h double")
    packed = heights.select("h", *[c.alias(k) for k, c in geo.pack_height(F.col("h")).items()])
    back = packed.select("h", geo.unpack_height(F.col("hi"), F.col("lo"), F.col("alpha")).alias("b")).collect()
    assert all(r["b"] == r["h"] for r in back)


@pytest.mark.parametrize("heights, hysteresis, expected", [
    ([100.0, 200.0, 150.0, 300.0], 0.0, (250.0, 50.0)),
    ([500.0, 501.0] * 20, 4.0, (0.0, 0.0)),
    ([100.0, None, 900.0], 4.0, (0.0, 0.0)),
    ([100.0, 104.0], 4.0, (4.0, 0.0)),
])
def test_climb(spark, heights, hysteresis, expected):
    row = spark.createDataFrame([(heights,)], "h array<double>").select(routes.climb(F.col("h"), hysteresis).alias("c")).first()["c"]
    assert (row["ascent"], row["descent"]) == expected


def test_resampling_one_kilometre(spark):
    line = spark.createDataFrame([(1, 0, 6_835_000, 1_883_000), (1, 1, 6_835_897, 1_883_000)],
                                 "route_id long, seq long, lat_e5 long, lon_e5 long")
    distances = [r["distance"] for r in routes.resampled(line).orderBy("k").collect()]
    assert distances[:3] == [0.0, 25.0, 50.0]
    assert distances[-1] == pytest.approx(1000, abs=2) and len(distances) in (41, 42)


def test_resampling_caps_long_routes_and_keeps_both_ends(spark):
    line = spark.createDataFrame([(1, i, 6_000_000 + i * 30_000, 1_500_000) for i in range(10)],
                                 "route_id long, seq long, lat_e5 long, lon_e5 long")
    rows = routes.resampled(line).orderBy("k").collect()
    assert len(rows) == fixed.MAX_SAMPLES
    assert rows[-1]["lat"] == pytest.approx(62.7, abs=1e-6)


def test_single_point_route_has_one_sample(spark):
    line = spark.createDataFrame([(1, 0, 6_000_000, 1_500_000)], "route_id long, seq long, lat_e5 long, lon_e5 long")
    assert [r["distance"] for r in routes.resampled(line).collect()] == [0.0]


def test_latency_buckets_are_right_closed(spark):
    assert [value(spark, telemetry.latency_bucket(F.lit(ms))) for ms in (0.5, 1.0, 1.01, 20.0, 10_000.0, 45_000.0)] == [0, 0, 1, 3, 8, 9]


def test_percentiles_of_a_histogram(spark):
    h = F.array(*[F.lit(n).cast("long") for n in (0, 0, 0, 95, 0, 0, 0, 0, 5, 0)])
    assert value(spark, telemetry.histogram_percentile(h, 0.5))["bound_ms"] == 30
    assert value(spark, telemetry.histogram_percentile(h, 0.99))["bound_ms"] == 10_000
    over = F.array(*[F.lit(n).cast("long") for n in [0] * 9 + [1]])
    assert value(spark, telemetry.histogram_percentile(over, 0.5))["overflow"] is True
    empty = F.array(*[F.lit(0).cast("long")] * 10)
    assert value(spark, telemetry.histogram_percentile(empty, 0.5)) is None


def test_rates_leave_expected_gaps_out(spark):
    log = [("offlineStore",)] * 3 + [("network",)] + [("expectedNoData",)] * 96
    row = telemetry.service_rates(spark.createDataFrame(log, "source string").withColumn("server", F.lit(0)), ["server"]).first()
    assert (row["local_hit_rate"], row["fault_rate"]) == (0.75, 0.0)
    gaps = spark.createDataFrame([("expectedNoData",)], "source string").withColumn("server", F.lit(0))
    assert telemetry.service_rates(gaps, ["server"]).first()["fault_rate"] is None


def test_tokens_fold_marks_but_not_own_letters(spark):
    assert value(spark, text.tokens(F.lit('Stora Sjöfal "Værøy" Idnetčohkka-2'))) == ["stora", "sjofal", "værøy", "idnetcohkka", "2"]
    assert value(spark, text.tokens(F.lit("Sjö"))) == ["sjo"]
    assert value(spark, text.tokens(F.lit(" - "))) == []
    assert value(spark, text.composed_length(F.lit(" Sjö "))) == 3


def search_fixture(spark):
    places = spark.createDataFrame([
        (1, "Storsjön", 2, 3, 0, 6_000_000, 1_500_000, 1), (2, "Stora Sjöfallet", 1, 0, 0, 6_000_000, 1_500_000, 1),
        (3, "Værøy", 0, 3, 1, 6_000_000, 1_500_000, None), (4, "Storvägen", 8, 3, 1, 6_000_000, 1_500_000, 2)],
        "place_id long, name string, kind int, rank int, country int, lat_e5 long, lon_e5 long, muni long")
    aliases = spark.createDataFrame([(1_000_000_001, 2, "Stuor Muorkke", "se")], "alias_id long, place_id long, name string, lang string")
    munis = spark.createDataFrame([(1, "Jokkmokk", "Norrbotten"), (2, "Nord-Odal", "Innlandet")], "muni long, adm string, region string")
    return places, aliases, munis


@pytest.mark.parametrize("cap", [None, 60_000])
def test_search(spark, cap):
    places, aliases, munis = search_fixture(spark)
    queries = search.query_frame(spark, ["stor", "STORSJON", "stora sjöfal", "værøy", "vaeroy", "stuor", "", '"'])
    rows = search.search(queries, places, aliases, munis, scan_cap=cap).orderBy("query_id", "position").collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append((r["name"], r["matched_alias"]))
    assert [n for n, _ in found[0]] == ["Stora Sjöfallet", "Storsjön", "Storvägen"]
    assert found[1] == [("Storsjön", None)] and found[2] == [("Stora Sjöfallet", None)]
    assert found[3] == [("Værøy", None)] and found[5] == [("Stora Sjöfallet", "Stuor Muorkke")]
    assert not {4, 6, 7} & set(found)


def test_scan_cap_keeps_the_lowest_owners(spark):
    matches = spark.range(200_000).select(F.lit(1).cast("long").alias("query_id"), (F.col("id") * 7).alias("owner_id"))
    capped = search.capped(matches, 60_000)
    assert capped.agg(F.count("*"), F.max("owner_id")).first()[:] == (60_000, 59_999 * 7)


def test_unknown_scope_is_an_error():
    with pytest.raises(ValueError):
        gazetteer.scope_ids(["water", "moon"])


def test_slope_class_breaks_are_left_closed(spark):
    assert [value(spark, raster.slope_class(F.lit(s), F.lit(1.0))) for s in (29.9, 30.0, 35.0, 49.9, 50.0)] == [0, 1, 2, 4, 5]


def test_ancestor_and_shared_tiles(spark):
    stored = spark.createDataFrame([(0, 9, 3, 4), (0, 7, 0, 1)], "server int, z int, x long, y long")
    wanted = spark.createDataFrame([(0, 12, 24, 32), (0, 9, 3, 4), (0, 12, 90, 90)], "server int, z int, x long, y long")
    found = {(r["z"], r["x"]): r["anc_z"] for r in tiles.nearest_ancestors(wanted, stored).collect()}
    assert found == {(12, 24): 9, (9, 3): 7}
    held = spark.createDataFrame([("a", 0, 9, 1, 1), ("b", 0, 9, 1, 1), ("a", 0, 9, 2, 1)],
                                 "region_id string, server int, z int, x long, y long")
    gone = tiles.refcounted_delete(held, F.col("region_id") == "a").filter("deleted").collect()
    assert [r["x"] for r in gone] == [2]


def test_stable_id_and_titles(spark):
    assert value(spark, documents.stable_id(F.lit("kungsleden"))) == "6b756e67-736c-6564-656e-000000000000"
    assert value(spark, documents.pin_title(F.lit("  "))) == ""
    assert value(spark, documents.distance_label(F.lit(999.4))) == "999 m"
    assert value(spark, documents.distance_label(F.lit(12_345.0))) in ("12.34 km", "12.35 km")


@pytest.mark.parametrize("version, ok", [("1.2", True), ("1.2.3", True), ("1", False), ("1.2.3.4", False), ("1.٢", False)])
def test_versions(spark, version, ok):
    assert value(spark, documents.well_formed_version(F.lit(version))) is ok


def test_estimate_counts_the_jobs(spark):
    region = spark.createDataFrame([(1, 68.30, 18.70, 68.40, 18.95)], "region_id int, min_lat double, min_lon double, max_lat double, max_lon double")
    jobs = tiles.region_jobs(region, ["region_id"], fixed.layers(spark))
    estimate = tiles.download_estimate(region, ["region_id"], F.lit(10**12)).first()
    assert jobs.count() == estimate["tile_count"]
    assert sorted(r["z"] for r in jobs.select("z").distinct().collect()) == list(range(7, 15))
