"""Sources and routes on awkward layouts: folders, rewrites, deep geometries, long tracks."""

import os
import shutil

import pytest
from check import compare, connect
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from tarnfell.operators import gazetteer, routes
from tarnfell.sources import documents
from tarnfell.sources.register_xml import read_register

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The given tables with every large one as a folder of part files."""
    top = str(tmp_path_factory.mktemp("folders"))
    for name in os.listdir(SF_DIR):
        if name.startswith(("events", "orders", "lineitem", "part", "documents")):
            spark.read.parquet(f"{SF_DIR}/{name}").repartition(3).write.parquet(f"{top}/{name}")
        else:
            shutil.copy(f"{SF_DIR}/{name}", top)
    return top


@pytest.mark.parametrize("name", ["M1_running_metrics", "M2_windowed_metrics", "W1_segments", "W4_resampled", "A20_profile_summary", "J5_window_overlap", "W11_app_opens"])
def test_folders_give_the_same_rows(spark, folders, name):
    plans, oracles = queries(), oracle_sql()
    name = next((n for n in plans if n.startswith(name.split("_")[0] + "_")), name)
    problem, rows = compare(plans[name](spark, folders), connect(SF_DIR), oracles[name])
    assert problem is None and rows


def _save(folder, name, metres, indent=None):
    import json

    (folder / name).write_text(json.dumps({"id": name[:-5], "meters": metres, "name": None}, indent=indent))


def test_rewritten_and_deleted_documents(spark, tmp_path):
    for name in ("a.json", "b.json", "c.json"):
        _save(tmp_path, name, 1.0, indent=2)
    before = spark.createDataFrame(documents.listing(spark, str(tmp_path)).collect(), "path string, modified timestamp, length long")
    _save(tmp_path, "b.json", 99.25)
    _save(tmp_path, "d.json", 4.0, indent=2)
    (tmp_path / "a.json").unlink()
    changed, deleted = documents.document_changes(spark, str(tmp_path), documents.SAVED_ROUTE, before)
    assert {(r["id"], r["meters"]) for r in changed.collect()} == {("b", 99.25), ("d", 4.0)}
    assert [os.path.basename(r["path"]) for r in deleted.collect()] == ["a.json"]


def test_feed_of_polls(spark, tmp_path):
    folder, log = tmp_path / "docs", str(tmp_path / "log")
    folder.mkdir()

    def polled(number):
        documents.poll(spark, str(folder), documents.SAVED_ROUTE, log, number)
        found = documents.fed_documents(spark, documents.SAVED_ROUTE, log).collect()
        return sorted((r["id"], r["meters"]) for r in found)

    assert polled(0) == []
    for name in ("a.json", "b.json", "c.json"):
        _save(folder, name, 1.0, indent=2)
    assert polled(1) == [("a", 1.0), ("b", 1.0), ("c", 1.0)]
    _save(folder, "b.json", 99.25)
    (folder / "d.json").write_text("{ no document")
    (folder / "a.json").unlink()
    assert polled(2) == polled(2) == [("b", 99.25), ("c", 1.0)]  # a poll may be run again
    _save(folder, "a.json", 5.0)
    (folder / "d.json").unlink()
    assert polled(3) == polled(4) == [("a", 5.0), ("b", 99.25), ("c", 1.0)]
    assert spark.read.parquet(f"{log}/documents").filter("batch_id > 2").count() == 1  # nothing is read twice


def test_indented_documents_stream(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name in ("a.json", "b.json"):
        _save(folder, name, 2.0, indent=2)
    stream = documents.document_stream(spark, str(folder), documents.SAVED_ROUTE)
    stream.writeStream.format("memory").queryName("indented").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r["id"] for r in spark.table("indented").collect()} == {"a", "b"}


def test_every_geometry_and_the_first_municipality(spark, tmp_path):
    def place(number, geometry, extra=""):
        district = "<app:kommune><app:Kommune><app:kommunenavn>{}</app:kommunenavn><app:fylkesnavn>F</app:fylkesnavn></app:Kommune></app:kommune>"
        return f"<app:Sted><app:stedsnummer>{number}</app:stedsnummer><app:posisjon>{geometry}</app:posisjon>{district.format('A')}{extra and district.format(extra)}</app:Sted>"

    ring = "<gml:Surface><gml:patches><gml:PolygonPatch><gml:exterior><gml:LinearRing><gml:posList>0 0 4 0 4 2 0 0</gml:posList></gml:LinearRing></gml:exterior></gml:PolygonPatch></gml:patches></gml:Surface>"
    many = "<gml:MultiPoint><gml:pointMember><gml:Point><gml:pos>1 1</gml:pos></gml:Point></gml:pointMember><gml:pointMember><gml:Point><gml:pos>3 5</gml:pos></gml:Point></gml:pointMember></gml:MultiPoint>"
    body = place(1, "<gml:Point srsDimension=\"2\"><gml:pos>7 8</gml:pos></gml:Point>", "B") + place(2, ring) + place(3, many) + place(4, "")
    (tmp_path / "r.xml").write_text(f'<SSR xmlns:app="a" xmlns:gml="g">{body}</SSR>')
    got = {r.native_id: (r.x, r.y, r.adm) for r in read_register(spark, str(tmp_path)).collect()}
    assert got == {1: (7.0, 8.0, "A"), 2: (2.0, 1.0, "A"), 3: (2.0, 3.0, "A")}


def test_full_case_folding(spark):
    pairs = [("Straße", "STRASSE"), ("ﬁn", "FIN"), ("ΟΔΟΣ", "οδος"), ("Ærø", "ÆRØ")]
    df = spark.createDataFrame(pairs, "a string, b string").select((gazetteer.casefold(F.col("a")) == gazetteer.casefold(F.col("b"))).alias("same"))
    assert all(r.same for r in df.collect())


def test_a_long_track_is_cut_into_stretches(spark, monkeypatch):
    track = spark.range(3_000).select(F.lit(1).alias("route_id"), F.col("id").alias("seq"), (6_000_000 + F.col("id") * 37 % 1000).alias("lat_e5"), (1_500_000 + F.col("id") * 91 % 1000).alias("lon_e5"))
    whole = routes.route_lengths(track).first()
    monkeypatch.setattr(routes, "_STRETCH", 128)
    legs = routes._legs(track)
    assert routes.route_lengths(track).first().metres == pytest.approx(whole.metres)
    assert legs.agg(F.max("travelled")).first()[0] == pytest.approx(whole.metres)
    assert legs.filter("is_last").count() == 1 and legs.filter("lat0 is null").count() == 1
    assert routes.distance_markers(track, 1000.0).count() == int(whole.metres // 1000)


def test_bundle_without_manifest_is_not_read(spark, tmp_path):
    from tarnfell.sources import bundle
    place = "place_id bigint, kind int, rank int, lat_e5 int, lon_e5 int, country int, adm string, region string, name string"
    places = spark.createDataFrame([(1, 1, 1, 6000000, 1500000, 0, "A", "R", "Storvik"), (2, 1, 2, 6100000, 1500000, 1, "B", None, "Ås")], place)
    aliases = spark.createDataFrame([(100, 1, "Vik", "norsk")], "alias_id bigint, place_id bigint, name string, lang string")
    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        bundle.read_bundle(spark, path)
    bundle.write_bundle(places, aliases, spark.createDataFrame([], "place_id bigint"), path)
    found = {(r["part"], r["key"], r["content"]) for r in bundle.bundle_rows(bundle.read_bundle(spark, path)).collect()}
    assert ("place", 2, "1|2|6100000|1500000|1|2|Ås") in found and ("alias", 100, "1|Vik|1") in found
    bundle.read_bundle(spark, path)["term"].limit(1).write.mode("append").parquet(f"{path}/term")
    with pytest.raises(ValueError, match="term"):
        bundle.read_bundle(spark, path)
