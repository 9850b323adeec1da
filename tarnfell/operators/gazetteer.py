"""Two place registers to one gazetteer: row rules, names, ids, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed, geo
from tarnfell.operators.components import min_labels
from tarnfell.operators.ordered import dense_ids, running_totals
from tarnfell.operators.skew import join_groups, sized
from tarnfell.session import materialised

KIND_ID = {name: i for i, name in enumerate(fixed.KINDS)}


# --------------------------------------------------------------- row rules

def register_scan(raw: DataFrame) -> DataFrame:
    """Named rows of the first register, district names left out, names trimmed."""
    named = raw.filter(F.col("ortnamn").isNotNull() & (F.col("ortnamn") != "")
                       & ~F.col("detaljtyp").isin(fixed.FIRST_REGISTER_SKIP))
    return named.withColumn("ortnamn", F.trim("ortnamn"))


def chosen_point(geom_x: Column, geom_y: Column, easting: Column, northing: Column) -> Column:
    """The geometry when usable, else the coordinate columns."""
    usable = geom_x.isNotNull() & geom_y.isNotNull()
    return F.when(usable, F.struct(geom_x.alias("x"), geom_y.alias("y"))).otherwise(
        F.struct(easting.alias("x"), northing.alias("y")))


def extent_midpoint(vertices: DataFrame, key: str) -> DataFrame:
    """Midpoint of the extent of a multi-vertex geometry (its vertex when it has one)."""
    extent = vertices.filter("x IS NOT NULL AND y IS NOT NULL").groupBy(key).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return extent.select(key, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))


def first_register_kind(code: Column) -> Column:
    return F.coalesce(fixed.lookup(code, {k: KIND_ID[v] for k, v in fixed.FIRST_REGISTER_KIND.items()}),
                      F.lit(KIND_ID["other"]))


def second_register_kind(group: Column, subgroup: Column) -> Column:
    """Sub-group overrides group; neither known means 'other'."""
    return F.coalesce(
        fixed.lookup(subgroup, {k: KIND_ID[v] for k, v in fixed.SECOND_REGISTER_SUBGROUP_KIND.items()}),
        fixed.lookup(group, {k: KIND_ID[v] for k, v in fixed.SECOND_REGISTER_GROUP_KIND.items()}),
        F.lit(KIND_ID["other"]))


def first_register_rank(code: Column) -> Column:
    return F.coalesce(fixed.lookup(code, fixed.FIRST_REGISTER_RANK), F.lit(fixed.FIRST_REGISTER_DEFAULT_RANK))


def graded_rank(sorting: Column) -> Column:
    """Grade letter A.. to 0..12; anything else is 7."""
    graded = sorting.startswith("viktighet") & (F.length(sorting) == 10)
    letter = F.ascii(F.upper(F.substring(sorting, 10, 1))) - ord("A")
    return F.when(graded, geo.clamp(letter, 0, 12)).otherwise(7).cast("int")


def in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def scope_ids(names: list[str]) -> list[int]:
    """Kind ids of a scope; an unknown name is an error."""
    unknown = sorted(set(names) - set(KIND_ID))
    if unknown:
        raise ValueError(f"unknown kinds: {', '.join(unknown)}")
    return [KIND_ID[n] for n in names]


def in_scope(places: DataFrame, names: list[str]) -> DataFrame:
    return places.filter(F.col("kind").isin(scope_ids(names)))


def subtitle(*parts: str) -> Column:
    """Non-null parts without repeats."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), ", ")


def first_register_places(raw: DataFrame, municipalities: DataFrame) -> DataFrame:
    """The whole first register: scan, point, projection, range, kinds, names of codes.

    ``municipalities(code, adm)`` is the register's own code list.
    """
    scanned = register_scan(raw)
    point = chosen_point(F.col("geom_x"), F.col("geom_y"), F.col("ekoordinat"), F.col("nkoordinat"))
    lon, lat = geo.unproject(F.col("p.x"), F.col("p.y"))
    located = scanned.withColumn("p", point).withColumn("lon", lon).withColumn("lat", lat)
    inside = located.filter(in_range(F.col("lat"), F.col("lon")))
    return inside.join(municipalities, F.col("kommunkod") == F.col("code"), "left").select(
        "native_id", F.lit(fixed.SWEDEN).alias("country"), first_register_kind(F.col("detaljtyp")).alias("kind"),
        first_register_rank(F.col("detaljtyp")).alias("rank"),
        geo.to_e5(F.col("lat")).alias("lat_e5"), geo.to_e5(F.col("lon")).alias("lon_e5"),
        "adm", fixed.lookup(F.col("lanskod"), fixed.COUNTIES).alias("region"),
        F.array(F.struct(F.col("ortnamn").alias("written"),
                         fixed.lookup(F.coalesce("sprak", F.lit("")), fixed.FIRST_REGISTER_LANGUAGE, "sv").alias("lang"))).alias("names"))


# --------------------------------------------------------------- names

def casefold(text: Column) -> Column:
    """Caseless form: upper case spells out the sharp s, ligatures and the like, then lower case of that.

    The optimizer drops an upper case whose lower case is taken, so a step stands
    between the two: final sigmas, of which upper case leaves none.
    """
    return F.replace(F.lower(F.replace(F.upper(text), F.lit("\u03c2"), F.lit("\u03c3"))), F.lit("\u03c2"), F.lit("\u03c3"))


def ranked_names(spellings: Column, priority: Column) -> Column:
    """Current spellings of one place, best first, case-insensitive repeats removed.

    ``spellings`` is ``array<struct<name_status, language, spelling_status,
    written>>``: a place is one record, so this never leaves its row.
    """
    languages = F.split(F.coalesce(priority, F.lit("norsk")), "-")

    def ranked(s):
        language = F.coalesce(s["language"], F.lit("norsk"))
        at = F.array_position(languages, language)
        return F.struct(
            fixed.lookup(F.coalesce(s["name_status"], F.lit("")), fixed.NAME_STATUS_RANK).alias("a"),
            F.when(at == 0, F.size(languages).cast("long")).otherwise(at - 1).alias("b"),
            fixed.lookup(F.coalesce(s["spelling_status"], F.lit("")), fixed.SPELLING_RANK).alias("c"),
            s["written"].alias("written"), language.alias("language"), casefold(s["written"]).alias("folded"))

    current = F.filter(
        F.transform(spellings, ranked),
        lambda r: r["a"].isNotNull() & r["c"].isNotNull() & r["written"].isNotNull() & (r["written"] != ""))

    def unique(ordered: Column) -> Column:
        first = F.filter(ordered, lambda r, i: ~F.exists(F.slice(ordered, 1, i), lambda q: q["folded"] == r["folded"]))
        return F.transform(first, lambda r: F.struct(
            r["written"].alias("written"), fixed.lookup(r["language"], fixed.SECOND_REGISTER_LANGUAGE, "no").alias("lang")))

    # Bound once: named within a function of each spelling, the sorted array would be made anew for each.
    return F.transform(F.array(F.sort_array(current)), unique)[0]


def second_register_places(raw: DataFrame) -> DataFrame:
    """The whole second register from nested records (one row per place)."""
    kept = raw.filter(~F.coalesce("main_group", F.lit("")).isin(fixed.SECOND_REGISTER_SKIP_GROUPS))
    lon, lat = geo.unproject(F.col("x"), F.col("y"))
    named = (kept.withColumn("names", ranked_names(F.col("spellings"), F.col("priority")))
             .withColumn("lon", lon).withColumn("lat", lat))
    usable = named.filter((F.size("names") > 0) & in_range(F.col("lat"), F.col("lon")))
    return usable.select(
        "native_id", F.lit(fixed.NORWAY).alias("country"),
        second_register_kind(F.coalesce("main_group", F.lit("")), F.coalesce("sub_group", F.lit(""))).alias("kind"),
        graded_rank(F.coalesce("sorting", F.lit(""))).alias("rank"),
        geo.to_e5(F.col("lat")).alias("lat_e5"), geo.to_e5(F.col("lon")).alias("lon_e5"), "adm", "region", "names")


def alias_rows(places: DataFrame, width: int = 1 << 16) -> DataFrame:
    """All names after the first, with ids above every place id.

    Alias ids run by place and position: the running number of aliases before a
    place is a sum over whole places, so names are exploded only at the end.
    """
    counted = places.select("place_id", "names", (F.size("names") - 1).alias("_extra"),
                            F.floor(F.col("place_id") / width).alias("_chunk"))
    offset = running_totals(counted, [], "_chunk", ["place_id"], {"_seen": F.col("_extra")})
    named = offset.filter("_extra > 0").select(
        "place_id", (F.col("_seen") - F.col("_extra")).alias("_before"), F.posexplode("names").alias("position", "n"))
    return named.filter("position > 0").select(
        (F.col("_before") + F.col("position") + fixed.ALIAS_OFFSET).alias("alias_id"), "place_id", "position",
        F.col("n.written").alias("name"), F.col("n.lang").alias("lang"))


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both registers in one running id space, the first register first."""
    return dense_ids(first.unionByName(second), "native_id", "place_id", major=["country"])


def interned(rows: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Distinct keys with dense ids in the order of first appearance; all-null keys get none."""
    distinct = rows.filter(~_all_null(keys)).groupBy(*keys).agg(F.min(order).alias("first_seen"))
    return dense_ids(distinct, "first_seen", out).select(out, *keys)


def _all_null(keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        if k != "country":
            test = test & F.col(k).isNull()
    return test


def with_interned(rows: DataFrame, dimension: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Null-safe left join of the dense ids."""
    renamed = dimension.select(out, *[F.col(k).alias(f"_k_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(renamed[f"_k_{k}"])
    return rows.join(renamed, on, "left").drop(*[f"_k_{k}" for k in keys])


# --------------------------------------------------------------- duplicates

RADIUS_M = 1000.0
# Height of a grid band, 1e-5 degree: at most 335 m. Two boxes of at most
# 335 x 335 m, corner to corner in touching bands, are within 948 m.
BAND_E5 = 300
_SHORTEST_DEGREE_M = 110_570.0
_LONGEST_DEGREE_M = 111_700.0


def with_grid_cell(places: DataFrame) -> DataFrame:
    """Latitude band and a cell in it whose width is never above 335 m.

    A degree of longitude shrinks towards the poles, so each band has its own
    cell width, taken at its edge nearest the equator.
    """
    band = F.floor(F.col("lat_e5") / BAND_E5)
    return places.withColumn("band", band).withColumn("cell", F.floor(F.col("lon_e5") / _cell_width(band)))


def _cell_width(band: Column) -> Column:
    nearest = F.least(F.abs(band), F.abs(band + 1)) * float(BAND_E5) / 1e5
    return F.greatest(F.floor(BAND_E5 / F.cos(F.radians(F.least(nearest, F.lit(89.0))))), F.lit(1)).cast("long")


def proximity_links(places: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Sparse links with the same connected components as all pairs within the radius.

    Places of one name in one cell are always within the radius, so each cell
    is one node and links its members to its smallest id. Cells of one name are
    linked when their nearest points are within the radius. Only the outline of
    a cell can hold a nearest point: for a fixed pair of latitudes the distance
    grows with the longitude difference, so the outermost points of each
    latitude row (and of each longitude column, for cells above each other)
    decide. The outline is bounded by the cell's rows and columns whatever the
    number of places, so no group of copies is ever paired with itself.
    """
    celled, anchors = _cells(places, radius_m)
    members = (join_groups(celled, anchors.filter("n > 1"), _CELL, "n").filter("place_id <> anchor")
               .select(F.lit("member").alias("link"), F.col("anchor").alias("left_id"),
                       F.col("place_id").alias("right_id")))
    return members.unionByName(_cell_links(celled, anchors.drop("n"), radius_m))


_CELL = ["name", "band", "cell"]


def _cells(places: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Places with their cell, and each cell with its smallest id and its size."""
    if radius_m < 950.0:
        raise ValueError("the grid guarantees links inside a cell only from 950 m up")
    celled = with_grid_cell(places.select("place_id", "name", "lat_e5", "lon_e5"))
    # The sides of the cell's own box, and its outermost places in eight directions, packed into whole numbers.
    lat, across = F.col("lat_e5"), F.col("lon_e5") * BAND_E5 / _cell_width(F.col("band"))
    packed = lat.cast("long") * (1 << 26) + F.col("lon_e5") + (1 << 25)
    ends = [pick(packed, by) for by in (lat, across, lat + across, lat - across) for pick in (F.min_by, F.max_by)]
    sides = [F.min("lat_e5").alias("south"), F.max("lat_e5").alias("north"), F.min("lon_e5").alias("west"), F.max("lon_e5").alias("east")]
    anchors = sized(celled, _CELL, "n", F.min("place_id").alias("anchor"), *sides, F.array_distinct(F.array(*ends)).alias("ends"))
    return celled, materialised(anchors, "cells")


def _outline(celled: DataFrame) -> DataFrame:
    """Outermost distinct positions of each cell: row ends and column ends."""
    rows = celled.groupBy(*_CELL, "lat_e5").agg(F.min("lon_e5").alias("a"), F.max("lon_e5").alias("b"))
    columns = celled.groupBy(*_CELL, "lon_e5").agg(F.min("lat_e5").alias("a"), F.max("lat_e5").alias("b"))
    ends = (rows.select(*_CELL, "lat_e5", F.explode(F.array("a", "b")).alias("lon_e5"))
            .unionByName(columns.select(*_CELL, F.explode(F.array("a", "b")).alias("lat_e5"), "lon_e5")))
    return ends.distinct()


def _metres_at_least(d_lat: Column, d_lon: Column, farthest: Column) -> Column:
    """A lower bound of the distance of two points, a metre to spare, from differences and the latitude (1e-5 degree) farther from the equator."""
    shrunk = F.when(farthest < 89e5, F.cos(F.radians(farthest / 1e5))).otherwise(0.0)
    return F.hypot(d_lat / 1e5 * _SHORTEST_DEGREE_M, d_lon / 1e5 * _SHORTEST_DEGREE_M * shrunk) - 1


def _metres_at_most(d_lat: Column, d_lon: Column, nearest: Column) -> Column:
    """An upper bound, from the latitude (1e-5 degree) nearest to the equator."""
    return F.hypot(d_lat / 1e5 * _LONGEST_DEGREE_M, d_lon / 1e5 * _LONGEST_DEGREE_M * F.cos(F.radians(nearest / 1e5)))


def _gap(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """How far two ranges are apart."""
    return F.greatest(low2 - high, low - high2, F.lit(0))


def _box(suffix: str = "") -> list[Column]:
    return [F.col(f"{side}{suffix}") for side in ("south", "north", "west", "east")]


def _farthest(*lats: Column) -> Column:
    return F.greatest(*[F.abs(lat) for lat in lats])


def _nearest(south: Column, north: Column) -> Column:
    return F.when((south <= 0) & (north >= 0), F.lit(0)).otherwise(F.least(F.abs(south), F.abs(north)))


def _neighbour_cells(anchors: DataFrame, radius_m: float) -> DataFrame:
    """Occupied cell pairs of a name that can be in reach, each pair once, with the boxes of both and ``sure``.

    Pairs whose boxes are out of reach are left out. ``sure`` pairs need no outline: their boxes are in reach of each other
    as a whole, or two of their outermost places are.
    """
    reach_bands = int(radius_m / _SHORTEST_DEGREE_M * 1e5 / BAND_E5) + 1
    farthest = (F.abs(F.col("band")) + 1 + reach_bands) * float(BAND_E5) / 1e5
    reach_lon = radius_m / (_SHORTEST_DEGREE_M * F.cos(F.radians(F.least(farthest, F.lit(89.9))))) * 1e5 + 1
    width = _cell_width(F.col("band"))
    upward = anchors.select(
        *_CELL, "anchor", *_box(), "ends", F.explode(F.sequence(F.lit(0), F.lit(reach_bands))).alias("step"),
        (F.col("cell") * width - reach_lon).alias("from"), ((F.col("cell") + 1) * width + reach_lon).alias("to"))
    other = F.col("band") + F.col("step")
    other_width = _cell_width(other)
    listed = upward.select(*_CELL, "anchor", *_box(), "ends", "step", other.alias("band2"), F.explode(F.sequence(
        F.floor(F.col("from") / other_width), F.floor(F.col("to") / other_width))).alias("cell2"))
    later = listed.filter((F.col("step") > 0) | (F.col("cell2") > F.col("cell"))).drop("step")
    second = anchors.select("name", F.col("band").alias("band2"), F.col("cell").alias("cell2"), F.col("anchor").alias("anchor2"),
                            *[F.col(side).alias(f"{side}2") for side in ("south", "north", "west", "east")], F.col("ends").alias("ends2"))
    (s1, n1, w1, e1), (s2, n2, w2, e2) = _box(), _box(suffix="2")
    apart = _metres_at_least(_gap(s1, n1, s2, n2), _gap(w1, e1, w2, e2), _farthest(s1, n1, s2, n2))
    south, north = F.least(s1, s2), F.greatest(n1, n2)
    whole = _metres_at_most(north - south, F.greatest(e1, e2) - F.least(w1, w2), _nearest(south, north))

    def in_reach(p: Column, q: Column) -> Column:
        mask = (1 << 26) - 1
        d_lat = F.shiftright(p, 26) - F.shiftright(q, 26)
        return _metres_at_most(d_lat, p.bitwiseAND(F.lit(mask)) - q.bitwiseAND(F.lit(mask)), _nearest(south, north)) <= radius_m

    met = later.join(second, ["name", "band2", "cell2"]).filter(apart <= radius_m)
    ends = F.exists("ends", lambda p: F.exists("ends2", lambda q: in_reach(p, q)))
    return met.withColumn("sure", F.when(whole <= radius_m, True).otherwise(ends)).drop("ends", "ends2")


def _facing(pairs: DataFrame, celled: DataFrame, radius_m: float) -> DataFrame:
    """``anchor, anchor2`` and two positions, ``lat1`` .. ``lon2``, in reach by a lower bound: what is left to be measured.

    Of an outline only the positions within the radius of the other cell's box are paired, so a pair of
    cells costs what lies along their near edges, not the product of their outlines.
    """
    def facing(cell: list[str], lat: str, lon: str, suffix: str) -> DataFrame:
        south, north, west, east = _box(suffix=suffix)
        at = F.col(lat), F.col(lon)
        apart = _metres_at_least(_gap(at[0], at[0], south, north), _gap(at[1], at[1], west, east), _farthest(at[0], south, north))
        points = outline.select("name", F.col("band").alias(cell[1]), F.col("cell").alias(cell[2]), F.col("lat_e5").alias(lat), F.col("lon_e5").alias(lon))
        return pairs.join(points, cell).filter(apart <= radius_m).select("anchor", "anchor2", lat, lon)

    wanted = pairs.select(*_CELL).unionByName(pairs.select("name", F.col("band2").alias("band"), F.col("cell2").alias("cell"))).distinct()
    outline = materialised(_outline(celled.join(wanted, _CELL, "left_semi")), "outlines")
    left = materialised(facing(_CELL, "lat1", "lon1", "2"), "facing")
    right = materialised(facing(["name", "band2", "cell2"], "lat2", "lon2", ""), "facing")
    apart = _metres_at_least(F.abs(F.col("lat1") - F.col("lat2")), F.abs(F.col("lon1") - F.col("lon2")), _farthest(F.col("lat1"), F.col("lat2")))
    return left.join(right, ["anchor", "anchor2"]).filter(apart <= radius_m)


def _cell_links(celled: DataFrame, anchors: DataFrame, radius_m: float) -> DataFrame:
    """One link per pair of neighbouring cells of a name whose nearest points are in reach."""
    pairs = materialised(_neighbour_cells(anchors, radius_m), "cell-pairs")
    close = _facing(pairs.filter("NOT sure"), celled, radius_m)
    metres = geo.geodesic_m(F.col("lat1") / 1e5, F.col("lon1") / 1e5, F.col("lat2") / 1e5, F.col("lon2") / 1e5)
    measured = (close.filter(metres <= radius_m).select("anchor", "anchor2").distinct())
    linked = pairs.filter("sure").select("anchor", "anchor2").unionByName(measured)
    return linked.select(F.lit("cell").alias("link"), F.least("anchor", "anchor2").alias("left_id"),
                         F.greatest("anchor", "anchor2").alias("right_id"))


def clusters(places: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """``place_id, cluster``: smallest id of the chain of same-name neighbours.

    Chains are followed between cells only; the places of a cell take its label.
    """
    celled, anchors = _cells(places, radius_m)
    links = _cell_links(celled, anchors.drop("n"), radius_m).select("left_id", "right_id")
    labels = min_labels(links).select(F.col("node").alias("anchor"), "label")
    linked = anchors.join(labels, "anchor", "left").filter("n > 1 OR label IS NOT NULL")
    labelled = linked.select(*_CELL, "n", F.coalesce("label", "anchor").alias("cluster"))
    return join_groups(celled, labelled, _CELL, "n").select("place_id", "cluster")


def doomed_places(places: DataFrame, labels: DataFrame) -> DataFrame:
    """All but the best (rank, kind, id) place of each cluster.

    The best is found by a grouping with partial aggregation, not a window.
    """
    clustered = labels.join(places.select("place_id", "rank", "kind"), "place_id")
    best = sized(clustered, ["cluster"], "n", F.min(F.struct("rank", "kind", "place_id")).alias("best"))
    kept = best.select("cluster", "n", F.col("best.place_id").alias("kept_id"))
    return (join_groups(clustered, kept, ["cluster"], "n").filter("place_id <> kept_id")
            .select("place_id", "cluster", "kept_id"))


def without(rows: DataFrame, doomed: DataFrame, key: str = "place_id") -> DataFrame:
    return rows.join(doomed.select(key), key, "left_anti")


def build_summary(kept: DataFrame, aliases: DataFrame, doomed: DataFrame) -> DataFrame:
    """Key/value summary of a build."""

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    country = F.col("country")
    counted = kept.agg(F.count("*").alias("n"), F.count(F.when(country == fixed.SWEDEN, 1)).alias("se"),
                       F.count(F.when(country == fixed.NORWAY, 1)).alias("no"))
    rows = counted.select(F.inline(F.array(
        entry("places", F.col("n")), entry("places_se", F.col("se")), entry("places_no", F.col("no")),
        entry("coord_scale", F.lit(fixed.COORD_SCALE).cast("long")))))
    n_aliases = aliases.agg(F.count("*").alias("value"))
    n_names = n_aliases.unionByName(counted.select(F.col("n").alias("value"))).agg(F.sum("value").alias("value"))
    removed = doomed.agg(F.count("*").alias("value"))
    for key, part in (("aliases", n_aliases), ("names", n_names), ("removed", removed)):
        rows = rows.unionByName(part.select(F.lit(key).alias("key"), "value"))
    return rows
