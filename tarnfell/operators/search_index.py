"""A stored search index: a pruned prefix dictionary with the best places at each prefix.

Three tables are written below one path and searched from there:

* ``heads``: every *frequent* prefix (more than ``cap`` names have a term that
  starts with it) with its best ``depth`` places by static score, over all names
  and, as rows of their own, over the names of one length. A one-word query reads two rows.
* ``leaves``: every name under the shortest prefix of a term that isn't
  frequent, ``cap`` names at most. A query with such a token reads one of them.
* ``names``: the names that a result can show (of those alike, the same terms and length, the best ``depth`` places
  and one more) in three bands of rising static score, the best 64th, the rest of the best eighth, and all others. Only queries whose tokens are all frequent read it, band after band
  until the places found can't be beaten any more.

So a query reads a bounded number of rows from ``heads`` and ``leaves``, and from
``names`` as many as it takes. A score is the static score, plus a fixed step
unless name and query have the same length: the best places of a prefix
are among its best by static score and its best of the query's length.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.functions import fixed, text
from tarnfell.operators import search
from tarnfell.session import materialised, scratch_path, spread

#: Names of any length, as a length.
_ANY = 0
#: Folders by which ``heads`` and ``leaves`` are pruned.
_FOLDERS = 32
#: Halves of a score point that a name of another length costs.
_OTHER_LENGTH = 200
#: Shares of the names at which bands end.
_BANDS = (1 / 64, 1 / 8)
_KEY_CHARS = 3


_NAME = "owner_id bigint, place_id bigint, n_chars int, static bigint, terms array<string>"
_SCHEMAS = {
    "heads": "prefix string, length int, best array<struct<static: bigint, place_id: bigint, owner_id: bigint, terms: array<string>>>, "
             "total bigint, places bigint, folder int",
    "leaves": f"{_NAME}, prefix string, folder int", "names": f"{_NAME}, keys array<string>, band int"}


class Index(NamedTuple):
    heads: DataFrame
    leaves: DataFrame
    names: DataFrame
    depth: int


def _folder(prefix: Column) -> Column:
    return F.pmod(F.hash(prefix), F.lit(_FOLDERS))


def _prefixes(term: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(term)), lambda n: F.substring(term, F.lit(1), n))


def entries(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every name with what a score needs: ``owner_id``, ``place_id``, ``n_chars``, ``static`` (halves of points) and ``terms``."""
    shown = places.select("place_id", "rank", "kind")
    spelled = (places.select(F.col("place_id").alias("owner_id"), "place_id", "name", F.lit(0).alias("_alias"))
               .unionByName(aliases.select(F.col("alias_id").alias("owner_id"), "place_id", "name", F.lit(1).alias("_alias"))))
    demotion = F.coalesce(fixed.lookup(F.col("kind"), fixed.KIND_DEMOTION), F.lit(0.0))
    static = (F.col("rank") * 5 + demotion + F.col("_alias") * 2.0) * 2
    return spelled.join(shown, "place_id").select(
        "owner_id", "place_id", F.length("name").alias("n_chars"), static.cast("long").alias("static"),
        F.array_distinct(text.tokens(F.col("name"))).alias("terms")).filter(F.size("terms") > 0)


def _worded(names: DataFrame) -> DataFrame:
    """``names`` with ``words`` and ``n_chars`` as what makes names alike: they are under the same prefixes."""
    return names.withColumn("words", F.concat_ws(" ", "terms"))


_ALIKE = ["words", "n_chars"]


def _alike(names: DataFrame) -> DataFrame:
    """``words``, ``n_chars``, ``terms`` and the number ``n`` of names that are alike: only these multiply into prefixes."""
    counted = _worded(names).groupBy(*_ALIKE).agg(F.count("*").alias("n"))
    return counted.withColumn("terms", F.split("words", " "))


def _offered(alike: DataFrame) -> DataFrame:
    """Each row under each prefix of its terms, once; dealt out before rows multiply."""
    return spread(alike, *_ALIKE).select("*", F.explode(F.array_distinct(F.flatten(F.transform("terms", _prefixes)))).alias("prefix"))


def _best_alike(names: DataFrame, depth: int) -> DataFrame:
    """Of names that are alike, the best of each place, of the first ``depth`` places and one more: ``words``, ``n_chars``, ``place_id``, ``hit``.

    They match the same queries with the same step to their static score, so no other can be among the
    first ``depth`` results of any query. With the one more, a list is known to have passed ``depth``.
    """
    hits = _worded(names).groupBy(*_ALIKE, "place_id").agg(F.min(F.struct("static", "owner_id")).alias("hit"))
    first = Window.partitionBy(*_ALIKE).orderBy("hit.static", "place_id")
    return hits.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= depth + 1).drop("_at")


def _heads(few: DataFrame, offered: DataFrame, frequent: DataFrame, depth: int) -> DataFrame:
    """Best places of each frequent prefix, over all names and by length of name; ``places``, their number, is exact up to ``depth``."""
    def listed(rows: DataFrame) -> DataFrame:
        return rows.join(frequent, "prefix").withColumn("length", F.explode(F.array(F.lit(_ANY), "n_chars")))

    under = listed(offered).select("prefix", "length", *_ALIKE, "n")
    sizes = under.groupBy("prefix", "length").agg(F.sum("n").alias("total"))
    best = under.drop("n").join(few, _ALIKE).groupBy("prefix", "length", "place_id").agg(
        F.min(F.struct("hit.static", "hit.owner_id", "words")).alias("hit"))
    order = Window.partitionBy("prefix", "length").orderBy("hit.static", "place_id")
    top = best.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= depth + 1)
    top = top.select("prefix", "length", "place_id", "_at", "hit.static", "hit.owner_id", F.split("hit.words", " ").alias("terms"))
    shown = F.when(F.col("_at") <= depth, F.struct("static", "place_id", "owner_id", "terms"))
    lists = top.groupBy("prefix", "length").agg(F.collect_list(shown).alias("best"), F.count("*").alias("places"))
    return lists.join(sizes, ["prefix", "length"]).select("prefix", "length", "best", "total", "places")


def build(places: DataFrame, aliases: DataFrame, path: str | None = None, depth: int = fixed.RESULT_LIMIT, cap: int = 256) -> Index:
    """Write the index of all names below ``path`` (a fresh one in the shared folder by default) and open it.

    ``depth`` is the most results that a search can ask for; ``cap`` bounds the names of a leaf.
    """
    spark = places.sparkSession
    path = path or scratch_path(spark, "search-index")
    names = materialised(entries(places, aliases), "search-names")
    offered = materialised(_offered(_alike(names)), "search-offered")
    frequent = materialised(offered.groupBy("prefix").agg(F.sum("n").alias("_n")).filter(F.col("_n") > cap).select("prefix"), "search-frequent")
    few = materialised(_best_alike(names, depth), "search-alike")
    heads = _heads(few, offered, frequent, depth).withColumn("folder", _folder(F.col("prefix")))
    heads.repartition("folder").write.partitionBy("folder").parquet(f"{path}/heads")

    # A prefix is a leaf if it isn't frequent but the one before it is (or it has one character).
    rare = offered.join(frequent, "prefix", "left_anti")
    before = frequent.select(F.col("prefix").alias("_before"))
    rare = rare.withColumn("_before", F.expr("left(prefix, length(prefix) - 1)"))
    leaves = rare.filter(F.length("prefix") == 1).unionByName(rare.join(before, "_before", "left_semi").filter(F.length("prefix") > 1).select(*rare.columns))
    # A leaf has ``cap`` names at most, and so has each of its groups of names that are alike.
    leaves = _worded(names).join(leaves.select("prefix", *_ALIKE), _ALIKE).select(
        "owner_id", "place_id", "n_chars", "static", "terms", "prefix").withColumn("folder", _folder(F.col("prefix")))
    leaves.repartition("folder").write.partitionBy("folder").parquet(f"{path}/leaves")

    shown = few.select("hit.owner_id", "place_id", "n_chars", "hit.static", F.split("words", " ").alias("terms"))
    # Static scores are few, and so are the rows of this window.
    scores = shown.groupBy("static").agg(F.count("*").alias("_n"))
    run = Window.orderBy("static").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.sum("_n").over(run), F.lit(0)) / F.sum("_n").over(Window.partitionBy(F.lit(0)))
    steps = [F.when(part >= share, 1).otherwise(0) for share in _BANDS]
    bands = scores.select("static", sum(steps[1:], steps[0]).alias("band"))
    keys = F.array_distinct(F.flatten(F.transform("terms", lambda t: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(_KEY_CHARS), F.length(t))), lambda n: F.substring(t, F.lit(1), n)))))
    banded = shown.join(F.broadcast(bands), "static").withColumn("keys", keys)
    banded.repartition("band", F.pmod(F.hash("owner_id"), F.lit(8))).write.partitionBy("band").parquet(f"{path}/names")
    spark.createDataFrame([(depth,)], "depth int").coalesce(1).write.parquet(f"{path}/about")  # last: without it the index is not whole
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """An index written by ``build``."""
    depth = spark.read.parquet(f"{path}/about").first()[0]
    return Index(*[spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _SCHEMAS.items()], depth)


def _all_match() -> Column:
    return F.forall("tokens", lambda p: F.exists("terms", lambda t: t.startswith(p)))


def _score() -> Column:
    return F.col("static") + F.when(F.col("n_chars") == F.col("needle"), 0).otherwise(_OTHER_LENGTH)


_FOUND = ["query_id", "place_id", "owner_id", "score"]


def _of_heads(known: DataFrame) -> DataFrame:
    """Hits among the lists of a frequent prefix; ``best`` is that over all names or over those of the needle's length."""
    each = known.select("query_id", "tokens", "needle", "length", F.explode("best").alias("hit"))
    each = each.select("query_id", "tokens", "hit.*", (F.col("hit.static") + F.when(F.col("length") == F.col("needle"), 0).otherwise(_OTHER_LENGTH)).alias("score"))
    return each.filter(_all_match()).select(*_FOUND)


def _in_band(index: Index, band: int) -> DataFrame:
    return index.names.filter(F.col("band") == band)


def _by_bands(index: Index, queries: DataFrame, limit: int) -> list[DataFrame]:
    """Hits of queries whose tokens are all frequent, band by band.

    ``queries`` has ``tokens``, ``needle``, ``key`` and ``exact_open``: whether names of the needle's length
    may be found here only. A query leaves when ``limit`` places are found that later bands can't beat:
    of its own length, or of any length once those of its length are settled.
    """
    found: list[DataFrame] = []
    pending = queries.withColumn("open", F.lit(True))
    for band in range(len(_BANDS) + 1):
        names = _in_band(index, band).select("owner_id", "place_id", "n_chars", "static", "terms", F.explode("keys").alias("key"))
        met = pending.join(names, "key").filter(_all_match() & (F.col("open") | (F.col("n_chars") == F.col("needle"))))
        met = met.groupBy("query_id", "place_id").agg(F.min(F.struct(_score().alias("score"), "owner_id")).alias("hit"))
        found.append(materialised(met.select("query_id", "place_id", "hit.owner_id", "hit.score"), "search-hits"))
        if band == len(_BANDS):
            break
        best = _together(found).groupBy("query_id", "place_id").agg(F.min("score").alias("score"), F.max(F.col("score") < _OTHER_LENGTH).alias("_same"))
        counts = best.groupBy("query_id").agg(F.count("*").alias("_n"), F.count_if("_same").alias("_exact"))
        left = pending.join(counts, "query_id", "left").withColumns({
            "open": F.coalesce(F.col("_n") < limit, F.lit(True)), "exact_open": F.col("exact_open") & F.coalesce(F.col("_exact") < limit, F.lit(True))})
        pending = materialised(left.filter("open or exact_open").drop("_n", "_exact"), "search-pending")
        if pending.isEmpty():
            break
    return found


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def ranked(index: Index, queries: DataFrame, limit: int = fixed.RESULT_LIMIT) -> DataFrame:
    """The first ``limit`` places of every query by score, then id: ``query_id``, ``place_id``, ``owner_id``, ``score``, ``position``.

    ``queries`` has ``query_id`` and ``text``. The same results as ranking every match.
    """
    if limit > index.depth:
        raise ValueError(f"the index holds {index.depth} places a prefix")
    # Queries that ask the same are looked up once, under their question.
    wanted = search.asked(queries)
    asked = search.questions(wanted).select(F.col("question").alias("query_id"), "tokens", "needle")
    each = asked.select("query_id", "tokens", "needle", F.explode("tokens").alias("prefix"))
    met = each.join(index.heads.drop("folder"), "prefix").filter((F.col("length") == _ANY) | (F.col("length") == F.col("needle")))
    met = materialised(met, "search-heads")
    frequent = met.filter(F.col("length") == _ANY).groupBy("query_id").agg(
        F.count("*").alias("_frequent"), F.min_by("prefix", F.struct("total", "prefix")).alias("_rarest"))
    planned = materialised(asked.join(frequent, "query_id", "left").select(
        "*", (F.size("tokens") == 1).alias("_single"), F.coalesce(F.col("_frequent") == F.size("tokens"), F.lit(False)).alias("_all")), "search-planned")

    single = met.join(planned.filter("_all and _single").select("query_id"), "query_id", "left_semi")
    rare = planned.filter("not _all").select("query_id", "tokens", "needle", F.explode(
        F.array_distinct(F.flatten(F.transform("tokens", _prefixes)))).alias("prefix"))
    # A leaf may be met by several tokens of a query; the same name is then found twice.
    leaf = rare.join(index.leaves.drop("folder"), "prefix").filter(_all_match()).select("query_id", "place_id", "owner_id", _score().alias("score"))

    same_length = met.filter(F.col("length") == F.col("needle")).select("query_id", F.col("prefix").alias("_rarest"), "places")
    several = planned.filter("_all and not _single").join(same_length, ["query_id", "_rarest"], "left").select(
        "query_id", "tokens", "needle", F.substring("_rarest", 1, _KEY_CHARS).alias("key"), "_rarest",
        F.coalesce(F.col("places") > index.depth, F.lit(False)).alias("exact_open"))
    whole_lists = several.filter(~F.col("exact_open")).select("query_id", F.col("_rarest").alias("prefix"))
    exact = met.filter(F.col("length") == F.col("needle")).join(whole_lists, ["query_id", "prefix"], "left_semi")
    hits = _together([_of_heads(single), leaf, _of_heads(exact), *_by_bands(index, several.drop("_rarest"), limit)])
    best = hits.groupBy("query_id", "place_id").agg(F.min(F.struct("score", "owner_id")).alias("hit"))
    best = best.select("query_id", "place_id", "hit.owner_id", (F.col("hit.score") / 2).alias("score"))
    return search.for_queries(search.top_results(best, limit).withColumnRenamed("query_id", "question"), wanted)


def _best(rows: DataFrame, limit: int) -> list[tuple[int, int, int]]:
    """(score, place, owner) of the best places of one query."""
    best = rows.groupBy("place_id").agg(F.min(F.struct("score", "owner_id")).alias("hit"))
    return [tuple(r) for r in best.select("hit.score", "place_id", "hit.owner_id").orderBy("score", "place_id").limit(limit).collect()]


def _merged(parts: list[list[tuple[int, int, int]]], limit: int) -> list[tuple[int, int, int]]:
    best: dict[int, tuple[int, int]] = {}
    for score, place, owner in (hit for part in parts for hit in part):
        best[place] = min(best.get(place, (score, owner)), (score, owner))
    return sorted((score, place, owner) for place, (score, owner) in best.items())[:limit]


def lookup(index: Index, words: str, limit: int = fixed.RESULT_LIMIT) -> list[tuple[float, int, int]]:
    """One query at once: (score, place_id, owner_id), best first. The results of ``ranked``.

    The query's tokens are known before anything is read, so only the folders of their
    prefixes are opened, and at most ``depth`` places are fetched for each list.
    """
    if limit > index.depth:
        raise ValueError(f"the index holds {index.depth} places a prefix")
    spark = index.heads.sparkSession
    # A row without a table is folded while planning: no job runs for it.
    one = spark.sql("SELECT :words AS text", args={"words": words}).select(F.array_distinct(text.tokens(F.col("text"))).alias("tokens"),
                                                                   text.composed_length(F.col("text")).alias("needle"))
    one = one.select("*", F.transform("tokens", _folder).alias("folders"), F.transform("tokens", lambda t: F.transform(_prefixes(t), _folder)).alias("leaf_folders"))
    tokens, needle, folders, leaf_folders = one.first()
    if not tokens:
        return []
    given = F.array(*[F.lit(t) for t in tokens])
    score = F.col("static") + F.when(F.col("n_chars") == needle, 0).otherwise(_OTHER_LENGTH)

    def matching(rows: DataFrame) -> DataFrame:
        return rows.withColumn("tokens", given).filter(_all_match()).select("place_id", "owner_id", score.alias("score"))

    lists = index.heads.filter(F.col("folder").isin(folders) & F.col("prefix").isin(tokens) & F.col("length").isin(_ANY, needle)).collect()
    totals = {r.prefix: r.total for r in lists if r.length == _ANY}

    def listed(prefix: str, length: int) -> list[tuple[int, int, int]]:
        extra = 0 if length == needle else _OTHER_LENGTH
        return [(h.static + extra, h.place_id, h.owner_id) for r in lists if (r.prefix, r.length) == (prefix, length) for h in r.best
                if all(any(t.startswith(p) for t in h.terms) for p in tokens)]

    missing = [i for i, t in enumerate(tokens) if t not in totals]
    if missing:
        i = max(missing, key=lambda k: len(tokens[k]))
        prefixes = [tokens[i][:n] for n in range(1, len(tokens[i]) + 1)]
        hits = [_best(matching(index.leaves.filter(F.col("folder").isin(leaf_folders[i]) & F.col("prefix").isin(prefixes))), limit)]
    elif len(tokens) == 1:
        hits = [listed(tokens[0], _ANY), listed(tokens[0], needle)]
    else:
        rarest = min(tokens, key=lambda t: (totals[t], t))
        hits = [listed(rarest, needle)]
        exact_open = any(r.prefix == rarest and r.length == needle and r.places > index.depth for r in lists)
        is_open = True
        for band in range(len(_BANDS) + 1):
            rows = _in_band(index, band)
            hits.append(_best(matching(rows if is_open else rows.filter(F.col("n_chars") == needle)), limit))
            so_far = _merged(hits, limit)
            is_open = len(so_far) < limit
            exact_open = exact_open and sum(h[0] < _OTHER_LENGTH for h in so_far) < limit
            if not (is_open or exact_open):
                break
    return [(score / 2, place, owner) for score, place, owner in _merged(hits, limit)]


def find(index: Index, queries: DataFrame, places: DataFrame, aliases: DataFrame, municipalities: DataFrame,
         limit: int = fixed.RESULT_LIMIT) -> DataFrame:
    """The whole search from a stored index: as ``search.search`` without a scan cap."""
    top = ranked(index, queries, limit)
    spelled = aliases.select(F.col("alias_id").alias("owner_id"), F.col("name").alias("matched"))
    matched = top.join(spelled, "owner_id", "left").withColumn("is_primary", F.col("matched").isNull())
    return search.hydrated(matched, places, municipalities)
