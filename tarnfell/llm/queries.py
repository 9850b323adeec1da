"""The registered queries: thin steps between the given tables and the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.llm import (
    alignment, collocations, decontamination, fingerprints, licences, lines, mixing, pages, personal, quality, repeats, sharding, simhash)
from tarnfell.plans.registry import Plan
from tarnfell.session import pin_utc
from tarnfell.sources.tables import table


def pins(documents: DataFrame) -> DataFrame:
    """Documents as saved pins with notes."""
    return documents.select(F.col("doc_id").alias("id"), F.col("text").alias("notes"))


def _hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(pins(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents, weighted by source, takes of each document."""
    strings = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.col("source").alias("locale"), F.col("text").alias("value"))
    return mixing.mixed(strings).select(F.col("key").alias("doc_id"), "size", F.col("locale_size").alias("source_size"), "target", "taken")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = personal.personal_data(pins(table(spark, sf_dir, "documents")))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count_of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*personal.BASE))
    return found.select(F.col("id").alias("doc_id"), *[count_of(k) for k in personal.BASE], _hex(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes that occur more than once."""
    kept = repeats.without_repeats(pins(table(spark, sf_dir, "documents")))
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, exactly or nearly."""
    kept = lines.deduplicated_lines(pins(table(spark, sf_dir, "documents")))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.col("notes").alias("text"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = pages.page_texts(table(spark, sf_dir, "pages").withColumnRenamed("page_id", "path").select("path", "url", "html"))
    return found.select(F.col("path").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licences.licences_found(pins(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of nearly equal documents."""
    found = simhash.near_pins(pins(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside passages of benchmark items."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("value"))
    found = decontamination.repeated_passages(pins(table(spark, sf_dir, "documents")), items)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                        _hex(F.array_join("items", ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def training_ratings(labels: DataFrame) -> DataFrame:
    """Labels that aren't held out, as ratings of pins."""
    return labels.filter(~_held_out("doc_id")).select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that aren't held out."""
    ratings = training_ratings(table(spark, sf_dir, "labels"))
    scored = quality.note_quality(pins(table(spark, sf_dir, "documents")), ratings)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(_held_out("id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes, equal texts together: documents as tiles of an offline store."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tiles = table(spark, sf_dir, "documents").select(
        F.lit(0).alias("server"), F.lit(0).alias("z"), F.col("doc_id").alias("x"), F.lit(0).alias("y"), text.alias("data"), F.crc32(text).alias("text_crc32"))
    found = sharding.equal_archives(tiles, 8, keep=["text_crc32"])
    return found.select(F.col("x").alias("doc_id"), F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                        F.col("archive").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token groups and links of every document between two vocabularies."""
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(_hex(F.col("groups")))
    found = alignment.aligned_notes(pins(table(spark, sf_dir, "documents")), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model",
                                    shown={"groups_sha256": digest})
    return found.withColumnRenamed("id", "doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language whose words attract each other most."""
    strings = table(spark, sf_dir, "documents").select(F.col("lang").alias("locale"), F.col("text").alias("value"))
    return collocations.collocations(strings).withColumnRenamed("locale", "lang")


PLANS: dict[str, Plan] = {p.__name__: p for p in (
    op1_fingerprints, op2_source_mix, op3_personal_data, op4_repeated_bytes, op5_line_dedup, op6_page_text, op7_license_scan, op8_simhash_groups, op9_benchmark_overlap, op10_quality,
    op11_archives, op12_token_alignment, op13_collocations)}
_OP13 = """WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
  lists AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
  phrases AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (
    SELECT lang, list_slice(ws, i, i + k - 1) AS p FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists), range(1, 6) AS t(k)
    WHERE i + k - 1 <= len(ws)) GROUP BY 1, 2 HAVING count(*) >= 100),
  totals AS (SELECT lang, sum(len(ws)) AS n FROM lists GROUP BY 1),
  cuts AS (SELECT a.lang, a.p, a.f AS a, k, l.f AS l, r.f AS r, n, (1000 * a.f::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
    FROM phrases a JOIN totals USING (lang), range(1, 5) AS t(k), phrases l, phrases r
    WHERE k < len(a.p) AND l.lang = a.lang AND l.p = a.p[1:k] AND r.lang = a.lang AND r.p = a.p[k + 1:len(a.p)]),
  scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
  inner_parts AS (SELECT lang, f, list_slice(p, i, i + k - 1) AS p FROM phrases, range(2, 5) AS t(k), range(1, 5) AS u(i)
    WHERE k < len(p) AND i + k - 1 <= len(p)),
  covered AS (SELECT lang, p, max(f) AS longer FROM inner_parts GROUP BY 1, 2),
  kept AS (SELECT s.*, array_to_string(s.p, ' ') AS phrase FROM scored s LEFT JOIN covered c ON c.lang = s.lang AND c.p = s.p
    WHERE c.longer IS NULL OR 100 * c.longer < 100 * s.a)
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
  FROM kept QUALIFY rank <= 2000"""
_OP9 = """WITH own AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
  theirs AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
  windows AS MATERIALIZED (SELECT DISTINCT item, k, ws[i:i + k - 1] AS w FROM (
    SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM theirs WHERE len(ws) > 0)),
  hits AS MATERIALIZED (SELECT r, i, k, item FROM (SELECT r, k, i, ws[i:i + k - 1] AS w FROM (
    SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM own, (SELECT DISTINCT k FROM windows))) JOIN windows USING (k, w)),
  covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
  named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM own LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
#: Seeded hashes, floating-point training, clustering, tokenizers and bin packing have no SQL form in the oracle's dialect.
ORACLES: dict[str, str] = {"op9_benchmark_overlap": _OP9, "op13_collocations": _OP13}


def queries() -> dict[str, Plan]:
    """Every query of this subpackage by name, with the session's time zone pinned as for all plans."""

    def pinned(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_utc(spark)
            return plan(spark, sf_dir)

        run.__name__, run.__doc__ = plan.__name__, plan.__doc__
        return run

    return {name: pinned(plan) for name, plan in PLANS.items()}
