"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnfell.functions import fixed
from tarnfell.operators import audit as ops
from tarnfell.plans.registry import query
from tarnfell.sources.tables import table
from tarnfell.sources.views import cte, view

_FIELDS = fixed.REQUIRED_FIELDS + ["release_notes"]
_FIELD_CASE = "CASE (doc_id * 7) % 9 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FIELDS)) + " ELSE 'other' END"
_METADATA = f"""SELECT concat(lang, '-', CAST(doc_id % 50 AS VARCHAR(20))) AS locale, {_FIELD_CASE} AS field,
    max(CASE WHEN doc_id % 13 = 0 THEN ' \t ' WHEN doc_id % 4 = 0 THEN concat('  ', source, ' ') ELSE concat(' ', text) END) AS value FROM {{documents}} GROUP BY 1, 2"""
_TRIM = "trim(value, concat(' ', chr(9), chr(10), chr(13), chr(12), chr(11)))"
SQL_META = f"meta AS ({_METADATA.format(documents='documents')})"
_LIMIT = "CASE field " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in fixed.FIELD_LIMITS.items()) + " END"


def metadata(spark, sf):
    return spark.sql(_METADATA, documents=table(spark, sf, "documents"))


@query("Q1_field_problems", f"""WITH {SQL_META}, wanted AS (SELECT locale, unnest({fixed.REQUIRED_FIELDS}) AS field FROM (SELECT DISTINCT locale FROM meta)
    UNION ALL SELECT locale, field FROM meta WHERE field = 'release_notes'),
  checked AS (SELECT w.locale, w.field, value, {_TRIM} AS v FROM wanted w LEFT JOIN meta m ON m.locale = w.locale AND m.field = w.field)
  SELECT locale, field, 'missing' AS problem FROM checked WHERE value IS NULL UNION ALL SELECT locale, field, 'empty' FROM checked WHERE v = '' AND field <> 'release_notes'
  UNION ALL SELECT locale, field, 'too long' FROM checked WHERE length(v) > {_LIMIT} UNION ALL SELECT locale, field, 'separator' FROM checked WHERE field = 'keywords' AND contains(v, ', ')""")
def q1(spark, sf):
    return ops.field_problems(metadata(spark, sf))


@query("Q2_inconsistent_fields", f"WITH {SQL_META} SELECT field, count(DISTINCT {_TRIM}) AS n_values FROM meta WHERE field LIKE '%\\_url' ESCAPE '\\' GROUP BY field HAVING count(DISTINCT {_TRIM}) > 1")
def q2(spark, sf):
    return ops.inconsistent_fields(metadata(spark, sf))


_EXPECTED = """SELECT lang AS locale, source AS display_type, concat('shot', CAST(doc_id AS VARCHAR(20))) AS name, md5(text) AS checksum, n_chars AS size FROM {documents} WHERE doc_id % 12 <> 0"""
_ACTUAL = """SELECT d.lang AS locale, d.source AS display_type, concat('shot', CAST(d.doc_id AS VARCHAR(20))) AS name, d.doc_id * 10 + d.k AS copy_id,
    CASE (d.doc_id + d.k) % 4 WHEN 0 THEN md5(d.text) WHEN 1 THEN NULL WHEN 2 THEN 'other' ELSE NULL END AS checksum,
    CASE WHEN (d.doc_id + d.k) % 8 = 1 THEN d.n_chars ELSE d.n_chars + 1 END AS size
  FROM {copies} d WHERE d.doc_id % 10 <> 0 AND d.k <= d.doc_id % 3"""


@query("Q3_reconciled_inventory", f"""WITH e AS ({_EXPECTED.format(documents='documents')}), a AS ({_ACTUAL.format(copies='(SELECT *, unnest(range(0, 3)) AS k FROM documents)')}),
  ranked AS (SELECT a.*, e.checksum AS want, e.size AS want_size, count(*) OVER w AS copies, row_number() OVER (PARTITION BY a.locale, a.display_type, a.name
      ORDER BY CASE WHEN a.checksum = e.checksum THEN 0 WHEN a.checksum IS NULL AND a.size = e.size THEN 1 ELSE 2 END, copy_id) AS rn
    FROM a LEFT JOIN e ON e.locale = a.locale AND e.display_type = a.display_type AND e.name = a.name WINDOW w AS (PARTITION BY a.locale, a.display_type, a.name))
  SELECT locale, display_type, name, copy_id AS kept_copy, copies - 1 AS duplicates, CASE WHEN want IS NULL THEN 'unexpected' WHEN checksum = want THEN 'ok'
    WHEN checksum IS NOT NULL THEN 'stale' WHEN size <> want_size THEN 'unsettled' ELSE 'ok' END AS state FROM ranked WHERE rn = 1
  UNION ALL SELECT locale, display_type, name, NULL, 0, 'missing' FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.locale = e.locale AND a.display_type = e.display_type AND a.name = e.name)""")
def q3(spark, sf):
    documents = table(spark, sf, "documents")
    copies = documents.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return ops.reconciled(spark.sql(_EXPECTED, documents=documents), spark.sql(_ACTUAL, copies=copies), ["locale", "display_type"])


LANGUAGES = ["de", "en", "es", "fr", "nb", "sv"]


@query("U3_expected_minus_actual", cte("strings") + f"""SELECT str_key, lang FROM (SELECT str_key, unnest({LANGUAGES}) AS lang FROM (SELECT DISTINCT str_key FROM fx_strings))
  EXCEPT SELECT str_key, lang FROM fx_strings""")
def u3(spark, sf):
    strings = view(spark, sf, "strings")
    return ops.expected_minus_actual(strings, LANGUAGES, strings)


@query("Q4_translation_problems", cte("strings") + f""", s AS (SELECT str_key, lang, CASE WHEN length(value) % 9 = 0 THEN str_key WHEN length(value) % 2 = 0 THEN concat(lang, '-', str_key) ELSE value END AS value FROM fx_strings
    WHERE NOT ends_with(str_key, '7'))
  SELECT str_key, lang, 'missing' AS problem FROM (SELECT str_key, unnest({LANGUAGES}) AS lang FROM (SELECT DISTINCT str_key FROM s)) w
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.str_key = w.str_key AND s.lang = w.lang)
  UNION ALL SELECT str_key, lang, 'same as key' FROM s WHERE value = str_key UNION ALL SELECT str_key, lang, 'too long' FROM s WHERE ends_with(str_key, '3') AND length(value) > 12""")
def q4(spark, sf):
    strings = view(spark, sf, "strings").selectExpr(
        "str_key", "lang", "CASE WHEN length(value) % 9 = 0 THEN str_key WHEN length(value) % 2 = 0 THEN concat(lang, '-', str_key) ELSE value END AS value")
    key = F.col("str_key")
    return ops.translation_problems(strings, LANGUAGES, key.endswith("7"), key.endswith("3"))
