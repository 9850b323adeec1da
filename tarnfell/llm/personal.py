"""Personal data in notes: patterns propose, checksums confirm, context decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfell.llm.common import numbered, text_of

# Patterns. Each starts only where its run of characters starts (or where the
# last match ended), and its loops never give back: the matches are those of
# the plain pattern, in time linear in the text.
_LOCAL = "A-Za-z0-9._%+-"
#: Countries by the length of their account numbers (the IBAN registry, and the countries that use such numbers without being in it).
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """An account number as long as its country has it; of a country without a known length, as long as it goes."""
    known = "|".join(c for names in _IBAN_COUNTRIES.values() for c in names.split())
    each = [rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for n, names in _IBAN_COUNTRIES.items()]
    each.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{11,30}}+")
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(each)})(?![A-Za-z0-9])"


PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban(),
    "personal_number": r"(?<![0-9])[0-9]{6}[+-]?+[0-9]{4}(?![0-9])",
}
#: Kinds in the order of the report; the first four are kept whenever their checks pass.
KINDS = list(PATTERNS)
BASE = ("email", "ip", "card", "phone")
# What must occur in a text before its pattern is tried.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}",
          "personal_number": r"[0-9]{6}"}

# Scores: what a confirmed span starts with, what a context word adds, and the bar.
_START = {"iban": 0.6, "personal_number": 0.3}
_CONTEXT = {"iban": r"(?i)\b(iban|account|konto|bank|bic|swift)\b",
            "personal_number": r"(?i)\b(personnummer|fødselsnummer|personal number|ssn|born|født|född)\b"}
_BONUS, _BAR = 0.4, 0.5
#: Characters on either side that count as nearby.
_NEAR = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: from the right every second one doubled, cross sums adding up to tens."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, F.element_at(F.array(*[F.lit(2 * d - 9 if d > 4 else 2 * d) for d in range(10)]), c.cast("int") + 1)
    ).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _mod97(text: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, leaves 1."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0).cast("long"), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("long")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _small(part: Column) -> Column:
    """A run of digits that is at most 255."""
    short = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.char_length(short) <= 3) & (short.try_cast("int") <= 255)


def _confirmed(kind: Column, text: Column) -> Column:
    parts, digits = F.split(text, r"\."), _digits(text)
    n = F.char_length(digits)
    ip = reduce(lambda a, b: a & b, [_small(F.get(parts, i)) for i in range(4)])
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", ip)
            .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15))
            .when(kind == "iban", _mod97(text))
            .when(kind == "personal_number", _luhn(digits)))


def _proposed(notes: DataFrame) -> DataFrame:
    """``id``, ``kind``, ``_no``, ``_match`` with ``_gap``, the text before it since the last match, and ``_after``.

    A text splits at a pattern into one piece more than it has matches, so
    pieces and matches in turn make up the text: positions are running lengths.
    """
    each = []
    for kind, pattern in PATTERNS.items():
        here = notes.filter(F.rlike("_notes", F.lit(_NEEDS[kind]))).select(
            "id", "_row", "_notes", F.regexp_extract_all("_notes", F.lit(pattern), F.lit(0)).alias("_matches"))
        here = here.filter(F.size("_matches") > 0).select(
            "id", "_row", "_matches", F.split("_notes", pattern, -1).alias("_pieces"))
        found = here.select("id", "_row", "_pieces", F.posexplode_outer("_matches").alias("_no", "_match"))
        each.append(found.select("id", "_row", F.lit(kind).alias("kind"), "_no", "_match",
                                 F.get("_pieces", F.col("_no")).alias("_gap"), F.get("_pieces", F.col("_no") + 1).alias("_after")))
    return reduce(DataFrame.unionByName, [e.select(
        "id", "_row", "kind", "_no", "_match", F.char_length("_gap").alias("_skip"), F.char_length("_match").alias("_long"),
        F.concat_ws(" ", F.right("_gap", F.lit(_NEAR)), F.substring("_after", 1, _NEAR)).alias("_around")) for e in each])


def personal_data(pins: DataFrame) -> DataFrame:
    """Spans of personal data in every pin's ``notes``.

    ``pins`` has ``id`` and ``notes`` of saved pins. Kinds, in order: ``email``,
    ``ip`` (four parts of at most 255), ``card`` (16 to 19 digits, Luhn),
    ``phone`` (plus sign, 8 to 15 digits), ``iban`` (as long as its country has
    it, mod-97) and ``personal_number`` (ten digits, Luhn). Patterns propose spans, leftmost
    first and without overlap within a kind; checks confirm them; what fails is
    dropped without another try. Of the last two kinds a span needs a score:
    context words within 40 characters add to it (a personal number without
    one stays below the bar).

    Returns one row per input row: ``id`` and ``spans``, an array of (``kind``,
    ``start``, ``end``) by kind in the order above, then start; code points, end
    exclusive. Null notes are empty notes. Rows that repeat an id stay apart;
    extra columns are not carried; an empty table gives no rows.
    """
    notes = numbered(pins.select("id", text_of("notes").alias("_notes")), "notes")
    upto = Window.partitionBy("_row", "kind").orderBy("_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = _proposed(notes).withColumn("_end", F.sum(F.col("_skip") + F.col("_long")).over(upto))
    spans = spans.filter(_confirmed(F.col("kind"), F.col("_match")))
    context = reduce(lambda a, k: a.when(F.col("kind") == k, F.rlike("_around", F.lit(_CONTEXT[k]))), _CONTEXT, F.when(F.lit(False), F.lit(False)))
    start = reduce(lambda a, k: a.when(F.col("kind") == k, F.lit(_START[k])), _START, F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(1.0))
    score = start + F.when(F.coalesce(context, F.lit(False)), F.lit(_BONUS)).otherwise(F.lit(0.0))
    spans = spans.filter(score >= _BAR)
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    span = F.struct(order.alias("order"), (F.col("_end") - F.col("_long")).cast("long").alias("start"),
                    F.col("_end").cast("long").alias("end"), "kind")
    found = spans.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    kept = F.transform("_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return notes.select("id", "_row").join(found, "_row", "left").select("id", F.coalesce(kept, none).alias("spans"))
