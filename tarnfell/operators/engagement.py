"""App engagement: debounced edits, app opens, prompt eligibility and throttling.

Events of one user may be a third of the log, so everything ordered runs on
``operators.ordered`` (chunks of a user's timeline) and nothing gathers a user.
``events(user_id, event_id, ts, kind, meters, app_version)``, ordered by
``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.functions import fixed
from tarnfell.operators.chains import followed
from tarnfell.operators.ordered import counted_chunks, next_value, previous_value, running_totals
from tarnfell.operators.skew import join_groups, sized

ORDER = ["us", "event_id"]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def timed(events: DataFrame) -> DataFrame:
    """Events with ``us`` and ``_chunk``, a stretch of a user's timeline; given once, they stay."""
    if "_chunk" in events.columns:
        return events
    return counted_chunks(events.withColumn("us", micros(F.col("ts"))).drop("ts"), ["user_id"], ORDER)


def debounced(edits: DataFrame, gap_us: int) -> DataFrame:
    """Edits after which no newer one of the same user arrives within the gap; short texts give nothing.

    ``edits(user_id, event_id, ts, text)``.
    """
    following = next_value(timed(edits), ["user_id"], "_chunk", ORDER, F.col("us"), "_next")
    kept = following.filter(F.col("_next").isNull() | (F.col("_next") - F.col("us") >= gap_us))
    long_enough = F.length(F.trim("text")) >= 2
    return kept.select("user_id", "event_id", F.when(long_enough, F.col("text")).alias("query"))


def app_opens(events: DataFrame, gap_seconds: int = fixed.OPEN_GAP_SECONDS) -> DataFrame:
    """Activation events with whether they count as a new open.

    The first activation counts; a later one counts when the event before it
    is a background event at least the gap ago. Every activation forgets the
    background event, except the very first, which leaves an earlier one in
    place for its successor.
    """
    cycle = timed(events).filter(F.col("kind").isin("active", "background"))
    at = F.struct("us", "event_id")
    firsts = sized(cycle, ["user_id"], "_n", F.min(F.when(F.col("kind") == "active", at)).alias("first"))
    backgrounds = join_groups(cycle, firsts, ["user_id"], "_n").filter((F.col("kind") == "background") & (at < F.col("first")))
    early = backgrounds.groupBy("user_id").agg(F.max("us").alias("early"))
    marks = firsts.join(early, "user_id", "left")
    prior = previous_value(cycle, ["user_id"], "_chunk", ORDER, F.struct("kind", "us", "event_id"), "prev")
    prior = join_groups(prior.filter("kind = 'active'"), marks, ["user_id"], "_n")
    is_first = at == F.col("first")
    after_first = F.struct("prev.us", "prev.event_id") == F.col("first")
    since = F.when(F.col("prev.kind") == "background", F.col("prev.us")).when(after_first, F.col("early"))
    opened = is_first | F.coalesce(F.col("us") - since >= gap_seconds * 1_000_000, F.lit(False))
    return prior.select("user_id", "event_id", "us", opened.alias("is_open"))


def eligible_moments(events: DataFrame, gap_seconds: int = fixed.OPEN_GAP_SECONDS) -> DataFrame:
    """Success events with the running counters and whether engagement is sufficient."""
    timeline = timed(events)
    opens = app_opens(timeline, gap_seconds).filter("is_open").select("event_id", F.lit(1).alias("_open"))
    flagged = timeline.join(opens, "event_id", "left")
    measured = (F.col("kind") == "measurement") & (F.col("meters") >= fixed.MIN_MEASUREMENT_M)
    downloaded = F.col("kind") == "download_complete"
    relevant = flagged.filter(F.col("_open").isNotNull() | measured | downloaded)
    counted = running_totals(relevant, ["user_id"], "_chunk", ORDER, {
        "opens": F.coalesce("_open", F.lit(0)), "downloads": F.when(downloaded, 1).otherwise(0),
        "measurements": F.when(measured, 1).otherwise(0)})
    enough = (F.col("opens") >= fixed.REQUIRED_OPENS) & (
        (F.col("downloads") >= 1) | (F.col("measurements") >= fixed.REQUIRED_MEASUREMENTS))
    return counted.filter(measured | downloaded).select(
        "user_id", "event_id", "us", "app_version", "opens", "downloads", "measurements", enough.alias("eligible"))


def _first_at_or_after(moments: DataFrame, later: Column, out: str) -> DataFrame:
    """``moments`` with the first moment (``us``, ``event_id``, ``app_version``) of the user at or after the time ``later``.

    Moments and the times asked for are put in one order, in which the next moment is the answer.
    """
    moment = F.struct("us", "event_id", "app_version", "changed")
    asked = moments.select("user_id", later.alias("at"), F.lit(0).alias("kind"), F.col("event_id").alias("no"), F.struct(*moments.columns).alias("row"), F.lit(None).alias("hit"))
    given = moments.select("user_id", F.col("us").alias("at"), F.lit(1).alias("kind"), F.col("event_id").alias("no"), F.lit(None).alias("row"), moment.alias("hit"))
    both = counted_chunks(asked.unionByName(given), ["user_id"], ["at", "kind", "no"])
    found = next_value(both, ["user_id"], "_chunk", ["at", "kind", "no"], F.col("hit"), "_hit", skip_null=True)
    return found.filter("kind = 0").select("row.*", F.col("_hit").alias(out))


def prompts(moments: DataFrame, gap_days: float = fixed.PROMPT_GAP_DAYS) -> DataFrame:
    """Moments at which a prompt is shown: once per version, and not within the gap.

    The prompt after a moment is a function of that moment alone: the first eligible one a gap later, or,
    if that has the same version, the first after it with another. So every moment
    names its successor, and the chain from the first moment is followed by pointer doubling.
    """
    gap = int(gap_days * 86_400 * 1_000_000)
    eligible = counted_chunks(moments.filter("eligible").select("user_id", "us", "event_id", "app_version"), ["user_id"], ORDER)
    version = F.struct(F.col("app_version").alias("v"))
    runs = previous_value(eligible, ["user_id"], "_chunk", ORDER, version, "_before")
    changes = F.when(F.col("_before").isNotNull() & ~F.col("_before.v").eqNullSafe(F.col("app_version")), F.struct("us", "event_id"))
    runs = next_value(runs, ["user_id"], "_chunk", ORDER, changes, "changed", skip_null=True)
    linked = _first_at_or_after(runs.select("user_id", "us", "event_id", "app_version", "changed"), F.col("us") + gap, "_next")
    node = F.struct("us", "event_id")
    same = F.col("_next.app_version").eqNullSafe(F.col("app_version"))
    following = F.when(same, F.col("_next.changed")).otherwise(F.struct("_next.us", "_next.event_id"))
    pointers = linked.filter("_next is not null").select(F.col("user_id").alias("key"), node.alias("node"), following.alias("next"))
    starts = eligible.groupBy(F.col("user_id").alias("key")).agg(F.min(node).alias("node"))
    shown = followed(starts, pointers).select(F.col("key").alias("user_id"), "node.us", "node.event_id", F.col("number").cast("int").alias("number"))
    return eligible.join(shown, ["user_id", "us", "event_id"]).select("user_id", "event_id", "us", "app_version", "number")
