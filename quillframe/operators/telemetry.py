"""Telemetry of runs: histograms, rates, estimates, idleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillframe.operators.helpers import unused


def histogram(df: DataFrame, state: str, states: list[str], folded: dict[str, str] | None = None) -> DataFrame:
    """``state, n`` for each of ``states``, 0 where there is none; states outside the list are left out.

    ``folded`` names states that count as another one, such as errors among failures.
    """
    names = df.sparkSession.createDataFrame([(s,) for s in states], "state string")
    own = F.col(state)
    for name, other in (folded or {}).items():
        own = F.when(F.col(state) == name, other).otherwise(own)
    counts = df.groupBy(own.alias("state")).agg(F.count("*").alias("n"))
    return names.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def recent_rates(samples: DataFrame, key: str, at: str, segments: str, stories: str, now: Column, window: int = 3600, fallback: int = 20) -> DataFrame:
    """Rates per hour from the samples of the last ``window`` seconds before ``now``, or the last ``fallback`` ones.

    ``at`` is in seconds.  Fewer than two samples, or under 30 s between the first and the last: no rate.  A
    rate needs 5 more segments, or 2 more stories.  ``now`` may differ by key.
    """
    rows = samples.select(key, F.struct(F.col(at).cast("double").alias("at"), F.col(segments).cast("double").alias("c"), F.col(stories).cast("double").alias("s")).alias("p"), (F.col(at) >= now - window).alias("near"), now.alias("now"))
    newest = W.partitionBy(key).orderBy(F.desc("p"))
    rows = rows.withColumn("rank", F.row_number().over(newest)).where(F.col("near") | (F.col("rank") <= fallback))
    per = rows.groupBy(key).agg(
        F.count("*").alias("n_all"),
        F.count_if("near").alias("n_near"),
        F.max("p").alias("last"),
        F.min(F.when(F.col("near"), F.col("p"))).alias("first_near"),
        F.min(F.when(F.col("rank") <= fallback, F.col("p"))).alias("first_few"),
    )
    first = F.when(F.col("n_near") >= 2, F.col("first_near")).otherwise(F.col("first_few"))
    per = per.withColumn("first", first)
    gap = F.when(F.col("n_all") >= 2, F.col("last.at") - F.col("first.at"))
    more = lambda f: F.col(f"last.{f}") - F.col(f"first.{f}")
    rate = lambda f, least: F.when((gap >= 30) & (more(f) >= least), more(f) * 3600 / gap)
    return per.select(key, gap.alias("window_seconds"), rate("c", 5).alias("segments_per_hour"), rate("s", 2).alias("stories_per_hour"))


def yield_ratio(completed: Column, processed: Column) -> Column:
    """Share of queued work that will count, drawn towards 1 while little is known; between 0.05 and 1."""
    lost = (1 - completed / processed) * F.least(F.lit(1.0), processed / 500)
    return F.when(processed > 0, F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 - lost))).otherwise(1.0)


def workload(rows: DataFrame, key: str, status: str, total: str, crawled: str) -> DataFrame:
    """Per key: what is done, and what remains by kind."""
    done = F.col(status).isin("completed", "skipped", "failed")
    known = F.coalesce(F.col(total), F.lit(0)) > 0
    left = F.greatest(F.lit(0), F.col(total) - F.col(crawled))
    return rows.groupBy(key).agg(
        F.count_if(done).alias("processed"),
        F.count_if(F.col(status) == "completed").alias("completed"),
        F.count("*").alias("stories"),
        F.sum(F.coalesce(crawled, F.lit(0))).alias("crawled"),
        F.coalesce(F.avg(F.when((F.col(status) == "completed") & (F.col(crawled) > 0), F.col(crawled))), F.avg(F.when(known, F.col(total))), F.lit(0.0)).alias("average"),
        F.coalesce(F.sum(F.when(~done & known & (F.col(status) == "crawling"), left)), F.lit(0)).alias("active"),
        F.coalesce(F.sum(F.when(~done & known & (F.col(status) != "crawling"), left)), F.lit(0)).alias("queued"),
        F.count_if(~done & ~known).alias("unknown"),
    )


def estimated(work: DataFrame, recent_segments: Column, recent_stories: Column, net_segments: Column, elapsed: Column) -> DataFrame:
    """Work with ``remaining_segments, segments_per_hour, remaining_seconds, source``.

    The rate is 0.65 of the recent and 0.35 of the all-time one where both are known.  Halves are rounded to even.
    """
    ratio = yield_ratio(F.col("completed"), F.col("processed"))
    remaining = F.col("active") + F.bround(F.col("queued") * ratio) + F.bround(F.col("unknown") * F.col("average") * ratio)
    long_run = F.when((elapsed >= 30) & (net_segments > 0), net_segments * 3600 / elapsed)
    long_stories = F.when((elapsed >= 30) & (F.col("processed") > 0), F.col("processed") * 3600 / elapsed)
    rate = F.when(recent_segments.isNotNull() & long_run.isNotNull(), 0.65 * recent_segments + 0.35 * long_run).otherwise(F.coalesce(recent_segments, long_run))
    open_ = F.col("stories") - F.col("processed")
    out = work.withColumns({"remaining_stories": open_, "remaining_segments": remaining.cast("long"), "segments_per_hour": rate})
    by_stories = F.coalesce(long_stories, recent_stories)
    source = (
        F.when(F.col("remaining_stories") == 0, "complete")
        .when(recent_segments.isNotNull() & long_run.isNotNull(), "blended_chapters")
        .when(recent_segments.isNotNull(), "recent_chapters")
        .when(long_run.isNotNull(), "all_time_chapters")
        .when(long_stories.isNotNull(), "all_time_stories")
        .when(recent_stories.isNotNull(), "recent_stories")
        .otherwise("insufficient_data")
    )
    seconds = F.when(source == "complete", 0.0).when(F.col("segments_per_hour") > 0, F.col("remaining_segments") * 3600 / F.col("segments_per_hour")).otherwise(F.col("remaining_stories") * 3600 / by_stories)
    return out.withColumns({"source": source, "remaining_seconds": seconds})


def simple_estimate(stories: Column, processed: Column, known: Column, crawled: Column, elapsed: Column) -> Column:
    """What remains, if unprocessed stories are as long as the processed ones are on average."""
    left = F.greatest(F.lit(0), stories - processed)
    total = F.greatest(known, F.bround(known + left * F.when(processed > 0, known / processed).otherwise(0.0)).cast("long"))
    remaining = F.greatest(F.lit(0), total - crawled)
    rate = F.when((elapsed >= 30) & (crawled > 0), crawled * 3600 / elapsed)
    return F.struct(left.alias("remaining_stories"), total.alias("total"), remaining.alias("remaining"), rate.alias("per_hour"), (remaining * 3600 / rate).alias("remaining_seconds"))


def recent_lines(lines: DataFrame, run: str, at: str, message: str, order: str, most: int = 200) -> DataFrame:
    """``run, at, message, order`` of each run's last ``most`` lines, of equal ones (time and message) the first."""
    once = lines.groupBy(run, at, message).agg(F.min(order).alias(order))
    newest = W.partitionBy(run).orderBy(F.desc(order))
    place = unused("_place", once)
    return once.withColumn(place, F.row_number().over(newest)).where(F.col(place) <= most).drop(place)


def elapsed_seconds(started: Column, finished: Column, now: Column) -> Column:
    """Seconds of a run, not below 0; an open one ends now."""
    end = F.coalesce(finished, now)
    return F.greatest(F.lit(0), F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(started.cast("timestamp")))


def idle_islands(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Spells of activity: ``key, spell, started, ended, n``; more than ``gap`` seconds without an event end one."""
    w = W.partitionBy(key).orderBy(at)
    before = F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    fresh = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - before > gap * 1_000_000, F.lit(True))
    rows = events.withColumn("_fresh", fresh.cast("int")).withColumn("spell", F.sum("_fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "spell").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))


def breaker(events: DataFrame, key: str, order: str, blocked: Column, success: Column, limit: int = 3) -> DataFrame:
    """``key, stretch, blocks, opens_at``: blocks between successes; the breaker opens at the ``limit``-th one."""
    w = W.partitionBy(key).orderBy(order)
    rows = events.withColumn("stretch", F.count_if(success).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inner = W.partitionBy(key, "stretch").orderBy(order)
    rows = rows.withColumn("_blocks", F.count_if(blocked).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "stretch").agg(F.count_if(blocked).alias("blocks"), F.min(F.when(F.col("_blocks") >= limit, F.col(order))).alias("opens_at"))


def rollup(rows: DataFrame, run: str, item: str, at: str, value: str, initial: str, active: Column) -> DataFrame:
    """``run, items, net, live, updated`` per run: the sum of its items' gains since their initial values, not below 0.

    Each item counts with its last sample.  ``live`` tells the runs that are active; theirs is the gain so far, not a final one.
    """
    last = rows.groupBy(run, item).agg(F.max_by(F.struct(F.col(value).alias("value"), F.col(initial).alias("initial"), active.alias("live")), at).alias("s"), F.max(at).alias("at"))
    gain = F.greatest(F.lit(0), F.coalesce(F.col("s.value"), F.lit(0)) - F.coalesce(F.col("s.initial"), F.lit(0)))
    return last.groupBy(run).agg(F.count("*").alias("items"), F.sum(gain).alias("net"), F.bool_or("s.live").alias("live"), F.max("at").alias("updated"))


def silent(samples: DataFrame, key: str, order: str, values: list[str], at: str, most: float) -> DataFrame:
    """``key, since, seconds, idle``: since when a key's values have not changed, up to its last sample.

    ``at`` is in seconds; it is idle if that is longer than ``most``.
    """
    w = W.partitionBy(key).orderBy(order)
    sign = F.struct(*values)
    changed = ~F.coalesce(F.lag(sign).over(w).eqNullSafe(sign), F.lit(False)) | (F.row_number().over(w) == 1)
    rows = samples.select(key, F.col(at).alias("at"), F.when(changed, F.col(at)).alias("changed"))
    per = rows.groupBy(key).agg(F.max("changed").alias("since"), (F.max("at") - F.max("changed")).alias("seconds"))
    return per.withColumn("idle", F.col("seconds") > most)
