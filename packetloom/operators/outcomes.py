"""Runs joined to their outcomes in time, and what follows from durations and labels.

The as-of joins need no range join: runs and events are laid in one ordering per case, and each
run takes the first event that follows. A case that holds a large share of all rows is kept out of
the window: its rows go through time buckets, of which only the first event is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.prefix import running_sums
from packetloom.session import materialize

#: Cases of more rows than this are matched through time buckets.
HOT_CASE = 1_000_000
BUCKET_SECONDS = 86_400


def next_event(runs: DataFrame, events: DataFrame, hot: int = HOT_CASE) -> DataFrame:
    """runs(case_key, id, at) with the first event(case_key, id, at, status) at or after: event_at, event_status.

    Ties at one moment go to the smallest event id. Null cases and times have no event; runs keep
    their number. Every run must have its own id.
    """
    usable = runs.where("case_key IS NOT NULL AND at IS NOT NULL").select("case_key", "id", "at")
    known = events.where("case_key IS NOT NULL AND at IS NOT NULL").select("case_key", "id", "at", "status")
    sizes = usable.select("case_key").unionAll(known.select("case_key")).groupBy("case_key").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(sizes.where(F.col("n") > hot).select("case_key"), "hot-cases")
    if not large.take(1):
        return runs.join(_by_window(usable, known), "id", "left")
    by = lambda df, how: df.join(large, "case_key", how)
    found = _by_window(by(usable, "left_anti"), by(known, "left_anti")).unionByName(_by_bucket(by(usable, "left_semi"), by(known, "left_semi")))
    return runs.join(found, "id", "left")


def _by_window(runs: DataFrame, events: DataFrame) -> DataFrame:
    both = runs.select("case_key", "at", F.col("id").alias("run_id"), F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("struct<event_at:timestamp_ntz,event_status:string>").alias("event"))
    theirs = events.select("case_key", "at", F.lit(None).cast("bigint").alias("run_id"), F.col("id").alias("event_id"), F.struct(F.col("at").cast("timestamp_ntz").alias("event_at"), F.col("status").alias("event_status")).alias("event"))
    # at one moment runs come first, then events by id
    order = Window.partitionBy("case_key").orderBy("at", F.col("event_id").asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    merged = both.unionByName(theirs).withColumn("next", F.first("event", ignorenulls=True).over(order))
    return merged.where("run_id IS NOT NULL AND next IS NOT NULL").select(F.col("run_id").alias("id"), F.col("next.event_at").alias("event_at"), F.col("next.event_status").alias("event_status"))


def _by_bucket(runs: DataFrame, events: DataFrame) -> DataFrame:
    """First event in the run's own bucket at or after it, else the first of the next filled bucket."""
    bucket = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (BUCKET_SECONDS * 1_000_000))
    first = F.min_by(F.struct(F.col("at").cast("timestamp_ntz").alias("event_at"), F.col("status").alias("event_status")), F.struct("at", "id"))
    own = events.withColumn("bucket", bucket)
    firsts = own.groupBy("case_key", "bucket").agg(first.alias("first"))
    following = Window.partitionBy("case_key").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    used = runs.withColumn("bucket", bucket)
    asked = used.select("case_key", "bucket").distinct().join(firsts, ["case_key", "bucket"], "full").withColumn("later", F.first("first", ignorenulls=True).over(following)).select("case_key", "bucket", "later")
    inside = (
        used.join(own.select("case_key", "bucket", F.col("at").alias("e_at"), F.col("id").alias("e_id"), "status"), ["case_key", "bucket"])
        .where("e_at >= at")
        .groupBy("case_key", "bucket", F.col("id"))
        .agg(F.min_by(F.struct(F.col("e_at").cast("timestamp_ntz").alias("event_at"), F.col("status").alias("event_status")), F.struct("e_at", "e_id")).alias("inside"))
    )
    return (
        used.join(inside, ["case_key", "bucket", "id"], "left")
        .join(asked, ["case_key", "bucket"], "left")
        .withColumn("next", F.coalesce("inside", "later"))
        .where("next IS NOT NULL")
        .select("id", F.col("next.event_at").alias("event_at"), F.col("next.event_status").alias("event_status"))
    )


def hours_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(3.6e9)


def kaplan_meier(observations: DataFrame) -> DataFrame:
    """(duration, at_risk, events, censored, survival) at each duration with an event.

    observations(duration, observed): negative and null durations are left out. Durations are
    aggregated first; the running sums then go over distinct durations only.
    """
    grouped = observations.where("duration >= 0").groupBy("duration").agg(F.sum(F.col("observed").cast("int")).alias("events"), F.sum((~F.col("observed")).cast("int")).alias("censored"))
    gone = F.col("events") + F.col("censored")
    total = grouped.agg(F.sum(gone).alias("total"))  # one row
    sums = running_sums(grouped.withColumn("gone", gone), "duration", ["gone"], "survival")
    risk = sums.crossJoin(F.broadcast(total)).select("duration", (F.col("total") - F.col("gone_upto") + F.col("gone")).alias("at_risk"), "events", "censored").where("events > 0")
    steps = risk.withColumn("dead", (F.col("events") == F.col("at_risk")).cast("long")).withColumn("log", F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0))
    done = running_sums(steps, "duration", ["dead", "log"], "survival")
    return done.select("duration", "at_risk", "events", "censored", F.when(F.col("dead_upto") > 0, 0.0).otherwise(F.exp("log_upto")).alias("survival"))


def auc(scored: DataFrame) -> DataFrame:
    """One row (auc, positives, negatives) of scored(label, p): mid-rank statistic over distinct scores, no pairs."""
    grouped = scored.where("label IN (0, 1) AND p IS NOT NULL").groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    ranked = running_sums(grouped, "p", ["neg"], "auc").withColumn("neg_below", F.col("neg_upto") - F.col("neg"))
    totals = ranked.agg(F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("wins"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return totals.select(F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.col("wins") / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def reliability(judged: DataFrame) -> DataFrame:
    """Brier score, log loss, AUC, calibration error over five bins and reliability of judged(label, p), which is read twice."""
    q = F.greatest(F.lit(1e-6), F.least(F.col("p"), F.lit(1 - 1e-6)))
    bins = judged.groupBy(F.least(F.floor(F.col("p") * 5), F.lit(4)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.avg(F.col("label").cast("double")).alias("actual"), F.sum(F.pow(F.col("p") - F.col("label"), 2)).alias("squares"),
        F.sum(-(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))).alias("loss"),
    )
    n = F.sum("n")
    whole = bins.agg(n.alias("sample_size"), F.round(F.sum("squares") / n, 4).alias("brier"), F.round(F.sum("loss") / n, 4).alias("log_loss"), F.round(F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / n, 4).alias("ece"))
    both = whole.crossJoin(auc(judged).select(F.round("auc", 4).alias("auc")))  # two one-row tables
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    weighed = 0.4 * part(F.col("sample_size") / 80) + 0.25 * part((F.col("auc") - 0.5) / 0.5) + 0.2 * part(1 - F.col("ece") / 0.3) + 0.15 * part(1 - F.col("brier") / 0.35)
    return both.withColumn("reliability", F.round(weighed, 2)).withColumn("band", F.when(F.col("reliability") >= 0.78, "high").when(F.col("reliability") >= 0.52, "moderate").otherwise("low"))
