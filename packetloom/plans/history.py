"""Analytics over the run and event history.

Rows repeated whole count once. Null scores count as 0. Orders are by time, then id, so that
late rows (small times under large ids) fall where they belong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import fields as fx
from packetloom.functions import stats as st
from packetloom.operators import ordered, outcomes
from packetloom.operators import outcome_model as om
from packetloom.operators.prefix import running_sums
from packetloom.session import materialize, table

TERMINAL = ("approved", "denied")
SHRINK_WEIGHT = 6.0


def runs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct runs with the given columns and id; score without nulls."""
    df = table(spark, sf_dir, "packet_runs", list(dict.fromkeys(["id", *columns]))).dropDuplicates(["id"])
    return df.withColumn("score", F.coalesce("score", F.lit(0))) if "score" in columns else df


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct events with the given columns and id; type and status in lower case."""
    df = table(spark, sf_dir, "packet_events", list(dict.fromkeys(["id", *columns]))).dropDuplicates(["id"])
    for c in ("event_type", "event_status"):
        df = df.withColumn(c, F.lower(c)) if c in columns else df
    return df


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "created_at", "case_key", "event_type", "event_status").where("event_type = 'manual_outcome'")


# Scans and totals


def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, distinct cases and distinct providers of the store."""
    return runs(spark, sf_dir, "case_key", "provider_key").agg(F.count(F.lit(1)).alias("run_count"), F.countDistinct("case_key").alias("case_count"), F.countDistinct("provider_key").alias("provider_count"))


def case_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 runs of every case."""
    w = Window.partitionBy("case_key").orderBy(F.desc("analyzed_at"), F.desc("id"))
    r = runs(spark, sf_dir, "case_key", "analyzed_at", "status", "score").where("case_key IS NOT NULL")
    return r.withColumn("position", F.row_number().over(w)).where("position <= 25").select("case_key", "position", "id", "status", "score")


def provider_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 40 runs of every provider."""
    w = Window.partitionBy("provider_key").orderBy(F.desc("analyzed_at"), F.desc("id"))
    r = runs(spark, sf_dir, "provider_key", "analyzed_at", "score").where("provider_key IS NOT NULL")
    return r.withColumn("position", F.row_number().over(w)).where("position <= 40").select("provider_key", "position", "id", "score")


def derived_case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case key of every run from its own identifiers."""
    r = runs(spark, sf_dir, "authorization_number", "va_icn", "patient_name", "dob", "file_name")
    return r.select("id", fx.case_key(*[F.col(c) for c in ("authorization_number", "va_icn", "patient_name", "dob", "file_name")]).alias("case_key"))


def derived_provider_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider key of every run from its provider fields."""
    r = runs(spark, sf_dir, "ordering_provider", "provider_name", "referring_provider")
    return r.select("id", fx.provider_key(F.col("ordering_provider"), F.col("provider_name"), F.col("referring_provider")).alias("provider_key"))


# Aggregates


def internal_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and best score, and the standing of every run against the mean."""
    r = materialize(runs(spark, sf_dir, "score").select("id", "score"), "scores")
    total = r.agg(F.round(F.avg("score"), 1).alias("average_score"), F.max("score").alias("best_score"))  # one row
    standing = F.when(F.col("score") >= F.col("average_score") + 10, "above_average").when(F.col("score") <= F.col("average_score") - 10, "below_average").otherwise("near_average")
    return r.crossJoin(F.broadcast(total)).select("id", "score", "average_score", "best_score", standing.alias("standing"))


def _provider_ranking(r: DataFrame, prior_from_known: bool) -> DataFrame:
    known = F.col("provider_key").isNotNull() & (F.col("provider_key") != "") & (F.col("provider_key") != "unknown_provider")
    sums = materialize(r.groupBy("provider_key").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n")), "provider-sums")
    prior = (sums.where(known) if prior_from_known else sums).agg(F.round(F.sum("total") / F.sum("n"), 1).alias("global_average_score"))  # one row
    ranked = sums.where(known).crossJoin(F.broadcast(prior)).select(
        "provider_key",
        F.round(F.col("total") / F.col("n"), 1).alias("average_score"),
        F.round(st.shrunk_mean(F.col("total"), F.col("n"), F.col("global_average_score"), SHRINK_WEIGHT), 1).alias("shrunk_score"),
        F.col("n").alias("sample_size"),
        "global_average_score",
    )
    # providers are ranked over all, so the rank is a running count over distributed ranges
    order = F.struct((-F.col("shrunk_score")).alias("a"), (-F.col("sample_size")).alias("b"), (-F.col("average_score")).alias("c"), "provider_key")
    return running_sums(ranked.withColumn("order", order).withColumn("one", F.lit(1).cast("bigint")), "order", ["one"], "provider-ranks").select("provider_key", "average_score", "shrunk_score", "sample_size", "global_average_score", F.col("one_upto").alias("provider_rank"))


def provider_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by smoothed mean score; the prior is the mean of all runs."""
    return _provider_ranking(runs(spark, sf_dir, "provider_key", "score"), False)


def provider_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by smoothed mean score; the prior is the mean of runs with a known provider."""
    return _provider_ranking(runs(spark, sf_dir, "provider_key", "score"), True)


def workflow_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of every queue, the best one marked."""
    r = runs(spark, sf_dir, "workflow_queue", "score").where("workflow_queue <> ''").groupBy("workflow_queue").agg(F.round(F.avg("score"), 1).alias("average_score"), F.count(F.lit(1)).alias("run_count"))
    best = r.agg(F.max_by("workflow_queue", F.struct("average_score", "workflow_queue")).alias("best"))
    return r.crossJoin(F.broadcast(best)).select("workflow_queue", "average_score", "run_count", (F.col("workflow_queue") == F.col("best")).alias("is_best"))


def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank percentile of every score that occurs."""
    counts = runs(spark, sf_dir, "score").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = running_sums(counts, "score", ["n"], "percentiles")
    share = (F.col("n_upto") - F.col("n") + 0.5 * F.col("n")) / F.col("total")
    return upto.crossJoin(F.broadcast(total)).select("score", F.col("n").alias("run_count"), share.alias("percentile"), st.band(share, (0.82, "best_in_class"), (0.62, "competitive"), otherwise="below_target").alias("quality_band"))


def denial_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of denied outcomes: plain, smoothed, and with its score interval."""
    t = manual(spark, sf_dir).agg(F.sum((F.col("event_status") == "denied").cast("bigint")).alias("denied"), F.count(F.lit(1)).alias("sample_size"))
    lower, upper = st.wilson(F.col("denied"), F.col("sample_size"))
    return t.select("denied", "sample_size", (F.col("denied") / F.col("sample_size")).alias("denial_rate"), st.smoothed_rate(F.col("denied"), F.col("sample_size")).alias("smoothed_rate"), lower.alias("interval_lower"), upper.alias("interval_upper"))


def outcome_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of outcomes of every kind that reviewers enter."""
    kinds = ("reviewer_override", "corrected", "resubmitted", "denied", "approved")
    return manual(spark, sf_dir).agg(*[F.sum((F.col("event_status") == k).cast("bigint")).alias(f"{k}_count") for k in kinds])


def routing_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct queues and priorities in use, and what their number says."""
    t = runs(spark, sf_dir, "workflow_queue", "triage_priority").agg(F.countDistinct(F.when(F.col("workflow_queue") != "", F.col("workflow_queue"))).alias("queues"), F.countDistinct(F.when(F.col("triage_priority") != "", F.col("triage_priority"))).alias("priorities"))
    most = F.greatest("queues", "priorities")
    return t.select("queues", "priorities", F.when(most >= 4, "high_variance").when(most >= 2, "moderate_variance").otherwise("stable").alias("status"))


def case_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every status, case by case."""
    e = events(spark, sf_dir, "case_key", "event_status").where("case_key IS NOT NULL AND event_status <> ''")
    return e.groupBy("case_key", "event_status").agg(F.count(F.lit(1)).alias("event_count"))


def _issues(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    r = runs(spark, sf_dir, "issues_json", *columns)
    return r.withColumn("issues", fx.string_list(F.col("issues_json"))).drop("issues_json")


def _top(counted: DataFrame, k: int) -> DataFrame:
    """The k most frequent; ties by name."""
    return counted.orderBy(F.desc("n"), "issue").limit(k)


def failure_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent issues of rejected and reviewed runs."""
    r = _issues(spark, sf_dir, "status").where(F.lower("status").isin("rejected", "needs_review"))
    return _top(r.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")), 6)


def outcome_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six leading drivers: first issues of failed runs, poor scans and high denial risk."""
    r = _issues(spark, sf_dir, "status", "scan_quality_band", "denial_risk")
    status = F.lower("status")
    first = F.when(status == "rejected", F.slice("issues", 1, 4)).when(status == "needs_review", F.slice("issues", 1, 2)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    scan = F.when(F.lower("scan_quality_band") == "poor", F.array(F.lit("Poor scan quality"))).otherwise(none)
    denial = F.when(F.lower("denial_risk").isin("high", "critical"), F.array(F.lit("High denial risk"))).otherwise(none)
    return _top(r.select(F.explode(F.concat(first, scan, denial)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n")), 6)


def recurring_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every case, up to six issues that came up at least twice."""
    r = _issues(spark, sf_dir, "case_key").where("case_key IS NOT NULL").select("case_key", F.explode("issues").alias("issue"))
    counted = r.groupBy("case_key", "issue").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy("case_key").orderBy(F.desc("n"), "issue")
    return counted.withColumn("position", F.row_number().over(w)).where("position <= 6")


def provider_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, mean score and trend of every provider."""
    t = runs(spark, sf_dir, "provider_key", "score").where("provider_key IS NOT NULL").groupBy("provider_key").agg(F.count(F.lit(1)).alias("packet_count"), F.round(F.avg("score"), 1).alias("average_score"))
    return t.withColumn("quality_trend", st.band(F.col("average_score"), (85, "strong"), (70, "mixed"), otherwise="weak"))


def provider_deficiencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent issues of every provider."""
    r = _issues(spark, sf_dir, "provider_key").where("provider_key IS NOT NULL").select("provider_key", F.explode("issues").alias("issue"))
    counted = r.groupBy("provider_key", "issue").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("position", F.row_number().over(Window.partitionBy("provider_key").orderBy(F.desc("n"), "issue"))).where("position <= 5")


def approved_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent combination of forms among approved runs."""
    r = runs(spark, sf_dir, "forms_text", "status").where(F.lower("status") == "approved")
    forms = r.select(F.array_join(F.array_sort(fx.piped(F.col("forms_text"))), " | ").alias("forms")).where("forms <> ''")
    return forms.groupBy("forms").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "forms").limit(1)


def complexity_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of runs whose complexity (issues and forms) differs by two at most, for every complexity.

    Runs are aggregated by complexity first, and each aggregate goes to the five values it serves.
    """
    r = _issues(spark, sf_dir, "forms_text", "score").select((F.size("issues") + F.size(fx.piped(F.col("forms_text")))).alias("complexity"), "score")
    per = materialize(r.groupBy("complexity").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n")), "complexity")
    spread = per.select(F.explode(F.sequence(F.col("complexity") - 2, F.col("complexity") + 2)).alias("complexity"), "total", F.col("n").alias("near"))
    near = spread.groupBy("complexity").agg(F.sum("total").alias("total"), F.sum("near").alias("similar_runs"))
    return per.select("complexity", F.col("n").alias("run_count")).join(near, "complexity").select("complexity", "run_count", "similar_runs", F.round(F.col("total") / F.col("similar_runs"), 1).alias("similar_average_score"))


def hidden_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of the newest 20 runs against the 20 before."""
    newest = runs(spark, sf_dir, "analyzed_at", "score").orderBy(F.desc("analyzed_at"), F.desc("id")).limit(40)
    position = F.row_number().over(Window.orderBy(F.desc("analyzed_at"), F.desc("id")))  # at most 40 rows
    t = newest.withColumn("position", position).agg(F.round(F.avg(F.when(F.col("position") <= 20, F.col("score"))), 1).alias("recent_average"), F.round(F.avg(F.when(F.col("position") > 20, F.col("score"))), 1).alias("previous_average"))
    step = F.col("recent_average") - F.col("previous_average")
    return t.withColumn("status", F.when(step <= -6, "downward").when(step >= 6, "upward").otherwise("stable"))


# Joins in time


def _timed(spark: SparkSession, sf_dir: str, terminal: bool) -> DataFrame:
    r = runs(spark, sf_dir, "case_key", "analyzed_at").select("id", "case_key", F.col("analyzed_at").alias("at"))
    e = manual(spark, sf_dir).select("id", "case_key", F.col("created_at").alias("at"), F.col("event_status").alias("status"))
    e = e.where(F.col("status").isin(*TERMINAL)) if terminal else e
    return outcomes.next_event(r, e)


def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with a later terminal outcome of its case, and its label."""
    return _timed(spark, sf_dir, True).where("event_at IS NOT NULL").select("id", F.col("event_status").alias("outcome_status"), F.col("event_at").alias("outcome_at"), (F.col("event_status") == "approved").cast("int").alias("label"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from every run to its next outcome; runs without one are censored at the newest time of the store."""
    timed = materialize(_timed(spark, sf_dir, False), "turnaround")
    newest = timed.agg(F.max(F.greatest(F.col("at").cast("timestamp_ntz"), F.coalesce("event_at", F.col("at").cast("timestamp_ntz")))).alias("newest"))
    end = F.coalesce("event_at", "newest")
    return timed.where("case_key IS NOT NULL AND at IS NOT NULL").crossJoin(F.broadcast(newest)).select("id", outcomes.hours_between(F.col("at").cast("timestamp_ntz"), end).alias("duration"), F.col("event_at").isNotNull().alias("observed"))


def turnaround_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir)


def turnaround_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kaplan-Meier curve of the hours to an outcome."""
    return outcomes.kaplan_meier(_observations(spark, sf_dir)).withColumn("survival", F.round("survival", 6))


def turnaround_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the hours from a run to the newest outcome of its case, where that is later."""
    newest = manual(spark, sf_dir).where("case_key IS NOT NULL").groupBy("case_key").agg(F.max("created_at").alias("newest"))
    d = runs(spark, sf_dir, "case_key", "analyzed_at").join(newest, "case_key").where("newest >= analyzed_at").select(outcomes.hours_between(F.col("analyzed_at"), F.col("newest")).alias("hours"))
    counts = d.groupBy("hours").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = running_sums(counts, "hours", ["n"], "median").crossJoin(F.broadcast(total))
    return upto.where((F.col("n_upto") > F.floor(F.col("total") / 2)) & (F.col("n_upto") - F.col("n") <= F.floor(F.col("total") / 2))).select(F.round("hours", 1).alias("median_hours"), F.col("total").alias("sample_count"))


def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 15 entries of every case out of its newest 10 runs and 15 events."""
    r = runs(spark, sf_dir, "case_key", "analyzed_at", "status").where("case_key IS NOT NULL").select("case_key", F.col("analyzed_at").alias("at"), F.lit("analysis").alias("entry_type"), "status", "id")
    e = events(spark, sf_dir, "case_key", "created_at", "event_type", "event_status").where("case_key IS NOT NULL").select("case_key", F.col("created_at").alias("at"), F.col("event_type").alias("entry_type"), F.col("event_status").alias("status"), "id")
    newest = Window.partitionBy("case_key").orderBy(F.desc_nulls_last("at"), F.desc("id"))
    first = r.withColumn("p", F.row_number().over(newest)).where("p <= 10").unionByName(e.withColumn("p", F.row_number().over(newest)).where("p <= 15"))
    last = Window.partitionBy("case_key").orderBy(F.desc_nulls_last("at"), "entry_type", F.desc("id"))
    return first.withColumn("position", F.row_number().over(last)).where("position <= 15").select("case_key", "position", "entry_type", "status", "id")


# Ordered functions


def _in_part() -> Window:
    """Over the rows of a case within one range of `ordered.with_previous`."""
    return Window.partitionBy("_part", "case_key").orderBy("analyzed_at", "id")


def _with_previous(df: DataFrame, k: int, label: str) -> DataFrame:
    return ordered.with_previous(df.where("case_key IS NOT NULL"), "case_key", ["analyzed_at", "id"], k, label)


def risk_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's score and denial risk against the three runs before it in its case."""
    rank = F.when(F.lower("denial_risk") == "critical", 4).when(F.lower("denial_risk") == "high", 3).when(F.lower("denial_risk") == "medium", 2).when(F.lower("denial_risk") == "low", 1).otherwise(0)
    r = runs(spark, sf_dir, "case_key", "analyzed_at", "score", "denial_risk").withColumn("risk", rank)
    w = _in_part()
    t = _with_previous(r, 3, "drift").withColumn("previous_average", F.round(F.avg("score").over(w.rowsBetween(-3, -1)), 1)).withColumn("previous_risk", F.lag("risk").over(w))
    direction = (
        F.when(F.col("previous_average").isNull(), "new_case")
        .when((F.col("score") >= F.col("previous_average") + 8) & (F.col("risk") <= F.col("previous_risk")), "improving")
        .when((F.col("score") <= F.col("previous_average") - 8) | (F.col("risk") > F.col("previous_risk")), "worsening")
        .otherwise("stable")
    )
    return t.where("NOT _context").select("id", "score", "previous_average", direction.alias("direction"))


def correction_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues resolved and new since the run before of the same case."""
    r = _with_previous(_issues(spark, sf_dir, "case_key", "analyzed_at").select("id", "case_key", "analyzed_at", "issues"), 1, "corrections")
    before = F.coalesce(F.lag("issues").over(_in_part()), F.array().cast("array<string>"))
    t = r.withColumn("before", before).where("NOT _context")
    joined = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), "; ")
    return t.select("id", joined("before", "issues").alias("resolved_issues"), joined("issues", "before").alias("new_issues"))


def score_ewma(spark: SparkSession, sf_dir: str, alpha: float = 0.25) -> DataFrame:
    """Exponentially weighted mean of the scores of every case up to each run.

    In closed form over running sums of stretches of 64 runs, with powers that stay in range. Each range of
    runs brings the 768 before it along: what lies further back weighs less than double precision shows.
    """
    reach, keep = 768, 1.0 - alpha
    r = _with_previous(runs(spark, sf_dir, "case_key", "analyzed_at", "score"), reach, "ewma")
    whole = Window.partitionBy("_part", "case_key")
    r = r.withColumn("n", F.row_number().over(_in_part()) - 1).withColumn("brought", F.sum(F.col("_context").cast("int")).over(whole))
    stretch, inside = F.floor(F.col("n") / 64), F.col("n") % 64
    part = r.withColumn("stretch", stretch).withColumn("inside", inside)
    own = Window.partitionBy("_part", "case_key", "stretch").orderBy("inside").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the first run of a case stands with full weight
    weight = F.when((F.col("n") == 0) & (F.col("brought") < reach), 1.0).otherwise(alpha)
    local = part.withColumn("local", F.sum(weight * F.col("score") / F.pow(F.lit(keep), F.col("inside"))).over(own) * F.pow(F.lit(keep), F.col("inside")))
    ends = local.where("inside = 63").select("_part", "case_key", (F.col("stretch") + 1).alias("stretch"), F.col("local").alias("end"))
    full = keep**64
    chain = Window.partitionBy("_part", "case_key").orderBy("stretch").rowsBetween(-12, Window.currentRow)  # keep^768 is below double precision
    carried = ends.withColumn("list", F.collect_list(F.struct("stretch", "end")).over(chain)).withColumn("carry", F.aggregate("list", F.lit(0.0), lambda acc, x: acc * full + x["end"])).select("_part", "case_key", "stretch", "carry")
    mean = F.col("local") + F.coalesce("carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("inside") + 1)
    return local.join(carried, ["_part", "case_key", "stretch"], "left").where("NOT _context").select("id", F.round(mean + 1e-9, 3).alias("ewma"))


def score_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided CUSUM of the scores of every case: both sums at each run, and whether they cross the threshold.

    The one-sided sum is the running sum of the shifted values minus its running minimum (not above 0).
    """
    r = runs(spark, sf_dir, "case_key", "analyzed_at", "score").where("case_key IS NOT NULL")
    cut = ordered.parted(r, "case_key", ["analyzed_at", "id"], "cusum")
    level = cut.groupBy("case_key").agg(F.avg("score").alias("target"), F.stddev_pop("score").alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    cut = cut.join(level, "case_key")
    shift = F.col("score") - F.col("target")
    t = ordered.running(cut, "case_key", ["analyzed_at", "id"], {"up": shift - 0.25 * F.col("sd"), "down": shift + 0.25 * F.col("sd")})
    t = t.withColumn("positive", F.col("up") - F.least(F.lit(0.0), "up_least")).withColumn("negative", F.col("down") - F.greatest(F.lit(0.0), "down_most"))
    limit = 1.5 * F.col("sd")
    signal = F.when(F.col("positive") >= limit, "upward_shift").when(-F.col("negative") >= limit, "downward_shift").otherwise("stable")
    return t.select("id", F.round("positive", 3).alias("positive"), F.round("negative", 3).alias("negative"), signal.alias("signal"))


# Sets


def cases_with_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that have runs and outcomes."""
    return runs(spark, sf_dir, "case_key").select("case_key").intersect(manual(spark, sf_dir).select("case_key")).where("case_key IS NOT NULL")


def cases_without_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that have runs but no outcome."""
    return runs(spark, sf_dir, "case_key").select("case_key").where("case_key IS NOT NULL").subtract(manual(spark, sf_dir).select("case_key"))


def form_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity of the forms of every run with those of the run before in its case."""
    r = _with_previous(runs(spark, sf_dir, "case_key", "analyzed_at", "forms_text").withColumn("forms", F.array_distinct(fx.piped(F.col("forms_text")))), 1, "overlap")
    t = r.withColumn("before", F.lag("forms").over(_in_part())).where("before IS NOT NULL AND NOT _context")
    union = F.size(F.array_union("forms", "before"))
    return t.select("id", F.when(union > 0, F.round(F.size(F.array_intersect("forms", "before")) / union, 4)).otherwise(0.0).alias("overlap"))


def new_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs from 2025 on whose ICN and authorization are both unseen before 2025: the append of an export sink.

    One anti join per key, so neither is a disjunctive join.
    """
    r = runs(spark, sf_dir, "analyzed_at", "va_icn", "authorization_number")
    old, new = r.where("analyzed_at < timestamp_ntz'2025-01-01'"), r.where("analyzed_at >= timestamp_ntz'2025-01-01'")
    return new.join(old.select("va_icn").where("va_icn IS NOT NULL").distinct(), "va_icn", "left_anti").join(old.select("authorization_number").where("authorization_number IS NOT NULL").distinct(), "authorization_number", "left_anti").select("id")


def run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight features of every run for the outcome model."""
    r = runs(spark, sf_dir, "score", "packet_confidence", "issues_json", "forms_text", "intel_summary_json", "scan_quality_score", "ocr_confidence")
    return r.select(
        "id",
        st.clamp(F.col("score") / 100.0).alias("score_norm"),
        st.rate(F.col("packet_confidence")).alias("packet_confidence"),
        F.size(fx.string_list(F.col("issues_json"))).alias("issue_count"),
        F.size(fx.piped(F.col("forms_text"))).alias("form_count"),
        F.size(fx.member_list(F.col("intel_summary_json"), "missing_items")).alias("missing_item_count"),
        F.size(fx.member_list(F.col("intel_summary_json"), "review_flags")).alias("review_flag_count"),
        st.rate(F.col("scan_quality_score")).alias("scan_quality_score"),
        st.rate(F.col("ocr_confidence")).alias("ocr_confidence"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, p): outcomes against packet confidence as the forecast."""
    p = runs(spark, sf_dir, "packet_confidence").where("packet_confidence IS NOT NULL").select("id", st.rate(F.col("packet_confidence")).alias("p"))
    return outcome_labels(spark, sf_dir).join(p, "id").select("label", "p")


def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and log loss of packet confidence as a forecast of approval."""
    q = st.clamp(F.col("p"), 1e-6, 1 - 1e-6)
    return _judged(spark, sf_dir).agg(F.count(F.lit(1)).alias("sample_size"), F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 4).alias("brier"), F.round(F.avg(-(F.col("label") * F.log(q) + (1 - F.col("label")) * F.log(1 - q))), 4).alias("log_loss"))


def forecast_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of packet confidence against approval."""
    return outcomes.auc(materialize(_judged(spark, sf_dir), "judged")).select(F.round("auc", 4).alias("auc"), "positives", "negatives")


def forecast_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five calibration bins with their score intervals."""
    b = _judged(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("p") * 5), F.lit(4)) + 1).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("predicted"), F.sum("label").alias("successes"))
    lower, upper = st.wilson(F.col("successes"), F.col("n"))
    return b.select("bin", "n", F.round(F.col("predicted") + 1e-9, 3).alias("average_predicted"), F.round(F.col("successes") / F.col("n"), 3).alias("average_actual"), F.round(lower, 3).alias("interval_lower"), F.round(upper, 3).alias("interval_upper"))


def forecast_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error over the five bins."""
    b = forecast_calibration(spark, sf_dir)
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("average_predicted") - F.col("average_actual"))) / F.sum("n"), 4).alias("ece"))


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict]:
    """Features of all runs, the labelled ones with label and time, and the fitted model."""
    features = materialize(run_features(spark, sf_dir), "features")
    labels = outcome_labels(spark, sf_dir).select("id", "label")
    at = runs(spark, sf_dir, "analyzed_at").select("id", F.col("analyzed_at").alias("at"))
    labelled = materialize(features.join(labels, "id").join(at, "id"), "labelled")
    return features, labelled, om.fit_labelled(labelled)


def outcome_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability of approval of every run, by the fitted model."""
    features, _, model = _model(spark, sf_dir)
    return om.score(features, model)


def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the fitted model judges all labelled runs, those it was fitted on included, and its reliability.

    Reliability weighs sample size (full at 80), AUC, calibration error and Brier score 40 : 25 : 20 : 15.
    """
    _, labelled, model = _model(spark, sf_dir)
    judged = om.score(labelled, model).join(labelled.select("id", "label"), "id").select("label", F.col("calibrated_probability").alias("p")).where("p IS NOT NULL")
    return outcomes.reliability(materialize(judged, "judged-by-model"))


def similar_cases(spark: SparkSession, sf_dir: str, recent: int = 80, top: int = 5) -> DataFrame:
    """The five runs most like every run whose id is divisible by 50, among the 80 newest of other cases.

    The newest 80 of other cases lie, for every case but one, among the newest 160: only one case can hold
    more than 80 of those. For that one the newest 80 without it are added. So the pool has 240 rows at most,
    whatever the size of the store, and is broadcast.
    """
    columns = ["id", "case_key", "analyzed_at", "provider_key", "diagnosis_text", "forms_text", "score", "status"]
    r = materialize(runs(spark, sf_dir, *columns).withColumn("case_key", F.coalesce("case_key", F.lit("unknown_case"))), "similar-runs")
    newest = [F.desc("analyzed_at"), F.desc("id")]
    first = materialize(r.orderBy(*newest).limit(2 * recent), "similar-newest")
    crowd = first.groupBy("case_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > recent).select("case_key")
    without = r.join(F.broadcast(crowd), "case_key", "left_anti").orderBy(*newest).limit(recent)
    pool = (first.unionByName(without.select(first.columns)) if crowd.take(1) else first).dropDuplicates(["id"])
    pool = pool.select(*[F.col(c).alias(f"other_{c}") for c in columns])
    rank = Window.partitionBy("id").orderBy(F.desc("other_analyzed_at"), F.desc("other_id"))
    pairs = r.where("id % 50 = 0").join(F.broadcast(pool), F.col("case_key") != F.col("other_case_key")).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= recent)
    ours, theirs = fx.plain(F.col("diagnosis_text")), fx.plain(F.col("other_diagnosis_text"))
    forms, others = F.array_distinct(fx.piped(F.col("forms_text"))), F.array_distinct(fx.piped(F.col("other_forms_text")))
    alike = (
        F.when(F.col("provider_key") == F.col("other_provider_key"), 0.4).otherwise(0.0)
        + F.when((ours != "") & (theirs != "") & (F.contains(theirs, ours) | F.contains(ours, theirs)), 0.35).otherwise(0.0)
        + F.when((F.size(forms) > 0) & (F.size(others) > 0), 0.25 * F.size(F.array_intersect(forms, others)) / F.size(F.array_union(forms, others))).otherwise(0.0)
    )
    scored = pairs.withColumn("similarity", F.round(alike + 1e-9, 2)).where("similarity > 0")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), F.desc("other_score"), F.desc("other_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("id", "rank", "other_id", "similarity", F.col("other_status").alias("status"))


QUERIES = {f.__name__: f for f in (
    history_totals, case_history, provider_history, derived_case_keys, derived_provider_keys, internal_benchmark, provider_ranking, provider_network, workflow_performance,
    score_percentiles, denial_rate, outcome_mix, routing_variance, case_status_counts, failure_sources, outcome_drivers, recurring_issues, provider_memory, provider_deficiencies, approved_profile,
    complexity_benchmark, hidden_trend, outcome_labels, turnaround_observations, turnaround_survival, turnaround_median, case_timeline, risk_drift, correction_memory, score_ewma, score_cusum,
    cases_with_outcome, cases_without_outcome, form_overlap, new_identifiers, run_features, forecast_scores, forecast_auc, forecast_calibration, forecast_ece, outcome_scores, model_evaluation, similar_cases,
)}
