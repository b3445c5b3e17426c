"""DuckDB counterparts of the history queries, written independently of them."""

from __future__ import annotations

_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '\\s+', ' ', 'g'))"


def _named(c: str) -> str:
    """A name without its credential endings, through a chain of subqueries."""
    x = f"(SELECT {_PLAIN.format(c)} AS v)"
    for e in (" md", " do", " pa", " pa-c", " np", " fnp", " aprn", " rn", " dr", " dr."):
        x = f"(SELECT CASE WHEN ends_with(v, '{e}') THEN trim(left(v, length(v) - {len(e)})) ELSE v END AS v FROM {x})"
    return x


_R = "r AS (SELECT DISTINCT * REPLACE (coalesce(score, 0) AS score) FROM packet_runs)"
_E = "e AS (SELECT DISTINCT id, created_at, case_key, lower(event_type) AS event_type, lower(event_status) AS event_status FROM packet_events), m AS (SELECT * FROM e WHERE event_type = 'manual_outcome')"
_TEXT = "(CASE WHEN json_valid({0}) AND json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE {0} END)"
_LIST = "(CASE WHEN json_valid({0}) AND json_type({0}) = 'ARRAY' THEN list_filter(CAST({0}::JSON AS VARCHAR[]), lambda x: x IS NOT NULL) ELSE []::VARCHAR[] END)"
_ISSUES = "i AS (SELECT r.*, " + _LIST.format("t") + " AS issues FROM (SELECT *, " + _TEXT.format("issues_json") + " AS t FROM r) AS r)"
_PIPED = "list_filter(list_transform(string_split(coalesce({0}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"
_LABELS = """l AS (
    SELECT r.id, r.packet_confidence, n.event_status AS outcome_status, n.created_at AS outcome_at FROM r, LATERAL (
        SELECT m.event_status, m.created_at FROM m WHERE m.case_key = r.case_key AND m.created_at >= r.analyzed_at AND m.event_status IN ('approved', 'denied')
        ORDER BY m.created_at, m.id LIMIT 1) AS n)"""
_JUDGED = """j AS (
    SELECT (outcome_status = 'approved')::INT AS label, least(1.0, greatest(0.0, CASE WHEN packet_confidence > 1 THEN packet_confidence / 100 ELSE packet_confidence END)) AS p
    FROM l WHERE packet_confidence IS NOT NULL)"""
_OBSERVED = """o AS (
    SELECT r.id, r.analyzed_at, (SELECT min(m.created_at) FROM m WHERE m.case_key = r.case_key AND m.created_at >= r.analyzed_at) AS event_at
    FROM r WHERE case_key IS NOT NULL AND analyzed_at IS NOT NULL),
t AS (SELECT id, date_diff('microsecond', analyzed_at, coalesce(event_at, (SELECT greatest(max(analyzed_at), max(event_at)) FROM o))) / 3.6e9 AS duration, event_at IS NOT NULL AS observed FROM o)"""


def _wilson(s: str, n: str) -> tuple[str, str]:
    p = f"({s}::DOUBLE / {n})"
    z2 = "(1.96 * 1.96)"
    center = f"(({p} + {z2} / (2.0 * {n})) / (1.0 + {z2} / {n}))"
    margin = f"((1.96 / (1.0 + {z2} / {n})) * sqrt({p} * (1.0 - {p}) / {n} + {z2} / (4.0 * {n} * {n})))"
    return f"greatest(0.0, {center} - {margin})", f"least(1.0, {center} + {margin})"


_LOW, _HIGH = _wilson("denied", "sample_size")
_BLOW, _BHIGH = _wilson("successes", "n")


def _ranking(where: str) -> str:
    return f"""WITH {_R}, g AS (SELECT round(avg(score), 1) AS g FROM r {where}),
        p AS (SELECT provider_key, round(avg(score), 1) AS average_score, round((6.0 * g + sum(score)) / (6.0 + count(*)), 1) AS shrunk_score, count(*) AS sample_size, g AS global_average_score
              FROM r, g WHERE provider_key IS NOT NULL AND provider_key NOT IN ('', 'unknown_provider') GROUP BY provider_key, g)
        SELECT *, row_number() OVER (ORDER BY shrunk_score DESC, sample_size DESC, average_score DESC, provider_key) AS provider_rank FROM p"""


ORACLES = {
    "history_totals": f"WITH {_R} SELECT count(*) AS run_count, count(DISTINCT case_key) AS case_count, count(DISTINCT provider_key) AS provider_count FROM r",
    "case_history": f"WITH {_R} SELECT case_key, row_number() OVER (PARTITION BY case_key ORDER BY analyzed_at DESC, id DESC) AS position, id, status, score FROM r WHERE case_key IS NOT NULL QUALIFY position <= 25",
    "provider_history": f"WITH {_R} SELECT provider_key, row_number() OVER (PARTITION BY provider_key ORDER BY analyzed_at DESC, id DESC) AS position, id, score FROM r WHERE provider_key IS NOT NULL QUALIFY position <= 40",
    "derived_case_keys": f"""WITH {_R}, n AS (SELECT id, {_PLAIN.format('authorization_number')} AS a, {_PLAIN.format('va_icn')} AS i, {_named('patient_name')} AS p, {_PLAIN.format('dob')} AS d,
        {_PLAIN.format("regexp_extract(file_name, '([^/]*)$', 1)")} AS f FROM r)
        SELECT id, CASE WHEN a <> '' THEN 'auth:' || a WHEN i <> '' THEN 'icn:' || i WHEN p <> '' AND d <> '' THEN 'patient:' || p || '|' || d WHEN p <> '' THEN 'patient:' || p WHEN f <> '' THEN 'file:' || f ELSE 'unknown_case' END AS case_key FROM n""",
    "derived_provider_keys": f"""WITH {_R} SELECT id, coalesce(nullif({_named('ordering_provider')}, ''), nullif({_named('provider_name')}, ''), nullif({_named('referring_provider')}, ''), 'unknown_provider') AS provider_key FROM r""",
    "internal_benchmark": f"""WITH {_R}, t AS (SELECT round(avg(score), 1) AS average_score, max(score) AS best_score FROM r)
        SELECT id, score, average_score, best_score, CASE WHEN score >= average_score + 10 THEN 'above_average' WHEN score <= average_score - 10 THEN 'below_average' ELSE 'near_average' END AS standing FROM r, t""",
    "provider_ranking": _ranking(""),
    "provider_network": _ranking("WHERE provider_key IS NOT NULL AND provider_key NOT IN ('', 'unknown_provider')"),
    "workflow_performance": f"""WITH {_R}, q AS (SELECT workflow_queue, round(avg(score), 1) AS average_score, count(*) AS run_count FROM r WHERE workflow_queue <> '' GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY average_score DESC, workflow_queue DESC) = 1 AS is_best FROM q""",
    "score_percentiles": f"""WITH {_R}, p AS (SELECT score, count(*) AS run_count, ((SELECT count(*) FROM r AS x WHERE x.score < r.score) + 0.5 * count(*)) / (SELECT count(*) FROM r) AS percentile FROM r GROUP BY score)
        SELECT *, CASE WHEN percentile >= 0.82 THEN 'best_in_class' WHEN percentile >= 0.62 THEN 'competitive' ELSE 'below_target' END AS quality_band FROM p""",
    "denial_rate": f"""WITH {_E}, t AS (SELECT count(*) FILTER (event_status = 'denied') AS denied, count(*) AS sample_size FROM m)
        SELECT denied, sample_size, denied / sample_size AS denial_rate, (denied + 1.0) / (sample_size + 2.0) AS smoothed_rate, {_LOW} AS interval_lower, {_HIGH} AS interval_upper FROM t""",
    "outcome_mix": f"WITH {_E} SELECT " + ", ".join(f"count(*) FILTER (event_status = '{k}') AS {k}_count" for k in ("reviewer_override", "corrected", "resubmitted", "denied", "approved")) + " FROM m",
    "routing_variance": f"""WITH {_R}, t AS (SELECT count(DISTINCT nullif(workflow_queue, '')) AS queues, count(DISTINCT nullif(triage_priority, '')) AS priorities FROM r)
        SELECT *, CASE WHEN greatest(queues, priorities) >= 4 THEN 'high_variance' WHEN greatest(queues, priorities) >= 2 THEN 'moderate_variance' ELSE 'stable' END AS status FROM t""",
    "case_status_counts": f"WITH {_E} SELECT case_key, event_status, count(*) AS event_count FROM e WHERE case_key IS NOT NULL AND event_status <> '' GROUP BY 1, 2",
    "failure_sources": f"WITH {_R}, {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM i WHERE lower(status) IN ('rejected', 'needs_review')) GROUP BY 1 ORDER BY n DESC, issue LIMIT 6",
    "outcome_drivers": f"""WITH {_R}, {_ISSUES}, d AS (
            SELECT unnest(issues[1:4]) AS issue FROM i WHERE lower(status) = 'rejected' UNION ALL SELECT unnest(issues[1:2]) FROM i WHERE lower(status) = 'needs_review'
            UNION ALL SELECT 'Poor scan quality' FROM i WHERE lower(scan_quality_band) = 'poor' UNION ALL SELECT 'High denial risk' FROM i WHERE lower(denial_risk) IN ('high', 'critical'))
        SELECT issue, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, issue LIMIT 6""",
    "recurring_issues": f"""WITH {_R}, {_ISSUES}, c AS (SELECT case_key, issue, count(*) AS n FROM (SELECT case_key, unnest(issues) AS issue FROM i WHERE case_key IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY n DESC, issue) AS position FROM c QUALIFY position <= 6""",
    "provider_memory": f"""WITH {_R}, t AS (SELECT provider_key, count(*) AS packet_count, round(avg(score), 1) AS average_score FROM r WHERE provider_key IS NOT NULL GROUP BY 1)
        SELECT *, CASE WHEN average_score >= 85 THEN 'strong' WHEN average_score >= 70 THEN 'mixed' ELSE 'weak' END AS quality_trend FROM t""",
    "provider_deficiencies": f"""WITH {_R}, {_ISSUES}, c AS (SELECT provider_key, issue, count(*) AS n FROM (SELECT provider_key, unnest(issues) AS issue FROM i WHERE provider_key IS NOT NULL) GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY provider_key ORDER BY n DESC, issue) AS position FROM c QUALIFY position <= 5""",
    "approved_profile": f"""WITH {_R}, f AS (SELECT array_to_string(list_sort({_PIPED.format('forms_text')}), ' | ') AS forms FROM r WHERE lower(status) = 'approved')
        SELECT forms, count(*) AS n FROM f WHERE forms <> '' GROUP BY 1 ORDER BY n DESC, forms LIMIT 1""",
    "complexity_benchmark": f"""WITH {_R}, {_ISSUES}, c AS (SELECT (len(issues) + len({_PIPED.format('forms_text')}))::INT AS complexity, score FROM i), d AS (SELECT complexity, count(*) AS run_count FROM c GROUP BY 1)
        SELECT d.complexity, run_count, count(*) AS similar_runs, round(avg(score), 1) AS similar_average_score FROM d JOIN c ON abs(c.complexity - d.complexity) <= 2 GROUP BY 1, 2""",
    "hidden_trend": f"""WITH {_R}, n AS (SELECT score, row_number() OVER (ORDER BY analyzed_at DESC, id DESC) AS p FROM r),
        t AS (SELECT round(avg(score) FILTER (p <= 20), 1) AS recent_average, round(avg(score) FILTER (p BETWEEN 21 AND 40), 1) AS previous_average FROM n)
        SELECT *, CASE WHEN recent_average - previous_average <= -6 THEN 'downward' WHEN recent_average - previous_average >= 6 THEN 'upward' ELSE 'stable' END AS status FROM t""",
    "outcome_labels": f"WITH {_R}, {_E}, {_LABELS} SELECT id, outcome_status, outcome_at, (outcome_status = 'approved')::INT AS label FROM l",
    "turnaround_observations": f"WITH {_R}, {_E}, {_OBSERVED} SELECT * FROM t",
    "turnaround_survival": f"""WITH {_R}, {_E}, {_OBSERVED}, g AS (SELECT duration, count(*) FILTER (observed) AS events, count(*) FILTER (NOT observed) AS censored FROM t WHERE duration >= 0 GROUP BY 1),
        k AS (SELECT *, sum(events + censored) OVER (ORDER BY duration DESC)::BIGINT AS at_risk FROM g)
        SELECT duration, at_risk, events, censored, round(product(1 - events / at_risk) OVER (ORDER BY duration), 6) AS survival FROM k WHERE events > 0""",
    "turnaround_median": f"""WITH {_R}, {_E}, x AS (SELECT case_key, max(created_at) AS newest FROM m GROUP BY 1),
        d AS (SELECT date_diff('microsecond', analyzed_at, newest) / 3.6e9 AS hours FROM r JOIN x USING (case_key) WHERE newest >= analyzed_at),
        o AS (SELECT hours, row_number() OVER (ORDER BY hours) AS p, count(*) OVER () AS n FROM d)
        SELECT round(hours, 1) AS median_hours, n AS sample_count FROM o WHERE p = n // 2 + 1""",
    "case_timeline": f"""WITH {_R}, {_E}, a AS (SELECT case_key, analyzed_at AS moment, 'analysis' AS entry_type, status, id FROM r WHERE case_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY analyzed_at DESC NULLS LAST, id DESC) <= 10),
        b AS (SELECT case_key, created_at AS moment, event_type AS entry_type, event_status AS status, id FROM e WHERE case_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_key ORDER BY created_at DESC NULLS LAST, id DESC) <= 15)
        SELECT case_key, row_number() OVER (PARTITION BY case_key ORDER BY moment DESC NULLS LAST, entry_type, id DESC) AS position, entry_type, status, id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY position <= 15""",
    "risk_drift": f"""WITH {_R}, k AS (SELECT *, CASE lower(denial_risk) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS risk FROM r WHERE case_key IS NOT NULL),
        t AS (SELECT id, score, risk, round(avg(score) OVER (PARTITION BY case_key ORDER BY analyzed_at, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 1) AS previous_average, lag(risk) OVER (PARTITION BY case_key ORDER BY analyzed_at, id) AS previous_risk FROM k)
        SELECT id, score, previous_average, CASE WHEN previous_average IS NULL THEN 'new_case' WHEN score >= previous_average + 8 AND risk <= previous_risk THEN 'improving'
            WHEN score <= previous_average - 8 OR risk > previous_risk THEN 'worsening' ELSE 'stable' END AS direction FROM t""",
    "correction_memory": f"""WITH {_R}, {_ISSUES}, t AS (SELECT id, issues, coalesce(lag(issues) OVER (PARTITION BY case_key ORDER BY analyzed_at, id), []::VARCHAR[]) AS before FROM i WHERE case_key IS NOT NULL)
        SELECT id, array_to_string(list_sort(list_distinct(list_filter(before, lambda x: NOT list_contains(issues, x)))), '; ') AS resolved_issues, array_to_string(list_sort(list_distinct(list_filter(issues, lambda x: NOT list_contains(before, x)))), '; ') AS new_issues FROM t""",
    "score_ewma": f"""WITH {_R}, t AS (SELECT id, list(score::DOUBLE) OVER (PARTITION BY case_key ORDER BY analyzed_at, id) AS s FROM r WHERE case_key IS NOT NULL)
        SELECT id, round(list_reduce(s, lambda a, x: 0.25 * x + 0.75 * a) + 1e-9, 3) AS ewma FROM t""",
    "score_cusum": f"""WITH RECURSIVE {_R}, n AS (SELECT id, case_key, score, avg(score) OVER (PARTITION BY case_key) AS target, stddev_pop(score) OVER (PARTITION BY case_key) AS s0, row_number() OVER (PARTITION BY case_key ORDER BY analyzed_at, id) AS p FROM r WHERE case_key IS NOT NULL),
        v AS (SELECT *, CASE WHEN s0 > 0 THEN s0 ELSE 1.0 END AS sd FROM n),
        c AS (SELECT id, case_key, p, sd, greatest(0.0, score - target - 0.25 * sd) AS up, least(0.0, score - target + 0.25 * sd) AS down FROM v WHERE p = 1
              UNION ALL SELECT v.id, v.case_key, v.p, v.sd, greatest(0.0, c.up + v.score - v.target - 0.25 * v.sd), least(0.0, c.down + v.score - v.target + 0.25 * v.sd) FROM v JOIN c ON v.case_key = c.case_key AND v.p = c.p + 1)
        SELECT id, round(up, 3) AS positive, round(down, 3) AS negative, CASE WHEN up >= 1.5 * sd THEN 'upward_shift' WHEN -down >= 1.5 * sd THEN 'downward_shift' ELSE 'stable' END AS signal FROM c""",
    "cases_with_outcome": f"WITH {_R}, {_E} SELECT DISTINCT case_key FROM r WHERE case_key IN (SELECT case_key FROM m)",
    "cases_without_outcome": f"WITH {_R}, {_E} SELECT DISTINCT case_key FROM r WHERE case_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.case_key = r.case_key)",
    "form_overlap": f"""WITH {_R}, f AS (SELECT id, case_key, analyzed_at, list_distinct({_PIPED.format('forms_text')}) AS forms FROM r WHERE case_key IS NOT NULL),
        t AS (SELECT id, forms, lag(forms) OVER (PARTITION BY case_key ORDER BY analyzed_at, id) AS before FROM f),
        s AS (SELECT id, len(list_intersect(forms, before)) AS shared, len(forms) + len(before) - len(list_intersect(forms, before)) AS either FROM t WHERE before IS NOT NULL)
        SELECT id, CASE WHEN either > 0 THEN round(shared / either, 4) ELSE 0.0 END AS overlap FROM s""",
    "new_identifiers": f"""WITH {_R}, o AS (SELECT * FROM r WHERE analyzed_at < TIMESTAMP '2025-01-01')
        SELECT id FROM r WHERE analyzed_at >= TIMESTAMP '2025-01-01' AND NOT EXISTS (SELECT 1 FROM o WHERE o.va_icn = r.va_icn) AND NOT EXISTS (SELECT 1 FROM o WHERE o.authorization_number = r.authorization_number)""",
    "run_features": f"""WITH {_R}, {_ISSUES}, s AS (SELECT *, {_TEXT.format('intel_summary_json')} AS js FROM i),
        k AS (SELECT *, CASE WHEN json_valid(js) THEN json_extract(js, '$.missing_items') END AS mi, CASE WHEN json_valid(js) THEN json_extract(js, '$.review_flags') END AS rf FROM s)
        SELECT id, least(1.0, greatest(0.0, score / 100.0)) AS score_norm, """
    + ", ".join(f"least(1.0, greatest(0.0, CASE WHEN {c} > 1 THEN {c} / 100.0 ELSE coalesce({c}, 0.0) END)) AS {c}" for c in ("packet_confidence", "scan_quality_score", "ocr_confidence"))
    + f", len(issues)::INT AS issue_count, len({_PIPED.format('forms_text')})::INT AS form_count, len({_LIST.format('mi')})::INT AS missing_item_count, len({_LIST.format('rf')})::INT AS review_flag_count FROM k",
    "forecast_scores": f"""WITH {_R}, {_E}, {_LABELS}, {_JUDGED}, c AS (SELECT label, p, least(1 - 1e-6, greatest(1e-6, p)) AS q FROM j)
        SELECT count(*) AS sample_size, round(avg((p - label) * (p - label)), 4) AS brier, round(avg(-(label * ln(q) + (1 - label) * ln(1 - q))), 4) AS log_loss FROM c""",
    "forecast_auc": f"""WITH {_R}, {_E}, {_LABELS}, {_JUDGED}
        SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 4) AS auc, (SELECT count(*) FROM j WHERE label = 1) AS positives, (SELECT count(*) FROM j WHERE label = 0) AS negatives
        FROM j AS a, j AS b WHERE a.label = 1 AND b.label = 0""",
}
_BINS = f"""WITH {_R}, {_E}, {_LABELS}, {_JUDGED}, b AS (SELECT least(floor(p * 5), 4)::BIGINT + 1 AS bin, count(*) AS n, avg(p) AS predicted, sum(label) AS successes FROM j GROUP BY 1),
    c AS (SELECT bin, n, round(predicted + 1e-9, 3) AS average_predicted, round(successes / n, 3) AS average_actual, round({_BLOW}, 3) AS interval_lower, round({_BHIGH}, 3) AS interval_upper FROM b)"""
ORACLES["forecast_calibration"] = _BINS + " SELECT * FROM c"
ORACLES["forecast_ece"] = _BINS + " SELECT round(sum(n * abs(average_predicted - average_actual)) / sum(n), 4) AS ece FROM c"
ORACLES["similar_cases"] = f"""WITH {_R}, a AS (SELECT id, coalesce(case_key, 'unknown_case') AS case_key, analyzed_at, provider_key, score, status, {_PLAIN.format('diagnosis_text')} AS d, list_distinct({_PIPED.format('forms_text')}) AS f FROM r),
    n AS (SELECT q.id, o.id AS other_id, o.status, o.score, q.provider_key AS k, o.provider_key AS ok, q.d, o.d AS od, q.f, o.f AS of FROM a AS q JOIN a AS o ON q.case_key <> o.case_key
          WHERE q.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY o.analyzed_at DESC NULLS LAST, o.id DESC) <= 80),
    s AS (SELECT *, round(CASE WHEN k = ok THEN 0.4 ELSE 0.0 END + CASE WHEN d <> '' AND od <> '' AND (contains(od, d) OR contains(d, od)) THEN 0.35 ELSE 0.0 END
          + CASE WHEN len(f) > 0 AND len(of) > 0 THEN 0.25 * len(list_intersect(f, of)) / len(list_distinct(list_concat(f, of))) ELSE 0.0 END + 1e-9, 2) AS similarity FROM n)
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, score DESC, other_id DESC) AS rank, other_id, similarity, status FROM s WHERE similarity > 0 QUALIFY rank <= 5"""
