"""DuckDB counterparts of queries that SQL can express."""

from __future__ import annotations

_REAL = ["patient_name", "dob", "authorization_number", "va_icn", "ordering_provider", "referring_provider", "diagnosis_text", "forms_text"]
_COMPLETE = " + ".join(f"(CASE WHEN {f} IS NULL OR lower(trim({f})) IN ('', '-', 'n/a', 'none', 'tbd', 'unknown') THEN 0 ELSE 1 END)" for f in _REAL)

ORACLES = {
    "p6_found": f"""
        WITH r AS (
            SELECT DISTINCT case_key, id, analyzed_at, coalesce(packet_confidence, -1e300) AS trust, {_COMPLETE} AS complete
            FROM packet_runs WHERE case_key <> 'unknown_case'),
        m AS (
            SELECT *, max(analyzed_at) OVER w AS top_at, max(trust) OVER w AS top_trust, max(complete) OVER w AS top_complete, count(*) OVER w AS n
            FROM r WINDOW w AS (PARTITION BY case_key))
        SELECT case_key, min(id) AS id FROM m
        WHERE analyzed_at = top_at AND trust = top_trust AND complete = top_complete AND n >= 2
        GROUP BY case_key""",
}
