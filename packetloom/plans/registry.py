"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from packetloom.plans import history, history_sql, pages, pages_sql, problems
from packetloom.streaming import history as streams

QUERIES = {
    "p3_found": problems.p3_found,
    "p3_values": problems.p3_values,
    "p4_found": problems.p4_found,
    **history.QUERIES,
    **pages.QUERIES,
    **streams.QUERIES,
}
ORACLES: dict[str, str] = history_sql.ORACLES | pages_sql.ORACLES | streams.ORACLES
