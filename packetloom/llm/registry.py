"""All queries of the llm subpackage and their SQL counterparts."""

from __future__ import annotations

from packetloom.llm import queries, sql

QUERIES = {name: f for name, f in vars(queries).items() if name[0] == "p" and name[1:2].isdigit()}
ORACLES: dict[str, str] = {name: text for name, text in sql.ORACLES.items() if name in QUERIES}
