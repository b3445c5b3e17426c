"""DuckDB counterparts of the page queries: the same rules in SQL, over the same fixed phrases."""

from __future__ import annotations

from packetloom.operators import extraction as ex
from packetloom.operators import page_fields, page_rules

_PAGES = "p AS (SELECT packet_id, unnest(pages) AS text, generate_subscripts(pages, 1)::INT - 1 AS page_index FROM packet)"
_MEASURES = """q AS (SELECT packet_id, page_index, trim(coalesce(text, '')) AS t FROM p),
    m AS (SELECT packet_id, page_index, length(t)::INT AS n_chars, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''))::INT AS n_lines, length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g'))::INT AS n_alnum FROM q)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, phrases: list[str] | tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(p)})" for p in phrases) + ")"


def _first(text: str, table: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {_has(text, words)} THEN {_quoted(name)}" for name, words in table.items()) + " END"


def _list(items: list[str]) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


_CODE = _quoted(ex.ANY_CODE)
_IMPLIED = _list([f"CASE WHEN {_has('low', words)} THEN {_quoted(code)} END" for code, words in ex.IMPLIED_CODES.items()])
_FULL = "CASE c " + " ".join(f"WHEN {_quoted(a)} THEN {_quoted(b)}" for a, b in ex.FULL_CODES.items()) + " ELSE c END"
_CODES = f"""t AS (SELECT packet_id, page_index, text, lower(text) AS low, flatten(list_transform(regexp_extract_all(text, {_quoted(ex.CODE_LINE)}, 1), lambda x: regexp_extract_all(x, {_CODE}, 1))) AS told FROM p WHERE text IS NOT NULL),
    u AS (SELECT packet_id, page_index, unnest(list_concat(CASE WHEN len(told) > 0 THEN told ELSE regexp_extract_all(text, {_CODE}, 1) END, {_IMPLIED})) AS c FROM t),
    c AS (SELECT DISTINCT packet_id, page_index, {_FULL} AS code FROM u WHERE contains(c, '.'))"""

_AFTER = rf"{ex.REQUEST}\s*[:\-]?\s*([^\n\r]{{0,120}})"
_BEFORE = r"([^\n\r]{0,120}?)\s*(?:requested procedure|requested service|authorization is requested for)"
_PROCEDURE = "CASE " + " ".join(f"WHEN regexp_matches(asked, {_quoted(p)}) THEN {_quoted(name)}" for name, p in ex.PROCEDURES.items()) + " END"
_DRUGS = _list([f"CASE WHEN {_has('low', words)} THEN {_quoted(name)} END" for name, words in ex.FINDINGS["medications"].items()])

_RANKED = ", ".join(f"CASE WHEN regexp_extract(text, {_quoted(p)}, 1) <> '' THEN {{'a': replace(upper(regexp_extract(text, {_quoted(p)}, 1)), ' ', ''), 'r': {rank}}} END" for p, rank in page_fields.AUTHORIZATIONS)

_ROLES = _list([f"CASE WHEN regexp_matches(line, {_quoted('(?i)' + chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')}) THEN {_quoted(role)} END" for role, words in ex.ROLES.items()])
_LINES = r"l AS (SELECT packet_id, page_index, unnest(list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS line FROM p WHERE text IS NOT NULL)"

_STOP = "list_min(list_filter([" + ", ".join(f"CASE WHEN instr(substr(lower(v), 2), {_quoted(label)}) > 0 THEN instr(substr(lower(v), 2), {_quoted(label)}) + 1 END" for label in ex.STOP_LABELS) + "], lambda x: x IS NOT NULL))"


def _labelled(field: str, label: str) -> str:
    raw = f"trim(regexp_extract(line, {_quoted(rf'(?i)(?:^|' + chr(92) + 's{3,})' + chr(92) + 's*(?:' + chr(92) + 'd{1,2}' + chr(92) + '.' + chr(92) + 's+)?' + label + chr(92) + 's*(?::|' + chr(92) + 's-' + chr(92) + 's)' + chr(92) + 's*(.+?)' + chr(92) + 's*$')}, 1))"
    if field in page_fields.PEOPLE:
        raw = rf"regexp_replace(regexp_replace({raw}, '(?i)^dr\.?\s+', ''), '(?i),?\s+(?:md|do|np|pa-c|pa|dpt)\.?$', '')"
    if field == "dob":
        raw = rf"regexp_extract({raw}, '(\d{{1,2}}/\d{{1,2}}/\d{{4}})', 1)"
    return f"{{'field': {_quoted(field)}, 'value': {raw}}}"


_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(text, {_quoted('(?i)' + chr(92) + 'b(?:' + '|'.join(words) + ')' + chr(92) + 'b')}) THEN {_quoted(role)}" for role, words in ex.ROLES.items()) + " END"
_OBSERVED = f"""n AS (SELECT packet_id, page_index, text, {_ROLE} AS role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM p WHERE text IS NOT NULL),
    x AS (SELECT packet_id, page_index, line_no, text, role, unnest([{', '.join(_labelled(f, l) for f, l in page_fields.LABELS.items())}]) AS x FROM n WHERE regexp_matches(line, ':|\\s-\\s')),
    o AS (SELECT packet_id, page_index, line_no, x.field AS field, x.value AS value, role, round(CASE
        WHEN x.field = 'authorization_number' AND starts_with(upper(trim(x.value)), 'VA') AND regexp_matches(lower(text), '\\bref(?:\\.|erral)?\\b') THEN 0.99
        WHEN x.field = 'authorization_number' AND starts_with(upper(trim(x.value)), 'VA') AND regexp_matches(lower(text), 'community care|10-10172|request for service') THEN 0.97
        WHEN x.field = 'diagnosis' AND role IN ('diagnostic_basis', 'clinical_support', 'justification') THEN 0.97 ELSE 0.95 END, 2) AS confidence, instr(text, x.value)::INT AS "at", text
        FROM x WHERE x.value <> ''),
    s AS (SELECT packet_id, field, value, page_index, confidence FROM o QUALIFY row_number() OVER (PARTITION BY packet_id, field ORDER BY confidence DESC, page_index DESC, line_no DESC) = 1)"""
_SAME = r"""CASE WHEN field IN ('name', 'ordering_provider', 'referring_provider', 'provider', 'signed_by')
    THEN array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(value), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) > 1)), ' ') ELSE regexp_replace(lower(value), '[^a-z0-9]', '', 'g') END"""

_T = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
_FORMS = _list([
    f"CASE WHEN {_has('t', words)}" + (" OR (" + " AND ".join(f"contains(t, {_quoted(w)})" for w in context) + ")" if context else "") + f" THEN {_quoted(name)} END"
    for name, (words, context) in page_rules.FORMS.items()
])
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, {_quoted(p)}) THEN {_quoted(name)}" for name, p in page_rules.PACKETS.items()) + " ELSE 'Unknown Packet' END"

ORACLES = {
    "page_measures": f"WITH {_PAGES}, {_MEASURES} SELECT *, n_chars < 220 OR (n_lines <= 4 AND n_alnum < 180) AS sparse FROM m",
    "sparse_packets": f"""WITH {_PAGES}, {_MEASURES}, s AS (SELECT packet_id, count(*) AS pages, count(*) FILTER (n_chars < 220 OR (n_lines <= 4 AND n_alnum < 180)) AS sparse_pages FROM m GROUP BY 1)
        SELECT *, sparse_pages / pages >= 0.5 AS half_sparse FROM s""",
    "page_codes": f"WITH {_PAGES}, {_CODES} SELECT * FROM c",
    "listed_codes": f"WITH {_PAGES}, {_CODES} SELECT code, count(*) AS pages, count(DISTINCT packet_id) AS packets FROM c WHERE code IN (SELECT ref_code FROM diagnosis_ref) GROUP BY 1",
    "signed_pages": f"WITH {_PAGES} SELECT packet_id, count(*) FILTER (regexp_matches(text, '(?i)\\b(?:electronically )?signed by\\s*:?\\s*[A-Za-z]')) AS signed_pages FROM p GROUP BY 1",
    "inferred_findings": f"""WITH {_PAGES}, t AS (SELECT packet_id, page_index, lower(text) AS low, array_to_string(list_concat(regexp_extract_all(lower(text), {_quoted(_AFTER)}, 1), regexp_extract_all(lower(text), {_quoted(_BEFORE)}, 1)), ' ') AS asked FROM p WHERE text IS NOT NULL)
        SELECT packet_id, page_index, {_first('low', ex.FINDINGS['diagnosis'])} AS diagnosis, {_first('low', ex.FINDINGS['symptom'])} AS symptom, {_PROCEDURE} AS procedure,
        CASE WHEN {_has('low', ex.MEDICATION_CONTEXT)} THEN coalesce(array_to_string({_DRUGS}, ','), '') ELSE '' END AS medications FROM t""",
    "page_authorizations": f"WITH {_PAGES}, f AS (SELECT packet_id, page_index, coalesce({_RANKED}) AS x FROM p WHERE text IS NOT NULL) SELECT packet_id, page_index, x.a AS authorization, x.r AS rank FROM f WHERE x IS NOT NULL",
    "section_roles": f"""WITH {_PAGES}, {_LINES}, r AS (SELECT packet_id, page_index, line, unnest({_ROLES}) AS role FROM l WHERE NOT regexp_matches(line, '^[\\x{{2022}}\\x{{25cf}}\\x{{25cb}}\\x{{2610}}-\\x{{2612}}*-]'))
        SELECT packet_id, page_index, role, count(DISTINCT lower(line)) AS headings FROM r GROUP BY ALL""",
    "cut_diagnoses": f"""WITH {_PAGES}, d AS (SELECT packet_id, page_index, regexp_extract_all(text, '(?i)\\bdiagnosis: *([^\\n\\r]+)', 1) AS vs FROM p WHERE text IS NOT NULL),
        v AS (SELECT packet_id, page_index, unnest(vs) AS v, generate_subscripts(vs, 1)::INT - 1 AS n FROM d)
        SELECT packet_id, page_index, n, trim(CASE WHEN {_STOP} IS NULL THEN v ELSE substr(v, 1, {_STOP} - 1) END) AS value FROM v""",
    "field_observations": f"""WITH {_PAGES}, {_OBSERVED} SELECT packet_id, page_index, line_no, field, value, role, confidence, o."at" AS "at", trim(regexp_replace(substr(text, greatest(1, o."at" - 80), o."at" - greatest(1, o."at" - 80) + length(value) + 80), '\\s+', ' ', 'g')) AS snippet FROM o""",
    "selected_fields": f"WITH {_PAGES}, {_OBSERVED} SELECT * FROM s",
    "packet_fields": f"WITH {_PAGES}, {_OBSERVED} SELECT packet_id, {', '.join(f'max(value) FILTER (field = {_quoted(f)}) AS {f}' for f in page_fields.LABELS)} FROM s GROUP BY 1",
    "field_redundancy": f"WITH {_PAGES}, {_OBSERVED} SELECT packet_id, field, count(*) AS captured, count(DISTINCT {_SAME}) AS distinct_values, count(DISTINCT {_SAME}) > 1 AS conflict FROM o GROUP BY 1, 2",
    "layout_marks": f"""WITH {_PAGES} SELECT packet_id, page_index, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '\\||\\t|\\s{{3,}}')))::INT AS table_lines,
        {' + '.join(f"contains(text, {_quoted(m)})::INT" for m in page_rules.BOXES)} AS box_kinds, regexp_matches(lower(text), 'signature|signed') AS signed FROM p WHERE text IS NOT NULL""",
    "form_mentions": f"WITH {_PAGES}, t AS (SELECT packet_id, page_index, {_T} AS t FROM p) SELECT packet_id, page_index, unnest({_FORMS}) AS form FROM t",
    "packet_kinds": f"WITH t AS (SELECT packet_id, lower(coalesce(array_to_string(pages, chr(10)), '')) AS t FROM packet) SELECT packet_id, {_KIND} AS kind FROM t",
}
