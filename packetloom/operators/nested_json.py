"""Deeply nested JSON into linked flat tables (problem 4).

The texts of a batch are laid into one byte buffer. Bitmaps mark quotes that no backslash run
escapes, the inside of strings (parity of the running quote count), brackets, braces, commas
and colons outside strings; depths are running sums of opening minus closing marks. A mark's
container is the last opening mark one level up before it, its place in an array the number of
commas of its level since then, its name the string before the last colon of its level: all read
level by level from sorted positions, for a whole batch at once. Every object becomes a row that
names its parent. A string whose content is itself JSON is laid into the next round's buffer, under the
path of the string.

Whether a lone object under a member name counts as element 0 is known only after the whole
corpus was seen (some other record holds an array of objects under that name). So objects are
written with marks first and resolved afterwards against the distinct array names.

Defined results: null, empty, blank, cut-short or otherwise unreadable texts give no rows, as do
texts without objects in arrays. Repeated rows give their nodes once. Member names are taken as
they are; of a name repeated in one object the last counts, as in common readers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import materialize

STEP, LONE, OBJECT = "\x01", "\x02", "\x03"
#: Up to so many array names travel inside the plan; more are joined.
NAMES_IN_PLAN = 2_000


def structure(buffer: np.ndarray) -> np.ndarray:
    """Positions of unescaped quotes, and of structural marks outside strings, in order.

    `buffer` ends every text with a zero byte; quote parity starts anew at each.
    """
    n = len(buffer)
    quote = buffer == 34
    slash = buffer == 92
    if slash.any():
        # a quote is escaped if the run of backslashes before it has odd length
        at = np.arange(n)
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.empty(n, np.int64)
        run[0] = 0
        run[1:] = at[:-1] - last_other[:-1]
        quote &= (run & 1) == 0
    count = np.cumsum(quote)
    ends = np.flatnonzero(buffer == 0)
    base = np.zeros(len(ends), np.int64)
    base[1:] = count[ends[:-1]]
    per_byte = np.repeat(base, np.diff(np.concatenate(([-1], ends))))
    inside = ((count - per_byte - quote) & 1).astype(bool) & ~quote
    mark = np.isin(buffer, np.frombuffer(b"{}[],:", np.uint8)) & ~inside
    return np.flatnonzero(mark | quote)


def _readable(text: str) -> str | None:
    """The text if it is JSON, written anew if a name is repeated in an object; else None."""
    if text.lstrip()[:1] not in ("{", "[", '"'):
        return None
    repeated = False

    def members(pairs: list[tuple]) -> dict:
        nonlocal repeated
        found = dict(pairs)
        repeated |= len(found) != len(pairs)
        return found

    try:
        value = json.loads(text, object_pairs_hook=members)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value) if repeated else text


def spans(buffer: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values that may hold objects, read from the depths of the marks; all arrays run over these values.

    Returns (position, end, is_string, is_object, parent, index, name_from, name_to): `parent` is the
    number of the value around it or -1, `index` its place in an array or -1 in an object, and
    name_from..name_to the span of its member name. Only strings that may hold JSON are kept.
    """
    marks = structure(buffer)
    kind = buffer[marks]
    opens, closes = (kind == 123) | (kind == 91), (kind == 125) | (kind == 93)
    depth = np.cumsum(opens.astype(np.int64) - closes) - opens  # of what is around each mark
    quotes = np.flatnonzero(kind == 34)
    starts, stops = quotes[::2], quotes[1::2]
    follows = np.append(kind, 0)[stops + 1]
    names = follows == 58
    inner = buffer[np.minimum(marks[starts] + 1, len(buffer) - 1)]
    may_hold = ~names & ((inner == 123) | (inner == 91) | (inner == 92) | (inner == 32) | (inner == 9))
    openers = np.flatnonzero(opens)
    at = np.concatenate((openers, starts[may_hold]))  # number of the mark that begins each value
    end = np.concatenate((marks[openers], marks[stops[may_hold]]))
    order = np.argsort(at, kind="stable")
    at, end = at[order], end[order]
    is_string = kind[at] == 34
    level = depth[at]
    parent, index = np.full(len(at), -1), np.full(len(at), -1)
    name_from, name_to = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    colons, commas = np.flatnonzero(kind == 58), np.flatnonzero(kind == 44)
    colon_level, comma_level = depth[colons], depth[commas]
    value_at_open = np.flatnonzero(~is_string)
    for d in range(1, int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == d)
        around = value_at_open[level[value_at_open] == d - 1]
        own = around[np.searchsorted(at[around], at[mine]) - 1]
        parent[mine] = own
        in_array = kind[at[own]] == 91
        here = commas[comma_level == d]
        index[mine] = np.where(in_array, np.searchsorted(here, at[mine]) - np.searchsorted(here, at[own]), -1)
        member = mine[~in_array]
        before = colons[colon_level == d]
        colon = before[np.searchsorted(before, at[member]) - 1]
        name_from[member], name_to[member] = marks[colon - 2] + 1, marks[colon - 1]
    return marks[at], end, is_string, kind[at] == 123, parent, index, name_from, name_to


def extract(items: list[tuple[object, str]]) -> list[tuple]:
    """(…tag, marked path, array name) of every object below the root, of (tag, text) pairs."""
    out: list[tuple] = []
    work = [(tag, "", read) for tag, text in items if text and (read := _readable(text))]
    while work:
        parts = [t.encode("utf-8", "surrogatepass").replace(b"\x00", b" ") for _, _, t in work]
        raw = b"\x00".join(parts) + b"\x00"
        columns = spans(np.frombuffer(raw, np.uint8))
        text_of = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), columns[0], side="right")
        paths: list[str] = []
        nested: list[tuple] = []
        spelt: dict[bytes, str] = {}
        for j, start, end, is_string, is_object, parent, index, lo, hi in zip(text_of.tolist(), *[c.tolist() for c in columns]):
            tag, root, _ = work[j]
            if parent < 0:
                path = root
            elif index >= 0:
                path = f"{paths[parent]}[{index}]"
            else:
                name = spelt.get(raw[lo:hi])
                if name is None:
                    name = spelt[raw[lo:hi]] = json.loads(b'"' + raw[lo:hi] + b'"')
                path = f"{paths[parent]}{STEP}{name}" if paths[parent] else name
            if is_string:
                nested.append((tag, path, raw[start : end + 1]))
            elif is_object and path:
                if path.endswith("]"):
                    holder = path.rpartition("[")[0].rpartition(STEP)[2]
                    path += OBJECT
                    out.append((*tag, path, "" if holder.endswith("]") else holder))
                else:
                    path += LONE + OBJECT
                    out.append((*tag, path, None))
            paths.append(path)
        work = [(tag, path, read) for tag, path, literal in nested if literal[1:25].lstrip()[:1] in (b"{", b"[", b"\\", b"") and (read := _readable(json.loads(literal)))]
    return out


def marked_objects(rows: DataFrame) -> DataFrame:
    """(field, row_id, marked, name) of `rows(field, row_id, text)`; `name` is the array's member name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                c = b.iloc[at : at + 512]
                found = extract([((f, r), t) for f, r, t in zip(c["field"], c["row_id"], c["text"])])
                yield pd.DataFrame(found, columns=["field", "row_id", "marked", "name"])

    return rows.select("field", "row_id", "text").mapInPandas(run, "field string, row_id long, marked string, name string")


def _resolve(marked: Column, holds: Column) -> Column:
    """The path with lone objects under array names as element 0; `holds`: array of those names."""
    steps = F.split(marked, STEP)

    def step(s: Column) -> Column:
        lone = s.contains(LONE)
        name = F.substring_index(s, LONE, 1)
        bare = F.regexp_replace(name, r"^.*\]", "")
        return F.when(lone & (bare == name) & F.array_contains(holds, name), F.concat(name, F.lit("[0]"), F.lit(OBJECT))).when(lone, name).otherwise(s)

    return F.array_join(F.transform(steps, step), STEP)


def flatten(rows: DataFrame) -> DataFrame:
    """(field, row_id, node, parent): every object that is an element of an array, at any depth.

    `node` is the path from the root; `parent` the node of the nearest such object around it, or ''.
    """
    marked = materialize(marked_objects(rows), "nested-objects")
    names = marked.where(F.col("name").isNotNull() & (F.col("name") != "")).select("field", "name").distinct()
    some = names.limit(NAMES_IN_PLAN + 1).collect()
    if len(some) <= NAMES_IN_PLAN:
        holds = F.lit(None)
        for f in sorted({r["field"] for r in some}):
            held = F.array(*[F.lit(r["name"]) for r in sorted(some, key=lambda r: r["name"]) if r["field"] == f])
            holds = F.when(F.col("field") == f, held).otherwise(holds)
        resolved = marked.withColumn("full", F.when(F.col("marked").contains(LONE), _resolve(F.col("marked"), F.coalesce(holds, F.array(F.lit("\x00"))))).otherwise(F.col("marked")))
    else:
        lone = marked.where(F.col("marked").contains(LONE)).select("field", "row_id", "marked").distinct()
        used = lone.select("*", F.explode(F.filter(F.transform(F.split("marked", STEP), lambda s: F.when(s.contains(LONE), F.substring_index(s, LONE, 1))), lambda s: s.isNotNull())).alias("name"))
        held = used.join(names, ["field", "name"], "left_semi").groupBy("field", "row_id", "marked").agg(F.collect_set("name").alias("held"))
        resolved = marked.join(held, ["field", "row_id", "marked"], "left").withColumn("full", _resolve(F.col("marked"), F.coalesce("held", F.array(F.lit("\x00")))))
    element = resolved.where(F.col("full").endswith(OBJECT))
    head = F.expr(f"substring(full, 1, length(full) - length(substring_index(full, '{OBJECT}', -2)))")
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, f"[{LONE}{OBJECT}]", ""), STEP, ".")
    return element.select("field", "row_id", clean(F.col("full")).alias("node"), clean(head).alias("parent")).distinct()
