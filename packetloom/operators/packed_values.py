"""Several values packed in one field (problem 3).

A *dialect* is a set of delimiter kinds plus a decision whether quotes protect their
content. Every field text is parsed by the dialect with the shortest description:

    sum over values of  code length of the value
  + sum over delimiter occurrences of  -log2 P(separator or not | delimiter kind, field)

Value-code lengths come from distributed counts: values that stand alone in a field, or that
are wholly quoted, form a trusted dictionary; other values are spelt out with a character-pair
model. The chance that a delimiter kind separates values in a field follows from how often its
two neighbours, and how often one of them, are in the dictionary. So `+` separates
forms but not `+1(907)...`, without a rule for either.

Null, empty and blank texts give no rows; a text whose values are all empty gives no rows.
Positions count the non-empty values from 1. Equal texts are parsed once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import materialize

#: Delimiter kinds; a blank-padded and a bare slash or plus are different kinds.
KINDS = (",", ";", "|", "\t", "\n", "•", " / ", "/", " + ", "+")
_DELIMITER = re.compile(r"[,;|\t\n•]|[  ]+[/+][  ]+|[/+]")
_BLANKS = re.compile("[  ]+")
_QUOTES = {'"': '"', "“": "”"}
_SINGLE = frozenset(",;|\t\n•/+")
_ALPHABET = 96  # printable ASCII, and one class for all other characters
SMOOTHING = 0.5


def kind_of(delimiter: str) -> int:
    """Index into KINDS of a delimiter as it was matched."""
    bare = delimiter.strip("  ")
    return KINDS.index(f" {bare} " if bare in "/+" and bare and len(delimiter) > 1 else bare or delimiter)


def atoms(text: str, quoted: bool) -> tuple[list[str], list[str]]:
    """Pieces between all delimiters, and the delimiters. `quoted`: quotes protect."""
    pieces, delimiters, start, i, n = [], [], 0, 0, len(text)
    blank = True  # only blanks since the last delimiter
    while i < n:
        c = text[i]
        if quoted and blank and c in _QUOTES:
            end = _closing(text, i)
            if end > 0:
                i, blank = end, False
                continue
        m = _DELIMITER.match(text, i)
        if m:
            pieces.append(text[start:i])
            delimiters.append(m[0])
            i = start = m.end()
            blank = True
            continue
        blank = blank and c.isspace()
        i += 1
    pieces.append(text[start:])
    return pieces, delimiters


def _closing(text: str, i: int) -> int:
    """End of the quoted value that opens at i, or -1. A doubled straight quote is content.

    The closing quote must be followed by blanks and a delimiter or the end, else it is no quoting.
    """
    close = _QUOTES[text[i]]
    j = i + 1
    while True:
        j = text.find(close, j)
        if j < 0:
            return -1
        if close == '"' and text[j + 1 : j + 2] == '"':
            j += 2
            continue
        rest = text[j + 1 :].lstrip("  \r")
        if not rest or _DELIMITER.match(rest) or _DELIMITER.match(text, j + 1):
            return j + 1
        j += 1


def unquote(value: str) -> str:
    """Trimmed and freed of the quoting around it; doubled quotes inside become single."""
    v = value.strip()
    if len(v) > 1 and v[0] in _QUOTES and v[-1] == _QUOTES[v[0]] and _closing(v, 0) == len(v):
        inner = v[1:-1]
        return (inner.replace('""', '"') if v[0] == '"' else inner).strip()
    return v


def code(value: str) -> str:
    """The form under which a value is looked up in the dictionary. Tabs and line ends stay, as odd characters."""
    return _BLANKS.sub(" ", unquote(value).lower())


def _merge(pieces: list[str], delimiters: list[str], on: frozenset[int]) -> list[str]:
    out = [pieces[0]]
    for d, p in zip(delimiters, pieces[1:]):
        if kind_of(d) in on:
            out.append(p)
        else:
            out[-1] += d + p
    return out


def dialects(text: str) -> Iterator[tuple[int, list[str], dict[int, tuple[int, bool]]]]:
    """(quoted, values, {kind: (occurrences, separates)}) for every dialect of a text."""
    modes = (1, 0) if any(q in text for q in _QUOTES) else (1,)
    for quoted in modes:
        pieces, delimiters = atoms(text, bool(quoted))
        counts: dict[int, int] = {}
        for d in delimiters:
            counts[kind_of(d)] = counts.get(kind_of(d), 0) + 1
        present = sorted(counts)
        for r in range(len(present), -1, -1):
            for chosen in combinations(present, r):
                on = frozenset(chosen)
                yield quoted, _merge(pieces, delimiters, on), {k: (n, k in on) for k, n in counts.items()}


def _char(c: str) -> int:
    return ord(c) - 32 if 32 <= ord(c) < 127 else _ALPHABET - 1


def _distinct_texts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("text").rlike(r"\S")).groupBy("field", "text").agg(F.count(F.lit(1)).alias("copies"))


def _evidence(texts: DataFrame) -> DataFrame:
    """One pass over the distinct texts: trusted values, neighbour pairs, candidate values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for field, text in zip(b["field"], b["text"]):
                pieces, delimiters = atoms(text, True)
                codes = [code(p) for p in pieces]
                if not delimiters:
                    out.append((field, "value", codes[0], None, -1))
                    continue
                for p, c in zip(pieces, codes):
                    if c and p.strip()[0] in _QUOTES and unquote(p) != p.strip():
                        out.append((field, "value", c, None, -1))
                for d, a, c in zip(delimiters, codes, codes[1:]):
                    out.append((field, "pair", a, c, kind_of(d)))
            yield pd.DataFrame(out, columns=["field", "role", "a", "b", "kind"])

    return texts.select("field", "text").mapInPandas(run, "field string, role string, a string, b string, kind int")


def value_model(texts: DataFrame) -> tuple[DataFrame, dict]:
    """The dictionary (field, value, n) and the bounded model: delimiter chances and characters.

    The model has at most fields x KINDS and fields x 96 x 96 entries, whatever the input.
    """
    seen = materialize(_evidence(texts), "packed-evidence")
    dictionary = materialize(
        seen.where("role = 'value' and a <> ''").groupBy("field", F.col("a").alias("value")).agg(F.count(F.lit(1)).alias("n")),
        "packed-dictionary",
    )
    pairs = seen.where("role = 'pair'").groupBy("field", "kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    as_a = dictionary.select("field", F.col("value").alias("a"), F.lit(True).alias("ka"))
    as_b = dictionary.select("field", F.col("value").alias("b"), F.lit(True).alias("kb"))
    blank_a, blank_b = F.col("a") == "", F.col("b") == ""
    both = (F.col("ka").isNotNull() | blank_a) & (F.col("kb").isNotNull() | blank_b) & ~(blank_a & blank_b)
    one_a, one_b = (F.col("ka").isNotNull() | blank_a).cast("int"), (F.col("kb").isNotNull() | blank_b).cast("int")
    chance = (
        pairs.join(as_a, ["field", "a"], "left")
        .join(as_b, ["field", "b"], "left")
        .groupBy("field", "kind")
        .agg(F.sum(F.when(both, F.col("n")).otherwise(0)).alias("both"), F.sum("n").alias("of"), F.sum((one_a + one_b) * F.col("n") / 2).alias("one"))
        .collect()
    )

    def characters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tally: dict[tuple[str, int], int] = {}
            for field, value, n in zip(b["field"], b["value"], b["n"]):
                last = _ALPHABET - 1
                for c in value:
                    now = _char(c)
                    key = (field, last * _ALPHABET + now)
                    tally[key] = tally.get(key, 0) + 1
                    last = now
            yield pd.DataFrame([(f, k, n) for (f, k), n in tally.items()], columns=["field", "pair", "n"])

    pairs_of = dictionary.mapInPandas(characters, "field string, pair int, n long").groupBy("field", "pair").agg(F.sum("n").alias("n")).collect()
    totals = {r["field"]: (r["n"], r["v"]) for r in dictionary.groupBy("field").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    model: dict = {"chance": {}, "char": {}, "total": totals}
    for r in chance:
        # if a share t of true values is in the dictionary, both = s t^2 and one = s t; so s = one^2 / both
        share = (r["both"] + SMOOTHING / 10) / (r["of"] + SMOOTHING)
        if r["both"]:
            share = max(share, min(1.0, r["one"] ** 2 / (r["both"] * r["of"])))
        model["chance"][(r["field"], r["kind"])] = min(max(share, 1e-4), 1 - 1e-4)
    rows: dict[tuple[str, int], int] = {}
    for r in pairs_of:
        rows[(r["field"], r["pair"] // _ALPHABET)] = rows.get((r["field"], r["pair"] // _ALPHABET), 0) + r["n"]
    for r in pairs_of:
        model["char"][(r["field"], r["pair"])] = -math.log2((r["n"] + 0.05) / (rows[(r["field"], r["pair"] // _ALPHABET)] + 0.05 * _ALPHABET))
    return dictionary, model


def _candidates(texts: DataFrame) -> DataFrame:
    """Distinct candidate codes of each text that has more than one dialect."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for field, text in zip(b["field"], b["text"]):
                found: set[str] = set()
                many = 0
                for _, values, _ in dialects(text):
                    many += 1
                    found.update(map(code, values))
                if many > 1:
                    out += [(field, text, c) for c in found if c]
            yield pd.DataFrame(out, columns=["field", "text", "value"])

    return texts.select("field", "text").mapInPandas(run, "field string, text string, value string")


def choose_dialects(texts: DataFrame) -> DataFrame:
    """(field, text, values array) of each distinct text, by its cheapest dialect."""
    dictionary, model = value_model(texts)
    known = (
        _candidates(texts)
        .join(dictionary, ["field", "value"])
        .groupBy("field", "text")
        .agg(F.collect_list("value").alias("codes"), F.collect_list("n").alias("counts"))
    )
    joined = texts.select("field", "text").join(known, ["field", "text"], "left")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chance, char, total = model["chance"], model["char"], model["total"]
        for b in batches:
            out = []
            for field, text, codes, counts in zip(b["field"], b["text"], b["codes"], b["counts"]):
                have = dict(zip(codes, counts)) if codes is not None else {}
                n, v = total.get(field, (0, 1))
                escape = -math.log2((v + 1) / (n + v + 1))
                memo: dict[str, float] = {}

                def length(value: str) -> float:
                    c = code(value)
                    if c not in memo:
                        if not c:
                            memo[c] = 1.0
                        elif c in have:
                            memo[c] = -math.log2(have[c] / (n + v + 1))
                        else:
                            bits, last = escape, _ALPHABET - 1
                            for x in c:
                                if x in _SINGLE:  # paid for by the chance that it does not separate
                                    continue
                                now = _char(x)
                                bits += char.get((field, last * _ALPHABET + now), 12.0)
                                last = now
                            memo[c] = bits
                    return memo[c]

                best, chosen = math.inf, []
                for quoted, values, use in dialects(text):
                    bits = 0.0 if quoted else 2.0  # unquoted dialects of quoted texts are rare
                    for k, (times, on) in use.items():
                        p = chance.get((field, k), 0.5)
                        bits -= times * math.log2(p if on else 1 - p)
                    bits += sum(map(length, values))
                    if bits < best - 1e-9:
                        best, chosen = bits, values
                out.append((field, text, [x for x in map(unquote, chosen) if x]))
            yield pd.DataFrame(out, columns=["field", "text", "values"])

    return joined.mapInPandas(parse, "field string, text string, values array<string>")


def unpack(rows: DataFrame) -> DataFrame:
    """(field, row_key, pos, of, value): one row per value of `rows(field, row_key, text)`.

    Repeated input rows count once. Other columns of `rows` are ignored, so they cannot clash.
    """
    rows = rows.select("field", "row_key", "text").where(F.col("text").rlike(r"\S") & F.col("row_key").isNotNull()).distinct()
    texts = materialize(_distinct_texts(rows), "packed-texts")
    parsed = choose_dialects(texts)
    return (
        rows.join(parsed, ["field", "text"])
        .select("field", "row_key", F.size("values").alias("of"), F.posexplode("values").alias("at", "value"))
        .select("field", "row_key", (F.col("at") + 1).cast("int").alias("pos"), "of", "value")
    )


def long_form(df: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """(field, row_key, text) of several columns of one table, without a second scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    return df.select(key.cast("string").alias("row_key"), pairs.alias("p")).select("p.field", "row_key", "p.text")
