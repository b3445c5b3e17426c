"""Visually identical text with different characters (problem 10).

First every text gets one form of each character: composed accents, characters of normal width,
ligatures spelt out, one kind of blank and hyphen, no invisible characters (those that join an
emoji stay). Then look-alike letters are repaired by script: in tokens of mixed script, and in
tokens that stand in a foreign script within their text, letters are substituted if the result is
a word of the corpus vocabulary, which holds the tokens of one script that is their text's own.
If several results are words, the script of most letters in the token decides, then frequency.

Vocabulary, repairs and their application are joins on tokens; nothing is collected.

Defined results: a null text stays null; texts without visible characters have an empty canonical
form and equal nothing; letters' case, digits, accents, punctuation and line ends are visible.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import materialize

#: Letters that look like a Latin letter (fixed values): script -> (letters, the Latin letters they look like).
LOOKALIKES = {
    "CYRILLIC": ("асеіјорѕухԁһԛԝАВЕЅІЈКМНОРСТХ", "aceijopsyxdhqwABESIJKMHOPCTX"),
    "GREEK": ("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovcjABEZHIKMNOPTYX"),
}
_SCRIPT = re.compile(r"(?P<LATIN>[A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ])|(?P<GREEK>[Ͱ-Ͽἀ-῿])|(?P<CYRILLIC>[Ѐ-ԯᲀ-᲏])")
_TO_LATIN = {s: dict(zip(*pair)) for s, pair in LOOKALIKES.items()}
_FROM_LATIN = {s: {b: a for a, b in zip(*pair)} for s, pair in LOOKALIKES.items()}
_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")
_FOREIGN = re.compile(r"[\u0370-\u052f\u1c80-\u1c8f\u1f00-\u1fff]")
_EMOJI = re.compile("[\u2190-\u2bff\U0001f000-\U0001faff]")
_JOINED = re.compile("([\u2190-\u2bff\U0001f000-\U0001faff])(\ufe0f?)(\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff]))?")


class _Forms(dict):
    """str.translate table that is filled as characters are met."""

    def __missing__(self, point: int) -> str | int:
        c = chr(point)
        kind = unicodedata.category(c)
        how = unicodedata.decomposition(c).partition(" ")[0]
        if point in (0xE000, 0xE001):
            to: str | int = c
        elif kind == "Cf" or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or point in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            to = ""
        elif kind == "Zs":
            to = " "
        elif point in (0x2010, 0x2011):
            to = "-"
        elif how in ("<wide>", "<narrow>") or 0xFB00 <= point <= 0xFB06 or 0xFB13 <= point <= 0xFB17:
            to = unicodedata.normalize("NFKC", c)
        elif point in (0x2028, 0x2029, 0x85, 0x0B, 0x0C):
            to = "\n"
        else:
            to = c
        self[point] = to
        return to


FORMS = _Forms()


def one_form(text: str) -> str:
    """The text with one form of each character; letters of other scripts stay."""
    if not text.isascii():
        if _EMOJI.search(text):  # what joins emoji is visible: hidden from the table as private characters
            text = _JOINED.sub(lambda m: m[1] + "\ue001" * bool(m[2]) + "\ue000" * bool(m[3]), text)
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(FORMS))
        text = text.replace("\ue000", "\u200d").replace("\ue001", "\ufe0f")
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")


def scripts(token: str) -> dict[str, int]:
    """Letters by script."""
    out: dict[str, int] = {}
    for m in _SCRIPT.finditer(token):
        out[m.lastgroup] = out.get(m.lastgroup, 0) + 1
    return out


def written_in(token: str, script: str) -> str | None:
    """The look-alike of a token in one script; None if a letter has no look-alike there."""
    out = []
    for c in token:
        m = _SCRIPT.match(c)
        own = m.lastgroup if m else None
        if own is None or own == script:
            out.append(c)
            continue
        latin = c if own == "LATIN" else _TO_LATIN[own].get(c)
        to = latin if script == "LATIN" else _FROM_LATIN[script].get(latin)
        if to is None:
            return None
        out.append(to)
    return unicodedata.normalize("NFC", "".join(out))


def odd_tokens(text: str) -> tuple[str, list[str]]:
    """Script of most letters of a text; its tokens of mixed or foreign script that could be repaired."""
    if not _FOREIGN.search(text):
        return "LATIN", []
    total = scripts(text)
    main = max(sorted(total), key=lambda s: total[s])
    odd = []
    for t in set(_TOKEN.findall(text)):
        own = scripts(t)
        if len(own) > 1 or (own and main not in own and written_in(t, main) is not None):
            odd.append(t)
    return main, odd


def canonical(documents: DataFrame) -> DataFrame:
    """(doc_id, text, base, canonical, main) of `documents(doc_id, text)`; main is the script of most letters."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base = [None if t is None else one_form(t) for t in b["text"]]
            found = [(None, []) if t is None else odd_tokens(t) for t in base]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "base": base, "main": [m for m, _ in found], "odd": [o for _, o in found]})

    docs = materialize(documents.select("doc_id", "text").mapInPandas(first, "doc_id long, text string, base string, main string, odd array<string>"), "lookalike-docs")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for token, main in zip(b["token"], b["main"]):
                own = scripts(token)
                for s in ("LATIN", "CYRILLIC", "GREEK"):
                    to = written_in(token, s)
                    if to is not None and (s in own or s == main):
                        out.append((token, main, to, own.get(s, 0) if len(own) > 1 else int(s == main)))
            yield pd.DataFrame(out, columns=["token", "main", "word", "letters"])

    odd = docs.select("main", F.explode("odd").alias("token")).distinct().mapInPandas(candidates, "token string, main string, word string, letters int")
    odd = materialize(odd, "lookalike-candidates")
    words = docs.select(F.explode(F.array_except(F.regexp_extract_all("base", F.lit(r"([\p{L}\p{N}\p{M}]+)"), F.lit(1)), "odd")).alias("word"))
    # only counts of candidate words are needed, so the vocabulary is cut down before it is counted
    counts = words.join(odd.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = (
        odd.join(counts, "word")
        .groupBy("token", "main")
        .agg(F.max_by("word", F.struct("letters", "n", "word")).alias("word"))
        .where("word <> token")
    )
    repairs = (
        docs.where(F.size("odd") > 0)
        .select("doc_id", "main", F.explode("odd").alias("token"))
        .distinct()
        .join(best, ["token", "main"])
        .groupBy("doc_id")
        .agg(F.collect_list("token").alias("tokens"), F.collect_list("word").alias("words"))
    )

    @F.pandas_udf("string")
    def apply(base: pd.Series, tokens: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for b, t, w in zip(base, tokens, words):
            known = dict(zip(t, w))
            out.append(_TOKEN.sub(lambda m: known.get(m[0], m[0]), b))
        return pd.Series(out, index=base.index)

    plain = docs.where(F.size("odd") == 0).select("doc_id", "text", "base", F.col("base").alias("canonical"), "main")
    mended = (
        docs.where(F.size("odd") > 0)
        .join(repairs, "doc_id", "left")
        .select("doc_id", "text", "base", F.when(F.col("tokens").isNull(), F.col("base")).otherwise(apply("base", F.coalesce("tokens", F.array().cast("array<string>")), F.coalesce("words", F.array().cast("array<string>")))).alias("canonical"), "main")
    )
    return plain.unionByName(mended)


def _key(text: Column) -> Column:
    """What two canonical texts share if they look the same: blanks at line ends and width of gaps do not show."""
    return F.sha2(F.trim(F.regexp_replace(F.regexp_replace(text, " +", " "), r" *\n *", "\n")), 256)


def alike_pairs(canon: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): documents that look the same but are not the same string.

    Only distinct strings of a group are paired; their documents are joined to each pair afterwards,
    so a million copies of one text and one variant of it cost a million rows, not their square.
    """
    seen = canon.where(F.col("canonical").rlike(r"\S")).select("doc_id", F.sha2("text", 256).alias("own"), _key(F.col("canonical")).alias("key")).distinct()
    seen = materialize(seen, "lookalike-keys")
    texts = seen.select("key", "own").distinct()
    several = texts.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("key")
    texts = materialize(texts.join(several, "key", "left_semi"), "lookalike-texts")
    pairs = texts.join(texts.withColumnRenamed("own", "other"), "key").where("own < other")
    left = seen.select("own", F.col("doc_id").alias("a"))
    right = seen.select(F.col("own").alias("other"), F.col("doc_id").alias("b"))
    return pairs.join(left, "own").join(right, "other").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
