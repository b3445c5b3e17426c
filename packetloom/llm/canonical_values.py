"""Mapping free-entered values to a canonical list (problem 1).

A prefix-filter set-similarity join. A canonical name is the set of its words, a code the set of its
characters with their places. A value's words are first read as words of the list (`read_words`):
exactly, with typing errors, as beginnings, contractions or initials of them; this is learned from
the list, so no aliases of its entries are kept here. Other words of up to three letters (of, the,
nos) do not count. Tokens are ordered by rarity, only the rare
prefix of each set is joined, length and position filters discard pairs that cannot reach the
threshold (half of all words for names, all characters for codes), and the Jaccard similarity of
the rest is computed exactly.

Of the candidates of a value the best is kept: a code before names, then the most similar one, then
the one with the fewest typing errors, if each word of the name stands in the value. A word may be missing if the list always
has it beside another word that is there (spinal beside stenosis).

Values mean no entry (`UNMATCHED`) if no candidate survives, or if the best of them are equally
good and lack a word. What follows " - " is tried with and without. Defined results: null and
blank values are no values; equal values are mapped once; other ties go to the smaller code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import materialize

UNMATCHED = "UNMATCHED"
THRESHOLD, CODE_THRESHOLD = 0.5, 1.0

#: Abbreviations in common medical use that are no beginning or contraction of their word (fixed values).
ABBREVIATIONS = {"l": "left", "r": "right", "cspine": "cervical", "tspine": "thoracic", "lspine": "lumbar", "fx": "fracture", "oa": "osteoarthritis", "op": "surgical", "si": "sacroiliac"}
NUMERALS = dict(zip("123456789", "one two three four five six seven eight nine".split()))
#: What scanning and typing make of digits (fixed values).
DIGITS = str.maketrans("OoQDIlL|SsBZzGg", "000011115582266")
_CODE = re.compile(r"(?<![A-Za-z0-9])([A-Za-z])([0-9OoQIl|SsBZzG])([0-9OoQIl|SsBZzG])(?:\s?[.·,\-]\s?|\s)?([0-9OoQIl|SsBZzG]{1,2})?(?![A-Za-z0-9])")
_LABEL = re.compile(r"^\s*(?:code|dx|icd\s?-?\s?1?0?)\s*[:#]?\s*(?=[A-Za-z]\w)", re.I)


def read_code(text: str) -> str | None:
    """The code a value starts with or has in brackets, in upper case without separators."""
    t = _LABEL.sub("", text.strip()).strip()
    m = _CODE.match(t)
    if m is None:
        inner = re.search(r"[(\[]\s*([A-Za-z]\w{2}\W{0,3}\w{0,2})\s*[)\]]", t)
        m = _CODE.fullmatch(inner[1]) if inner else None
    if m is None or (m.end() < len(t) and m.re.match(t) and t[m.end()] not in " .,;()[]-"):
        return None
    digits = (m[2] + m[3] + (m[4] or "")).translate(DIGITS)
    return m[1].upper() + digits if digits.isdigit() and len(digits) > 2 else None


def words_of(text: str) -> list[str]:
    """Words of a diagnosis in lower case, without codes; letters and digits part, numerals become words."""
    t = re.sub(r"[(\[]\s*[a-z]\d\d\W?\d{0,2}\s*[)\]]", " ", text.lower())
    t = re.sub(r"\b(\w+o)-(?=\w)", r"\1", re.sub(r"\b([ctl])-spine", r"\1spine", t))
    t = re.sub(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", " ", re.sub(r"[^\w]+", " ", t))
    return [NUMERALS.get(w, ABBREVIATIONS.get(w, w)) for w in t.split()]


def readings(text: str) -> list[list[str]]:
    """Word lists of a value: its parts before each " - ", so remarks behind can be left out."""
    parts = re.split(r"\s+-+\s+", _LABEL.sub("", text))
    out: list[list[str]] = []
    for part in parts:
        w = (out[-1] if out else []) + words_of(part)
        if w and (not out or w != out[-1]):
            out.append(w)
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between two words, most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def errors_allowed(word: str) -> int:
    n = len(word)
    return 1 if n <= 5 else 2 if n <= 8 else 3


def word_cost(right: str, seen: str) -> float | None:
    """Typing errors under which `seen` stands for `right`; None if it hardly does.

    Beginnings, contractions (first letter and order kept, without vowels or of three letters) and common stems count half an error and a
    little for every letter that is missing, initials more.
    """
    if right == seen:
        return 0.0
    most = errors_allowed(right)
    d: float = distance(right, seen, most)
    missing = (len(right) - len(seen)) / 100
    if right[0] == seen[0]:
        if len(seen) > 1 and right.startswith(seen):
            return min(d if d <= most else 9.0, 0.5 + missing)
        if len(seen) == 1:
            return 0.75 + missing
        rest, bare = iter(right), not re.search("[aeiou]", seen[1:])
        if len(seen) < len(right) and (bare and len(seen) <= 5 or len(seen) == 3) and (len(seen) > 2 or right[-1] == seen[-1]) and all(c in rest for c in seen):
            return min(d if d <= most else 9.0, 0.6 + missing)
        same = next((i for i, (x, y) in enumerate(zip(right, seen)) if x != y), min(len(right), len(seen)))
        if d > most and same >= 6 and same >= 0.7 * len(seen):
            return 0.5 + abs(missing)
    return d if d <= most else None


def explained(canon: list[str], words: list[str], implied: frozenset[str] | set[str] = frozenset()) -> float | None:
    """Typing errors under which every canonical word stands in `words`; None if one does not.

    A further word of the value counts a tenth of an error. A missing word counts one if it is `implied`,
    and only if no word of the value is left over that could be meant instead. Letters of one word may be
    the initials of several.
    """
    left = list(words)
    for w in words:  # initials: ddd for degenerative disc disease
        if 3 <= len(w) <= len(canon) and "".join(c[0] for c in canon).find(w) >= 0 and w not in canon:
            at = "".join(c[0] for c in canon).find(w)
            i = left.index(w)
            left[i : i + 1] = canon[at : at + len(w)]
    total, missing, open_ = 0.0, 0, []
    for c in sorted(canon, key=len, reverse=True):
        left.remove(c) if c in left else open_.append(c)
    for c in open_:
        costs = [(cost, i) for i, w in enumerate(left) if (cost := word_cost(c, w)) is not None]
        if costs:
            cost, at = min(costs)
            total += cost
            left.pop(at)
        elif c in implied:
            missing += 1
        else:
            return None
    return None if missing and (missing > 1 or any(len(w) > 3 for w in left)) else total + missing + len(left) / 10


def _records(values: DataFrame) -> DataFrame:
    """(value, record, words, tokens) of distinct texts: one record per reading with its words, and one for the code with its tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["value"]:
                code = read_code(v)
                if code:
                    out.append((v, 0, [], code_tokens(code)))
                out += [(v, n, w, []) for n, w in enumerate(readings(v), 1)]
            yield pd.DataFrame(out, columns=["value", "record", "words", "tokens"])

    return values.mapInPandas(run, "value string, record int, words array<string>, tokens array<string>")


def code_tokens(code: str) -> list[str]:
    """Characters of a code with their places, and its length."""
    bare = re.sub(r"[^A-Z0-9]", "", code.upper())
    return [f"{i}{c}" for i, c in enumerate(bare)] + [f"#{len(bare)}"]


def read_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, means): the words of the list that each of words(word) is best read as; several if equally good.

    A word meets those of the list that share three letters in a row with it, or its first letter.
    """

    def keyed(name: str, initial: int) -> DataFrame:
        source = words if name == "word" else vocabulary
        padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word"))), lambda i: F.substring(padded, i, F.lit(3)))
        # a beginning or contraction shares the first letter; long words share three letters somewhere
        first = F.when(F.length("word") <= initial, F.array(F.concat(F.lit("^"), F.substring("word", 1, 1)))).otherwise(F.array().cast("array<string>"))
        return source.select("word", F.explode(F.array_distinct(F.concat(grams, first))).alias("key")).withColumnRenamed("word", name)

    met = keyed("word", 6).join(keyed("means", 1_000_000), "key").select("word", "means").distinct()

    @F.pandas_udf("double")
    def cost(means: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([word_cost(m, w) if len(w) > 1 or m == w else None for m, w in zip(means, word)], index=word.index, dtype="float64")

    read = met.select("word", "means", cost("means", "word").alias("cost")).where(F.col("cost").isNotNull() & ~F.isnan("cost"))
    least = read.groupBy("word").agg(F.min("cost").alias("least"))
    return read.join(least, "word").where(F.col("cost") <= F.col("least") + 0.15).select("word", "means")


def _prefixed(records: DataFrame, key: list[str], rarity: DataFrame) -> DataFrame:
    """(key…, size, token, at): the rare prefix of each set of records(key…, tokens, size, threshold); `at` counts from 1.

    `size` may count tokens beside those given that the list does not have; they are the rarest.
    """
    long = records.select(*key, "size", "threshold", (F.col("size") - F.size("tokens")).alias("unknown"), F.explode("tokens").alias("token")).join(rarity, "token")
    order = Window.partitionBy(*key).orderBy("often", "token")
    keep = F.col("size") - F.ceil(F.col("size") * F.col("threshold") - 1e-9) + 1
    return long.withColumn("at", F.row_number().over(order) + F.col("unknown")).where(F.col("at") <= keep).select(*key, "size", "threshold", "token", "at")


def map_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(value, ref_code) of every distinct text of `values(value)`; reference has ref_code and ref_name."""
    distinct = values.select(F.trim("value").alias("value")).where(F.col("value").rlike(r"\S")).distinct()
    records = materialize(_records(distinct), "canonical-records").withColumn("rid", F.xxhash64("value", "record"))

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for code, name in zip(b["ref_code"], b["ref_name"]):
                out.append((code, 0, [], code_tokens(code)))
                if name and (w := words_of(name)):
                    out.append((code, 1, w, sorted(set(w))))
            yield pd.DataFrame(out, columns=["ref_code", "part", "ref_words", "ref_tokens"])

    ref = reference.where(F.col("ref_code").isNotNull()).select("ref_code", "ref_name").mapInPandas(entries, "ref_code string, part int, ref_words array<string>, ref_tokens array<string>")
    ref = materialize(ref, "canonical-plain")
    # a word is implied by another of its entry if the list has that one only beside it
    pairs = ref.where("part = 1").select("ref_code", F.explode("ref_tokens").alias("by"), "ref_tokens").select("ref_code", "by", F.explode("ref_tokens").alias("word"))
    both = pairs.groupBy("by", "word").agg(F.count(F.lit(1)).alias("n"))
    sure = both.join(both.where("by = word").select("by", F.col("n").alias("all")), "by").where("by <> word AND n = all").select("by", "word")
    implied = pairs.join(sure, ["by", "word"]).groupBy("ref_code").agg(F.collect_set("word").alias("implied"))
    ref = materialize(ref.join(implied, "ref_code", "left").withColumn("implied", F.coalesce("implied", F.array().cast("array<string>"))), "canonical-entries")

    vocabulary = ref.where("part = 1").select(F.explode("ref_tokens").alias("word")).distinct()
    said = records.where("record > 0").select("rid", F.explode(F.array_distinct("words")).alias("word"))
    # initials of three words or more in a row stand for these words
    names = ref.where("part = 1").select("ref_words", F.explode(F.sequence(F.lit(1), F.size("ref_words"))).alias("i"))
    runs = names.select("ref_words", "i", F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.size("ref_words") - F.col("i") + 1))).alias("n")).select(F.slice("ref_words", F.col("i"), F.col("n")).alias("run"), "n").where(F.size("run") == F.col("n"))
    initials = runs.select(F.array_join(F.transform("run", lambda w: F.substring(w, 1, 1)), "").alias("word"), F.explode("run").alias("means")).distinct().join(vocabulary, "word", "left_anti")
    distinct_words = said.select("word").distinct()
    means = read_words(distinct_words, vocabulary).unionByName(initials.join(distinct_words, "word")).distinct()
    means = materialize(means, "canonical-means")
    read = said.join(means, "word", "left").groupBy("rid").agg(F.collect_set("means").alias("tokens"), F.count_distinct(F.when(F.col("means").isNull() & (F.length("word") > 3), F.col("word"))).alias("unknown"))
    named = records.where("record > 0").select("rid", "value", "words").join(read, "rid").select("rid", "value", "words", "tokens", (F.size("tokens") + F.col("unknown")).alias("size"), F.lit(threshold).alias("threshold"))
    coded = records.where("record = 0").select("rid", "value", "words", "tokens", F.size("tokens").cast("bigint").alias("size"), F.lit(CODE_THRESHOLD).alias("threshold"))
    sets = materialize(named.unionByName(coded), "canonical-sets")

    entries_of = ref.withColumnRenamed("ref_tokens", "tokens").withColumn("size", F.size("tokens").cast("bigint")).withColumn("threshold", F.when(F.col("part") == 0, F.lit(CODE_THRESHOLD)).otherwise(F.lit(threshold)))
    rarity = entries_of.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    ours = _prefixed(sets, ["rid"], rarity)
    theirs = _prefixed(entries_of, ["ref_code", "part"], rarity).withColumnsRenamed({"size": "ref_size", "at": "ref_at"}).drop("threshold")
    t = F.col("threshold")
    need = F.ceil(t / (1 + t) * (F.col("size") + F.col("ref_size")) - 1e-9)
    met = (
        ours.join(theirs, "token")
        .where((F.col("ref_size") >= t * F.col("size") - 1e-9) & (F.col("size") >= t * F.col("ref_size") - 1e-9))
        .where(1 + F.least(F.col("size") - F.col("at"), F.col("ref_size") - F.col("ref_at")) >= need)
        .select("rid", "ref_code", "part")
        .distinct()
    )
    common = F.size(F.array_intersect("tokens", "ref_tokens"))
    similar = (
        met.join(sets, "rid")
        .join(ref, ["ref_code", "part"])
        .withColumn("jaccard", common / (F.col("size") + F.size("ref_tokens") - common))
        .where(F.col("jaccard") >= t - 1e-9)
    )

    @F.pandas_udf("double")
    def errors(canon: pd.Series, words: pd.Series, implied: pd.Series) -> pd.Series:
        memo: dict[tuple, float | None] = {}
        out = []
        for c, w, i in zip(canon, words, implied):
            key = (tuple(c), tuple(w))
            if key not in memo:
                memo[key] = explained(list(c), list(w), frozenset(i)) if len(c) else 0.0
            out.append(memo[key])
        return pd.Series(out, dtype="float64")

    checked = similar.withColumn("errors", F.when(F.col("part") == 0, F.lit(-1.0)).otherwise(errors("ref_words", "words", "implied"))).where(F.col("errors").isNotNull() & ~F.isnan("errors"))
    rank = F.struct(F.when(F.col("part") == 0, 0).otherwise(1).alias("named"), (-F.round("jaccard", 3)).alias("j"), "errors", (-F.size("ref_words")).alias("w"))
    per = checked.groupBy("value", "ref_code").agg(F.min(rank).alias("how"))
    best = per.groupBy("value").agg(F.min(F.struct("how", "ref_code")).alias("best"), F.min("how").alias("least"))
    ties = per.join(best, "value").where(F.col("how") == F.col("least")).groupBy("value").agg(F.count(F.lit(1)).alias("ties"))
    # a missing word counts one error: equally good entries then tell nothing
    settled = best.join(ties, "value").where(~((F.col("ties") > 1) & (F.col("least.errors") >= 1))).select("value", F.col("best.ref_code").alias("ref_code"))
    return distinct.join(settled, "value", "left").select("value", F.coalesce("ref_code", F.lit(UNMATCHED)).alias("ref_code"))
