"""Noise in text from scanned pages (problem 7).

Three kinds of damage are repaired: running headers and footers, words hyphenated across lines and
misread characters. Furniture shows itself by its form (page numbers, stamps, counts) or by
repetition: a top line that stands alone on many pages, or within lines of such form, but hardly
ever below them, where titles and text stand (`running_headers`).

A lexicon of all words of all page bodies, with their frequencies, is counted over the corpus. A
symmetric-delete index links rare words to frequent ones: a word with up to two misread units
(`c`, `ri`, `0`, ...) or any one letter left out meets a lexicon word treated alike. Pairs are
verified by a weighted edit distance: confusions of digits and signs cost least, those of letter
shapes more, any other edit most. Frequency, the words before and after (bigram counts), and the
packet's OCR confidence decide.

The lexicon is joined, not broadcast. Workers hold only its most frequent words (`COMMON_KEPT`, a
fixed bound) to skip those occurrences early; all other words meet the index by joins.

Defined results: null and blank pages give no rows; a page of furniture only gives an empty text;
lines are parted by "\\n" and counted from 1; equal rows come once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.name_variants import distance
from packetloom.session import materialize

#: What scanning makes of letters (fixed values): right unit -> misread units.
CONFUSIONS = {
    "e": ("c",), "t": ("f",), "i": ("1", "l"), "l": ("1", "i", "|"), "o": ("0",), "n": ("ri",), "s": ("5",), "a": ("@",), "d": ("cl",), "u": ("ii",), "m": ("rn",), "g": ("9", "q"), "h": ("b",), "w": ("vv",), "li": ("h",), "b": ("6", "8"), "z": ("2",), "S": ("5",), "O": ("0",), "I": ("1", "l"), "B": ("8",), "G": ("6",), "Z": ("2",), "A": ("@", "4"), "c": ("e", "("), "f": ("t",), "H": ("ll",), "rn": ("m",), "cl": ("d",),
}
MISREAD = {m: tuple(r for r, ms in CONFUSIONS.items() if m in ms) for ms in CONFUSIONS.values() for m in ms}
COMMON_KEPT = 20_000
#: A repair must be so many times as frequent as what it replaces.
RATIO = 4.0
OTHER_RATIO = 200.0
HYPHENS = "-­‐‑¬‒"
#: Weights of edits: a digit or sign for a letter, a letter shape for another, anything else.
SIGN, SHAPE, OTHER = 0.5, 1.0, 2.5
#: Above this length words meet by intact parts instead of by what is left out.
LONG, PART = 40, 13

_CORE = re.compile(r"[^\s.,;:()]+(?:[.,:][^\s.,;:()]+)*")
_WORD = re.compile(r"[A-Za-z][A-Za-z'’]*(?:[-‐‑][A-Za-z'’]+)*")
_BROKEN = re.compile(rf"(?P<left>[^\s.,;:()]*[A-Za-z0-9@|])(?P<mark>[{HYPHENS}])[ \t]*$")
_PAGE_NUMBER = re.compile(r"^[\s\-–|]*(?:[Pp]\S{0,3}\.?\s*)?[\dIlOo|]{1,4}(?:\s*(?:\S[fFt]|/)\s*\d{1,4})?[\s\-–|]*$")
_STAMP = re.compile(r"[\dOIl|]{1,2}/[\dOIl|]{1,2}/[\dOIl|]{2,4}\s+[\dOIl|]{1,2}:[\dOIl|]{2}")
_COUNTED = re.compile(r"(?:\s{2,}|\|\s*P\S{2,4}\s+)\d{1,4}(?:\s*(?:/|\S[fFt])\s*\d{1,4})?\s*$")
_CONFIDENTIAL = re.compile(r"\s-\s+[CGO0]\S{3}[I1lt]\S{4,7}\s*(?:\|.*)?$")
_PLAIN = str.maketrans("015@96", "olsagb")


def shadow(line: str) -> str:
    return " ".join(line.lower().translate(_PLAIN).split())


def is_furniture(line: str, first: bool) -> bool:
    """Whether a line at a page's edge has the form of a page number, stamp, count or confidential mark."""
    t = line.strip()
    return bool(
        _PAGE_NUMBER.match(t)
        or (first and _STAMP.search(t))
        or (_COUNTED.search(t) and not re.match(r"\s*[A-Z][a-z]+(?: [A-Za-z]+)*\s*:", t))
        or _CONFIDENTIAL.search(t)
    )


def furniture_lines(lines: list[str], headed: bool = False) -> set[int]:
    """Indexes of the furniture at the edges of a page; `headed`: the first other line at the top is a running header."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out: set[int] = set()
    for i in filled:
        if not is_furniture(lines[i], True):
            if not headed:
                break
            headed = False
        out.add(i)
    for i in reversed(filled):
        if i in out or not is_furniture(lines[i], False):
            break
        out.add(i)
    return out


def _inner(line: str) -> str:
    """What a line of furniture says beside stamp, count and mark."""
    t = line.strip()
    stamp = _STAMP.search(t)
    t = t[stamp.end() :] if stamp else t
    for end in (_COUNTED, _CONFIDENTIAL):
        m = end.search(t)
        t = t[: m.start()] if m else t
    return t.strip(" |-–")


def top_shapes(text: str) -> list[tuple[str, str, str | None]]:
    """(shape, place, shape of the next line) of the first lines of a page: "alone" at the top, "within" furniture, or "below" furniture."""
    out: list[tuple[str, str, str | None]] = []
    filled = (x for x in text.split("\n") if x.strip())
    for line in filled:
        if is_furniture(line, True):
            inner = shadow(_inner(line))
            out += [(inner, "within", None)] if " " in inner else []
            continue
        then = next(filled, None)
        out.append((shadow(line), "below" if out else "alone", shadow(then) if then else None))
        break
    return out


def running_headers(pages: DataFrame) -> DataFrame:
    """(packet_id, page_index, headed): pages whose first line that has no form of furniture is a running header.

    A shape is a header's if it stands alone at the top, or within furniture, of pages of two packets or more, and
    below furniture in at most one of twenty cases; without a case within furniture it must stand above
    different lines, as the first line of a text that is often repeated does not. Misread headers share a word at its place with one, and
    are within one edit of it for every eight letters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i, *x) for p, i, t in zip(b["packet_id"], b["page_index"], b["text"]) for x in top_shapes(t)]
            yield pd.DataFrame(rows, columns=["packet_id", "page_index", "shape", "place", "then"])

    tops = materialize(_page_rows(pages).mapInPandas(run, "packet_id string, page_index int, shape string, place string, then string"), "scan-tops")
    at = lambda place: F.sum((F.col("place") == place).cast("long")).alias(place)
    counted = tops.groupBy("shape").agg(at("alone"), at("within"), at("below"), F.approx_count_distinct("packet_id").alias("packets"), F.approx_count_distinct("then").alias("thens"))
    counted = materialize(counted, "scan-shapes")
    repeated = (F.col("packets") >= 2) & (F.col("below") * 20 <= F.col("alone") + F.col("within")) & ((F.col("within") >= 2) | ((F.col("alone") + F.col("within") >= 4) & (F.col("thens") >= 3)))
    known = counted.where(repeated).select("shape")
    other = counted.where(~repeated & (F.col("alone") > 0) & (F.col("below") == 0)).select("shape")
    words = lambda df, name: df.select(F.col("shape").alias(name), F.size(F.split("shape", " ")).alias("n"), F.posexplode(F.split("shape", " ")).alias("i", "word")).where("n > 1")
    met = words(other, "shape").join(words(known, "header"), ["n", "i", "word"]).where(F.abs(F.length("shape") - F.length("header")) <= F.length("header") / 8).select("shape", "header").distinct()

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, len(y) // 8) <= len(y) // 8 for x, y in zip(a, b)], index=a.index, dtype=bool)

    headers = known.union(met.where(near("shape", "header")).select("shape")).distinct()
    return tops.where("place = 'alone' OR place = 'below'").join(headers, "shape").select("packet_id", "page_index", F.lit(True).alias("headed")).distinct()


def _broken(line: str) -> re.Match | None:
    """The broken word at the end of a line, if there is one."""
    t = line.rstrip(" \t")
    return _BROKEN.search(line, max(t.rfind(" "), t.rfind("\t")) + 1) if t and t[-1] in HYPHENS else None


def tokens_of(lines: list[str], skip: set[int]) -> list[tuple[int, str, bool]]:
    """(line, word, begins a sentence) of a page body; a word broken over two lines is left out."""
    out: list[tuple[int, str, bool]] = []
    start = True
    broken_before = False
    for i, line in enumerate(lines):
        if i in skip:
            continue
        if not line.strip():
            start = True
            broken_before = False
            continue
        found = [(m[0], m.start(), m.end()) for m in _CORE.finditer(line)]
        broken = _broken(line) if i + 1 < len(lines) and lines[i + 1].strip() and i + 1 not in skip else None
        for j, (w, s, e) in enumerate(found):
            part = (j == 0 and broken_before) or (broken is not None and e > broken.start("left"))
            if not part:
                out.append((i, w, start))
            start = line[e : e + 1] in (".", ":") or (part and j == 0 and line[e : e + 1] == ".")
        broken_before = broken is not None
    return out


def breaks_of(lines: list[str], skip: set[int]) -> list[tuple[int, str, str]]:
    """(line, left part, right part) of words broken between a line and the next."""
    out = []
    for i, line in enumerate(lines[:-1]):
        if i in skip or i + 1 in skip:
            continue
        m = _broken(line)
        n = _CORE.search(lines[i + 1]) if m else None
        if n and not lines[i + 1][: n.start()].strip() and n[0][0].isalnum() | (n[0][0] == "@"):
            out.append((i, m["left"], n[0]))
    return out


def left_out(word: str, units: tuple[str, ...] | list[str], most: int) -> set[tuple[str, int]]:
    """The word with up to `most` of the units left out, with how many."""
    done = {(word, 0)}
    edge = {(word, 0)}
    for k in range(1, most + 1):
        after = set()
        for w, at in edge:
            for u in units:
                p = w.find(u, at)
                while p >= 0:
                    after.add((w[:p] + w[p + len(u) :], p))
                    p = w.find(u, p + 1)
        edge = after
        done |= {(w, k) for w, _ in after}
    return done


def parts_of(word: str, shifts: int) -> set[str]:
    """Beginning, middle and end of a long word: of two edits one leaves one of them intact; the middle may shift."""
    at = len(word) // 2 - PART // 2
    return {"<" + word[:PART], ">" + word[-PART:]} | {"=" + word[at + d : at + d + PART] for d in range(-shifts, shifts + 1)}


def misread_cost(right: str, seen: str, most: int = 2) -> float | None:
    """Weighted distance of `seen` from `right`: up to `most` confusions, or one other edit; None if they differ otherwise or not at all."""
    best: float | None = None
    edge: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, 0)}
    while edge:
        (i, j), (cost, edits) = edge.popitem()
        while True:
            if edits < most:
                for u in (right[i : i + 1], right[i : i + 2]):
                    for m in CONFUSIONS.get(u, ()):
                        if seen.startswith(m, j):
                            to, weight = (i + len(u), j + len(m)), cost + (SHAPE if m.isalpha() else SIGN)
                            if weight < edge.get(to, (99.0, 0))[0]:
                                edge[to] = (weight, edits + 1)
            if i >= len(right) or j >= len(seen) or right[i] != seen[j]:
                break
            i, j = i + 1, j + 1
        if i == len(right) and j == len(seen) and edits and (best is None or cost < best):
            best = cost
    if best is None and right != seen and distance(right, seen, 1) == 1:
        return OTHER
    return best


_RIGHT_UNITS = sorted(CONFUSIONS)
_SEEN_UNITS = sorted(MISREAD)


def _page_rows(pages: DataFrame) -> DataFrame:
    return pages.select("packet_id", F.posexplode("pages").alias("page_index", "text")).where(F.col("text").rlike(r"\S"))


def count_words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lexicon (word, n) and bigrams (a, b, n) of all page bodies of rows(text, headed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        pairs: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = [(w, None, n) for w, n in words.items()] + [(a, b, n) for (a, b), n in pairs.items()]
            words.clear()
            pairs.clear()
            return pd.DataFrame(rows, columns=["a", "b", "n"])

        for b in batches:
            for text, headed in zip(b["text"], b["headed"]):
                lines = text.split("\n")
                found = [w for _, w, _ in tokens_of(lines, furniture_lines(lines, headed))]
                words.update(found)
                low = [w.lower() for w in found]
                pairs.update(zip(low, low[1:]))
            if len(pairs) > 200_000:
                yield out()
        yield out()

    counted = materialize(rows.select("text", "headed").mapInPandas(run, "a string, b string, n long"), "scan-counts")
    words = counted.where("b IS NULL").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))
    pairs = counted.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return materialize(words, "scan-lexicon"), materialize(pairs, "scan-bigrams")


def corrections(lexicon: DataFrame, asked: DataFrame) -> DataFrame:
    """(seen, right, cost, n_seen, n_right): lexicon words that confusions turn into the asked(word, n) ones."""

    def deletes(units: list[str], shifts: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out: list[tuple] = []
                for w, n in zip(b["word"], b["n"]):
                    if len(w) > LONG - 2:
                        out += [(w, n, d) for d in parts_of(w, shifts)]
                    if len(w) <= LONG + 2:
                        rests = {d for d, k in left_out(w, units, 2) if k and d} | ({w[:i] + w[i + 1 :] for i in range(len(w))} | {w} if len(w) > 3 else set())
                        out += [(w, n, d) for d in rests]
                yield pd.DataFrame(out, columns=["word", "n", "rest"])

        return run

    wordlike = F.col("word").rlike(r"^[A-Za-z][A-Za-z'’]*(?:[-\x{2010}\x{2011}][A-Za-z'’]+)*$")
    schema = "word string, n long, rest string"
    known = lexicon.where(wordlike & (F.length("word") >= 2) & (F.col("n") >= 2))
    index = known.mapInPandas(deletes(_RIGHT_UNITS, 0), schema).select(F.col("word").alias("right"), F.col("n").alias("n_right"), F.xxhash64("rest").alias("rest"))
    plausible = F.col("word").rlike(r"^[A-Za-z0-9@|('’\-\x{2010}\x{2011}]*[A-Za-z@][A-Za-z0-9@|'’\-\x{2010}\x{2011}]*$") & ~F.col("word").rlike(r"[0-9]{4,}") & (F.length("word") >= 2)
    looked = asked.where(plausible).mapInPandas(deletes(_SEEN_UNITS, 3), schema).select(F.col("word").alias("seen"), F.col("n").alias("n_seen"), F.xxhash64("rest").alias("rest"))
    pairs = looked.join(index, "rest").where((F.col("seen") != F.col("right")) & (F.col("n_right") >= F.col("n_seen") * F.lit(RATIO))).select("seen", "right", "n_seen", "n_right").distinct()

    @F.pandas_udf("double")
    def cost(right: pd.Series, seen: pd.Series) -> pd.Series:
        return pd.Series([misread_cost(r, s) or 0.0 for r, s in zip(right, seen)], index=right.index, dtype="float64")

    # any other edit than a confusion also makes one word of another, so it needs a rare form of a long and frequent word
    plain = (F.col("cost") < OTHER) | ((F.length("right") >= 6) & (F.col("n_right") >= F.col("n_seen") * F.lit(OTHER_RATIO)))
    return pairs.withColumn("cost", cost("right", "seen")).where((F.col("cost") > 0) & plain)


def occurrences(rows: DataFrame, common: list[str]) -> DataFrame:
    """Furniture lines, broken words and all words that are not common, of every page of rows(packet_id, page_index, text, headed)."""
    kept = frozenset(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for packet, page, text, headed in zip(b["packet_id"], b["page_index"], b["text"], b["headed"]):
                lines = text.split("\n")
                skip = furniture_lines(lines, headed)
                out += [(packet, page, i + 1, "running", None, None, None, None, False) for i in sorted(skip)]
                out += [(packet, page, i + 1, "hyphen", x + y, f"{x}-{y}", None, None, False) for i, x, y in breaks_of(lines, skip)]
                found = tokens_of(lines, skip)
                for j, (i, w, start) in enumerate(found):
                    if w not in kept:
                        before = found[j - 1][1].lower() if j else None
                        after = found[j + 1][1].lower() if j + 1 < len(found) else None
                        out.append((packet, page, i + 1, "misread", w, None, before, after, start))
            yield pd.DataFrame(out, columns=["packet_id", "page_index", "line_no", "kind", "word", "joined", "before", "after", "start"])

    return rows.mapInPandas(run, "packet_id string, page_index int, line_no int, kind string, word string, joined string, before string, after string, start boolean")


def repairs(pages: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """(packet_id, page_index, line_no, kind, word, fixed) of pages(packet_id, pages).

    `confidence(packet_id, ocr_confidence)`, if given, makes repairs of well-read packets stricter.
    """
    rows = _page_rows(pages).join(running_headers(pages), ["packet_id", "page_index"], "left").withColumn("headed", F.coalesce("headed", F.lit(False)))
    rows = materialize(rows, "scan-pages")
    lexicon, bigrams = count_words(rows)
    fixes = materialize(corrections(lexicon, lexicon), "scan-fixes")
    common = [r["word"] for r in lexicon.join(fixes.select(F.col("seen").alias("word")).distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(COMMON_KEPT).select("word").collect()]
    found = materialize(occurrences(rows, common), "scan-occurrences")

    running = found.where("kind = 'running'").select("packet_id", "page_index", "line_no", "kind", F.lit(None).cast("string").alias("word"), F.lit("").alias("fixed"))

    # words: the candidates of each occurrence, judged by cost, case, neighbours and frequency
    words = found.where("kind = 'misread'").join(fixes.withColumnRenamed("seen", "word"), "word").withColumn("at", F.xxhash64("packet_id", "page_index", "line_no", "word", "before", "after"))
    if confidence is not None:
        words = words.join(confidence.select("packet_id", "ocr_confidence"), "packet_id", "left")
        odd = F.col("word").rlike(r"[0-9@|(]")  # no letters at all: a misread beyond doubt
        strict = F.when(F.col("ocr_confidence") >= 95, 3.0).when(F.col("ocr_confidence") >= 85, 1.5).otherwise(1.0)
        words = words.where(odd | (F.col("n_right") >= F.col("n_seen") * RATIO * strict))
    low = F.lower("right")
    one = bigrams.select(F.col("a").alias("before"), F.col("b").alias("low"), F.col("n").alias("n_before"))
    two = bigrams.select(F.col("b").alias("after"), F.col("a").alias("low"), F.col("n").alias("n_after"))
    several = words.withColumn("low", low).join(one, ["before", "low"], "left").join(two, ["after", "low"], "left").na.fill(0, ["n_before", "n_after"])
    capital = F.col("right").substr(1, 1).rlike("[A-Z]")
    # a sentence begins with a capital; inside one a word has the case in which it is frequent
    case = F.when(F.col("start") == capital, 0).otherwise(1)
    # an edit that is no confusion must be borne out by the words on both sides
    several = several.where((F.col("cost") < OTHER) | ((F.col("n_before") > 0) & (F.col("n_after") > 0)))
    context = F.least(F.lit(3.0), F.log10(1 + F.col("n_before")) + F.log10(1 + F.col("n_after")))
    score = F.struct((F.col("cost") + 0.6 * case - 0.15 * context).alias("weight"), (-F.col("n_right")).alias("often"), "right")
    mended = several.groupBy("packet_id", "page_index", "line_no", "word", "at").agg(F.min_by("right", score).alias("fixed")).select("packet_id", "page_index", "line_no", F.lit("misread").alias("kind"), "word", "fixed")

    # broken words: joined or with their own hyphen, whichever the lexicon knows better; then misreads in them
    broken = found.where("kind = 'hyphen'").select("packet_id", "page_index", "line_no", F.col("word").alias("plain"), F.col("joined").alias("hyphened")).distinct()
    forms = broken.select(F.explode(F.array("plain", "hyphened")).alias("word")).distinct()
    counted = forms.join(lexicon, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    best = Window.partitionBy("word").orderBy("cost", F.desc("n_right"), "right")  # candidates of one word
    fixed_forms = corrections(lexicon, counted).where(F.col("cost") < OTHER).withColumnRenamed("seen", "word").withColumn("rank", F.row_number().over(best)).where("rank = 1").select("word", "right", "n_right")
    judged = materialize(
        counted.join(fixed_forms, "word", "left").select("word", F.coalesce("right", "word").alias("right"), F.greatest("n", F.coalesce("n_right", F.lit(0))).alias("n")),
        "scan-forms",
    )
    plain = judged.select(F.col("word").alias("plain"), F.col("right").alias("as_plain"), F.col("n").alias("n_plain"))
    own = judged.select(F.col("word").alias("hyphened"), F.col("right").alias("as_hyphened"), F.col("n").alias("n_hyphened"))
    whole = (
        broken.join(plain, "plain")
        .join(own, "hyphened")
        .select("packet_id", "page_index", "line_no", F.lit("hyphen").alias("kind"), F.col("hyphened").alias("word"), F.when(F.col("n_hyphened") > F.col("n_plain"), F.col("as_hyphened")).otherwise(F.col("as_plain")).alias("fixed"))
    )
    return running.unionByName(mended).unionByName(whole)


def repaired_pages(pages: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """(packet_id, page_index, text): every page as continuous paragraphs, furniture removed and words repaired."""
    done = repairs(pages, confidence).groupBy("packet_id", "page_index").agg(F.collect_list(F.struct("line_no", "kind", "word", "fixed")).alias("fixes"))
    rows = pages.select("packet_id", F.posexplode_outer("pages").alias("page_index", "text")).where("page_index IS NOT NULL").join(done, ["packet_id", "page_index"], "left")

    @F.pandas_udf("string")
    def rebuild(text: pd.Series, fixes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _rebuild(t, [] if f is None else list(f)) for t, f in zip(text, fixes)], index=text.index, dtype=object)

    return rows.select("packet_id", "page_index", rebuild("text", "fixes").alias("text"))


def _rebuild(text: str, fixes: list[dict]) -> str:
    lines = text.split("\n")
    by: dict[int, list[dict]] = {}
    for f in fixes:
        by.setdefault(f["line_no"] - 1, []).append(f)
    skip = {i for i, fs in by.items() if any(f["kind"] == "running" for f in fs)}
    carried: str | None = None
    out: list[str] = []
    for i, line in enumerate(lines):
        if i in skip:
            continue
        swaps = {f["word"]: f["fixed"] for f in by.get(i, ()) if f["kind"] == "misread"}
        if carried is not None:
            line = _CORE.sub("", line, count=1).strip() if _CORE.search(line) else line
            line, carried = f"{carried}{'' if line[:1] in '.,;:)' else ' '}{line}", None
        line = _CORE.sub(lambda m: swaps.get(m[0], m[0]), line)
        whole = next((f["fixed"] for f in by.get(i, ()) if f["kind"] == "hyphen"), None)
        m = _broken(line) if whole else None
        if m:
            line, carried = line[: m.start("left")].rstrip(), whole
        out.append(line.strip())
    if carried is not None:
        out.append(carried)
    paragraphs: list[str] = []
    open_ = False
    for line in out:
        if not line:
            open_ = False
        elif open_ and not re.match(r"[A-Z][A-Za-z0-9 -]{1,30}(?::| - )", line):
            paragraphs[-1] += " " + line
        else:
            paragraphs.append(line)
            open_ = not re.match(r"[A-Z][A-Za-z0-9 -]{1,30}(?::| -\s*$| - )|[A-Z ]{8,}$|(?:[A-Z]\w+(?: (?:of|to|for|and|the))?(?: |$)){2,7}$", line)
    return "\n\n".join(paragraphs)
