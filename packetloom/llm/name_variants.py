"""Variant spellings of names typed by people (problem 2).

A pigeonhole segment join. A name is read as given name and surname (both orders where no comma
tells), or as an organisation in a plain word order with long forms for abbreviations. A form of
k + 1 segments shares at least one of them, slightly shifted, with every form within k edits; so
segments are put into an inverted index, substrings around their places are looked up, and only
those pairs are verified with a banded edit distance, word by word.

Short forms of given names come from rules (`may_mean`: beginnings, endings, contractions), from a
few common English ones no rule tells, and from the corpus (`learned_links`): two given names that
keep standing for each other beside one surname, in one field of one packet or at one birth date.

Verified pairs become groups: a spelling joins the nearest better attested one (first those
written as in a roster, "Given Surname, CREDENTIAL", then the more frequent). A group with a short
form joins that of the full form if there is only one nearest; so does a name with an initial only,
and if there are several it stays with the spellings it agrees with otherwise. Differing middle
initials or credentials part names.

Defined results: nulls, blanks and placeholder writings are no names; names are compared within
their block only (patients of one birth date); equal strings are one name; a name alone in its
group gives no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.survivors import is_real
from packetloom.session import materialize

#: Edits allowed in one word.
EDITS = 2
#: Edits the segments of a form must withstand: a swap of neighbours counts one (see `lookups`).
FULL_EDITS, SURNAME_EDITS = 3, 2
#: Added to the errors of two names whose surnames agree and whose given names may be forms of each other.
ASK = 100.0

#: Short forms in common English use that no rule of `may_mean` tells (fixed values).
IRREGULAR = {
    "bess": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "katherine", "chuck": "charles", "dick": "richard", "dot": "dorothy", "dotty": "dorothy",
    "gail": "abigail", "ginny": "virginia", "hal": "harold", "hank": "henry", "harry": "harold", "jack": "john", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "kate": "katherine", "kit": "katherine", "kitty": "katherine",
    "larry": "lawrence", "liz": "elizabeth", "lizzie": "elizabeth", "lou": "louis", "madge": "margaret", "maggie": "margaret", "meg": "margaret", "mick": "michael", "mike": "michael", "molly": "mary", "nancy": "ann", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "patsy": "patricia", "peg": "margaret", "peggy": "margaret", "polly": "mary",
    "rick": "richard", "sally": "sarah", "sandy": "alexander", "steve": "stephen", "ted": "theodore", "teddy": "theodore", "tina": "christina", "toby": "tobias", "tony": "anthony", "trish": "patricia", "wm": "william",
}
CREDENTIALS = frozenset("md do np pac dpt rn phd dc dds dpm pa pt ot lcsw aprn fnp".split())
TITLES = frozenset("dr doctor mr mrs ms miss prof".split())
LEGAL = frozenset("llc inc pc pllc ltd corp co lp llp pa".split())
#: Words and short forms of organisations' names (fixed values).
ORGANISATION = {
    "ctr": "center", "cntr": "center", "centre": "center", "svcs": "services", "svc": "services", "pt": "physical therapy", "grp": "group", "ortho": "orthopedic", "assoc": "associates", "assocs": "associates", "med": "medical", "rehab": "rehabilitation", "inst": "institute", "clnc": "clinic", "cln": "clinic", "dept": "department", "neuro": "neurology", "img": "imaging", "imag": "imaging", "phys": "physical", "ther": "therapy", "hosp": "hospital",
    "center": "center", "services": "services", "group": "group", "orthopedic": "orthopedic", "associates": "associates", "medical": "medical", "rehabilitation": "rehabilitation", "institute": "institute", "clinic": "clinic", "department": "department", "neurology": "neurology", "imaging": "imaging", "physical": "physical", "therapy": "therapy", "hospital": "hospital", "spine": "spine", "pain": "pain", "health": "health", "care": "care",
}
_LONG_FORMS = tuple(sorted({w for v in ORGANISATION.values() for w in v.split() if len(w) > 5}))
_ROSTER = re.compile(r"[A-Z][a-z]+ [A-Z][a-z]+, (?:MD|DO|NP|PA-C|DPT|RN|PhD|DC)")


def distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between two strings within a band; most + 1 if more."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        now = [far] * (m + 1)
        if i <= most:
            now[0] = i
        x, least = a[i - 1], now[0]
        for j in range(max(1, i - most), min(m, i + most) + 1):
            y = b[j - 1]
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now[j] = d
            least = min(least, d)
        if least > most:
            return far
        before, row = row, now
    return min(row[m], far)


@lru_cache(100_000)
def _org_word(w: str) -> str | None:
    """Long form of an organisation word, typing errors allowed."""
    if w in ORGANISATION:
        return ORGANISATION[w]
    if len(w) > 5:
        for long in _LONG_FORMS:
            if distance(w, long, 1) < 2:
                return long
    return None


def read_name(name: str) -> dict:
    """What a typed name says.

    kind: person or org; readings: (given, surname, short) in every possible order, the likely one
    first, or ("", joined words, False) of an organisation; middle; credential; roster.
    """
    t = re.sub(r"\b(?:[A-Za-z]\.){2,}(?:[A-Za-z]\b)?", lambda m: m[0].replace(".", ""), name.strip())
    t = re.sub(r"\bp\.?\s?a\.?\s?-\s?c\b\.?", "pac", t.lower())
    raw = re.findall(r"[^\s,.]+\.?|,", t)
    words = [(w.rstrip("."), w.endswith(".")) for w in raw]
    plain = [w for w, _ in words if w != ","]
    long = [_org_word(w) for w in plain]
    if sum(x is not None for x in long) >= 2 or (any(x is not None for x in long) and not any(w in CREDENTIALS - LEGAL for w in plain) and len([w for w in plain if w not in LEGAL]) > 2):
        body = [w for w, _ in words if w not in LEGAL and w != "the"]
        while body and body[-1] == ",":
            body.pop()
        if "," in body:
            at = len(body) - 1 - body[::-1].index(",")
            body = body[at + 1 :] + body[:at]
        elif "of" in body:
            at = body.index("of")
            body = body[at + 1 :] + body[:at]
        joined = "".join((_org_word(w) or w) for w in body if w not in (",", "of")).replace(" ", "")
        return {"kind": "org", "readings": [("", joined, False)], "middle": "", "credential": "", "roster": False}
    credential = ""
    while words and (words[-1][0] in CREDENTIALS or words[-1][0] == ","):
        w = words.pop()[0]
        credential = w if w != "," else credential
    while words and words[0][0] in TITLES:
        words.pop(0)
    names = [w for w, _ in words]
    if "," in names:
        at = names.index(",")
        family, own = [x for x in words[:at] if x[0] != ","], [x for x in words[at + 1 :] if x[0] != ","]
        middle = next((w for w, _ in own[1:] if len(w) == 1), "")
        readings = [(own[0], family[-1])] if own and family else []
    else:
        middle = ""
        if len(words) > 2:
            inner = [i for i, (w, _) in enumerate(words) if len(w) == 1 and i > 0]
            if inner:
                middle = words[inner[-1]][0]
                words = [x for i, x in enumerate(words) if i != inner[-1]]
            elif len(words[0][0]) > 1:
                words = [words[0], words[-1]]
        readings = [(words[0], words[1]), (words[1], words[0])] if len(words) == 2 else []
        if len(words) == 2 and (len(words[0][0]) == 1 or words[0][1]):
            readings = readings[:1]
        elif len(words) == 2 and (len(words[1][0]) == 1 or words[1][1]):
            readings = readings[1:]
    out = []
    for (g, dotted), (s, _) in readings:
        g, s = re.sub(r"[^\w]", "", g), re.sub(r"[^\w]", "", s)
        if g and len(s) > 1:
            out.append((g, s, len(g) == 1 or dotted))
    return {"kind": "person", "readings": out, "middle": middle, "credential": credential, "roster": bool(_ROSTER.fullmatch(name))}


def stem(nick: str) -> str:
    """A given name without a fond ending: danny -> dan, charlie -> charl."""
    base = re.sub(r"(?:ie|ey|i|e|(?<=[b-df-hj-np-tv-xz]{2})y)$", "", nick)  # one consonant before y is a name of its own: mary
    return base[:-1] if len(base) > 2 and base[-1] == base[-2] else base


def sound(name: str) -> str:
    """Letters that sound alike in one spelling: joss and jocelyn, mike and michael begin alike."""
    return re.sub("c|ck", "k", re.sub("c(?=[eiy])", "s", name.replace("ph", "f"))).replace("kk", "k")


def may_mean(nick: str, formal: str) -> bool:
    """Whether one given name can be short for another by its letters."""
    if len(nick) >= len(formal) or len(nick) < 2:
        return False
    if IRREGULAR.get(nick) == formal:
        return True
    base = stem(nick)
    if len(base) > 1 and (formal.startswith((nick, base)) or sound(formal).startswith(sound(base))):
        return True
    if len(nick) > 3 and formal.endswith(nick):
        return True
    rest = iter(formal)  # a contraction keeps first and last letter and the order
    return 1 < len(nick) <= 4 and nick[0] == formal[0] and nick[-1] == formal[-1] and all(c in rest for c in nick)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of the k + 1 even segments of a form."""
    parts = k + 1
    small, more = divmod(length, parts)
    sizes = [small + (i >= parts - more) for i in range(parts)]
    starts = [sum(sizes[:i]) for i in range(parts)]
    return list(zip(starts, sizes))


def withstood(length: int, k: int) -> int:
    """Edits for which an indexed form is cut: of words up to four letters only one is accepted, see `agree`."""
    return k if k > SURNAME_EDITS or length > 4 else 1


def lookups(form: str, k: int) -> Iterator[tuple[int, int, str]]:
    """(length of the other form, segment number, substring) to look up; shifts that edits on either side allow.

    A swap across a border counts for the segment before it; the one after it is met by undoing the swap.
    """
    n = len(form)
    for length in range(max(2, n - k), n + k + 1):
        cut = withstood(length, k)
        if length <= cut or abs(n - length) > cut:
            continue
        delta = n - length
        for i, (start, size) in enumerate(segments(length, cut)):
            low = max(0, start - i, start + delta - (cut - i))
            high = min(n - size, start + i, start + delta + (cut - i))
            for at in range(low, high + 1):
                yield length, i, form[at : at + size]
                if i and at and form[at - 1] != form[at]:
                    yield length, i, form[at - 1] + form[at + 1 : at + size]


def agree(a: tuple, b: tuple) -> float | None:
    """Typing errors between two readings (given, surname, short); None if they name different people."""
    most = 1 if min(len(a[1]), len(b[1])) <= 4 else EDITS
    surname = distance(a[1], b[1], most)
    if surname > most:
        return None
    if not a[0] and not b[0]:
        return float(surname)
    if a[2] or b[2]:
        x, y = (a[0], b[0]) if len(a[0]) <= len(b[0]) else (b[0], a[0])
        if y.startswith(x):
            return surname + 0.25
        if may_mean(x, y):
            return surname + 0.5
        rest = iter(y)  # a contraction keeps the first letter and the order
        return surname + 0.5 if len(x) > 2 and x[0] == y[0] and all(c in rest for c in x) else None
    most = 1 if min(len(a[0]), len(b[0])) <= 4 else EDITS
    given = distance(a[0], b[0], most)
    if given > most or given + surname > 3:
        return surname + ASK if a[0] != b[0] else None
    return float(given + surname)


_READINGS = "array<struct<given:string,surname:string,short:boolean>>"


def read_names(names: DataFrame) -> DataFrame:
    """names(kind, block, name, n) with what each name says; adds id, a hash of kind, block and name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [read_name(x) for x in b["name"]]
            yield b.assign(
                what=[s["kind"] for s in said],
                readings=[[{"given": g, "surname": s, "short": x} for g, s, x in r["readings"]] for r in said],
                middle=[s["middle"] for s in said],
                credential=[s["credential"] for s in said],
                roster=[s["roster"] for s in said],
                short=[bool(s["readings"]) and all(x for _, _, x in s["readings"]) for s in said],
            )

    read = names.mapInPandas(run, f"kind string, block string, name string, n long, what string, readings {_READINGS}, middle string, credential string, roster boolean, short boolean")
    return read.withColumn("id", F.xxhash64("kind", "block", "name")).where(F.size("readings") > 0)


def learned_links(read: DataFrame, together: DataFrame) -> DataFrame:
    """(nick, formal): given names that stand for each other in the corpus.

    `together(place, kind, block, name)` tells which names stood in one place: one field of one packet, or one
    birth date. Where several given names stand in one place beside one surname, each speaks for its
    link with the longest that is borne with three surnames or more (so hardly misspelt). Two surnames
    must do so, and a fifth of all that is said of the short name. Counts only, no pairs of a place.
    """
    first = F.col("readings")[0]
    person = read.where((F.col("what") == "person") & ~first["short"]).select("id", first["given"].alias("given"), first["surname"].alias("surname"))
    borne = person.groupBy("given").agg(F.countDistinct("surname").alias("surnames")).where("surnames >= 3").select("given")
    seen = together.select("place", F.xxhash64("kind", "block", "name").alias("id")).join(person, "id").select("place", "surname", "given").distinct()
    longest = seen.join(borne, "given").groupBy("place", "surname").agg(F.max(F.struct(F.length("given"), "given"))["given"].alias("formal"))
    said = seen.join(longest, ["place", "surname"]).where(F.length("given") < F.length("formal")).groupBy(F.col("given").alias("nick"), "formal").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("surname").alias("surnames"))
    said = materialize(said, "names-said-of")
    all_of = said.groupBy("nick").agg(F.sum("times").alias("all"))
    return said.join(all_of, "nick").where((F.col("surnames") >= 2) & (F.col("times") * 5 >= F.col("all"))).select("nick", "formal")


def _entries(read: DataFrame, look_up: bool) -> DataFrame:
    """Index entries, or lookups, of every form: full names and organisations, surnames under an initial or ending of the given name."""

    def given_keys(given: str, short: bool, formals: list[str]) -> set[str]:
        keys = {f"initial {given[0]}"} if short or not look_up or len(given) <= 7 else set()
        if look_up:
            keys |= {f"initial {f[0]}" for f in (*formals, *([IRREGULAR[given]] if given in IRREGULAR else []))}
        if not short and len(given) > (3 if look_up else 4):
            keys.add(f"ending {given[-3:]}")
        return keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for ident, space, readings, formals in zip(b["id"], b["space"], b["readings"], b["formals"]):
                forms: set[tuple[str, str]] = set()
                for first, r in zip((True, False), readings):  # the index has both orders, so one is enough to look up a whole name
                    g, s = r["given"], r["surname"]
                    if not r["short"] and (first or not look_up):
                        forms.add(("full", g + s))
                    if g:
                        forms |= {(key, s) for key in given_keys(g, r["short"], formals)}
                for how, form in forms:
                    k = FULL_EDITS if how == "full" else SURNAME_EDITS
                    if look_up:
                        out += [(ident, f"{space}|{how}|{n}|{i}|{x}") for n, i, x in lookups(form, k)]
                    else:
                        cut = withstood(len(form), k)
                        out += [(ident, f"{space}|{how}|{len(form)}|{i}|{form[at : at + size]}") for i, (at, size) in enumerate(segments(len(form), cut))]
            yield pd.DataFrame(out, columns=["id", "entry"])

    space = F.concat_ws("|", "kind", "block", "what").alias("space")
    return read.select("id", space, "readings", "formals").mapInPandas(run, "id long, entry string").select("id", F.xxhash64("entry").alias("entry"))


def verified_pairs(read: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, errors, loose): ids of names that agree; where `loose`, the given name of a is short for that of b."""
    index = _entries(read, False).withColumnRenamed("id", "other")
    asked = _entries(read, True)
    some = asked.join(index, "entry").where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    detail = read.select("id", "readings", "middle", "credential", "roster")

    @F.pandas_udf("errors double, nick string, formal string, turned boolean, known boolean")
    def judged(ra: pd.Series, rb: pd.Series, ma: pd.Series, mb: pd.Series, ca: pd.Series, cb: pd.Series, oa: pd.Series, ob: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for x, y, m, n, c, d, o, p in zip(ra, rb, ma, mb, ca, cb, oa, ob):
            best: tuple = (None, None, None, None, None)
            if not (m and n and m != n) and not (c and d and c != d):
                for r in x:
                    for s in y:
                        e = agree((r["given"], r["surname"], r["short"]), (s["given"], s["surname"], s["short"]))
                        if e is None or (best[0] is not None and e >= best[0]):
                            continue
                        if e < ASK:
                            best = (e, None, None, None, None)
                            continue
                        turned = len(r["given"]) > len(s["given"])
                        nick, formal = (s["given"], r["given"]) if turned else (r["given"], s["given"])
                        if len(nick) < len(formal):
                            best = (e, nick, formal, turned, may_mean(nick, formal))
            out.append((None, None, None, None, None) if best[0] is not None and 0 < best[0] < ASK and o and p else best)
        return pd.DataFrame(out, columns=["errors", "nick", "formal", "turned", "known"]).astype({"errors": "float64"})

    left = detail.select(*[F.col(c).alias(f"{c}_a") for c in detail.columns])
    right = detail.select(*[F.col(c).alias(f"{c}_b") for c in detail.columns])
    checked = (
        some.join(left, F.col("a") == F.col("id_a"))
        .join(right, F.col("b") == F.col("id_b"))
        .select("a", "b", judged("readings_a", "readings_b", "middle_a", "middle_b", "credential_a", "credential_b", "roster_a", "roster_b").alias("x"))
        .select("a", "b", "x.*")
        .where(F.col("errors").isNotNull() & ~F.isnan("errors"))
    )
    checked = materialize(checked, "names-checked")
    strict = checked.where(F.col("errors") < ASK).select("a", "b", "errors", F.lit(False).alias("loose"))
    ask = checked.where(F.col("errors") >= ASK)
    known = links.withColumn("linked", F.lit(True))
    loose = (
        ask.join(known, ["nick", "formal"], "left")
        .where("known OR linked")
        .select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("b"), (F.col("errors") - ASK + F.when(F.col("linked"), 0.1).otherwise(0.2)).alias("errors"), F.lit(True).alias("loose"))
    )
    return strict.unionByName(loose)


def _settled(cross: DataFrame, tree: DataFrame, per: str) -> DataFrame:
    """(id, host): where the edges of `cross` lead the nearest of their ends to one group only, that group.

    `per`: judged for every name ("a") or together for all of its group ("own").
    """
    hosts = (
        cross.join(tree.select(F.col("id").alias("a"), F.col("root").alias("own")), "a")
        .join(tree.select(F.col("id").alias("b"), F.col("root").alias("host")), "b")
        .where("own <> host")
        .groupBy(F.col(per).alias("id"), "host")
        .agg(F.min("errors").alias("errors"))
    )
    nearest = hosts.groupBy("id").agg(F.min("errors").alias("errors"))
    return hosts.join(nearest, ["id", "errors"]).groupBy("id").agg(F.min("host").alias("host"), F.max("host").alias("last")).where("host = last").select("id", "host")


def groups(read: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root): the group of every name that has one; root is the id of its best attested spelling."""
    pairs = verified_pairs(read, links)
    both = pairs.unionByName(pairs.where("NOT loose").select(F.col("b").alias("a"), F.col("a").alias("b"), "errors", "loose"))
    rank = F.struct(F.col("roster").cast("int").alias("roster"), "n", "id")
    worth = read.select("id", "short", rank.alias("rank"))
    mine = worth.select(F.col("id").alias("a"), F.col("short").alias("short_a"), F.col("rank").alias("rank_a"))
    theirs = worth.select(F.col("id").alias("b"), F.col("short").alias("short_b"), F.col("rank").alias("rank_b"))
    edges = materialize(both.join(mine, "a").join(theirs, "b"), "names-edges")
    near = F.struct((-F.col("rank_b.roster")).alias("roster"), "errors", (-F.col("rank_b.n")).alias("n"), "b")
    # full names and names of initials each follow their nearest better attested spelling
    upward = edges.where((F.col("short_a") == F.col("short_b")) & ~F.col("loose") & (F.col("rank_b") > F.col("rank_a"))).groupBy("a").agg(F.min_by("b", near).alias("root"))
    tree = materialize(read.select(F.col("id")).join(upward.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), "names-tree")
    while True:  # pointers double each round; ranks rise along them, so this ends
        higher = tree.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = materialize(tree.join(higher, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "names-tree")
        if not after.where("moved").take(1):
            break
        tree = after.select("id", "root")
    # a group with a short form joins the group of the full form; short forms of short forms follow
    joined = materialize(_settled(edges.where("loose"), tree, "own").withColumnRenamed("id", "root"), "names-joined")
    for _ in range(2):
        tree = tree.join(joined, "root", "left").select("id", F.coalesce("host", "root").alias("root"))
    tree = materialize(tree, "names-tree")
    # a name of initials joins full names if its nearest ones are of one group
    alone = _settled(edges.where("short_a AND NOT short_b"), tree, "a")
    return tree.join(alone, "id", "left").select("id", F.coalesce("host", "root").alias("root"))


def variant_pairs(names: DataFrame, together: DataFrame | None = None) -> DataFrame:
    """(kind, block, name_a, name_b) of names(kind, block, name, n): spellings of one entity, name_a first by code point.

    `together(place, kind, block, name)`, if given, lets short forms of given names be learned.
    """
    real = names.where(is_real(F.col("name")) & F.col("block").isNotNull())
    alone = real.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("names")).where("names > 1").drop("names")
    read = materialize(read_names(real.join(alone, ["kind", "block"], "left_semi").select("kind", "block", "name", "n")), "names-read")
    links = read.select(F.col("name").alias("nick"), F.col("name").alias("formal")).limit(0) if together is None else learned_links(read, together)
    links = materialize(links, "names-links")
    given = read.select("id", F.explode("readings.given").alias("nick")).join(links, "nick").groupBy("id").agg(F.collect_set("formal").alias("formals"))
    read = materialize(read.join(given, "id", "left").withColumn("formals", F.coalesce("formals", F.array().cast("array<string>"))), "names-read")
    grouped = read.select("id", "kind", "block", "name").join(groups(read, links), "id")
    other = grouped.select("root", F.col("id").alias("other"), F.col("name").alias("name_b"))
    return grouped.join(other, "root").where("name < name_b").select("kind", "block", F.col("name").alias("name_a"), "name_b")
