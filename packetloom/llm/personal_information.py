"""Personal information inside free text (problem 5).

Mentions are found by their own shape (emails, phones, identity numbers, street addresses) and, for
names, by what stands around them: labels, titles, words of kinship, and verbs that persons do. Two
capitalised words without such a cue are a name if the corpus' own name columns know them: these
candidates are joined with that gazetteer, so no list of names is kept here and none is broadcast.

Each mention is then replaced by a typed placeholder that holds a surrogate: keyed, of the same type
and format (digits for digits, the same separators, case, order and shortening of names, an ending
of the same gender), the same for every mention of the same thing, and different for different
things: surrogates of all distinct parts are compared over the corpus and keyed anew until none is
shared.

Defined results: null and empty texts have no mentions; mentions do not overlap (the earlier and
longer wins); the text between mentions is unchanged; a mention repeated in a text counts once.
Names are found in Latin script.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.name_variants import CREDENTIALS, IRREGULAR, TITLES
from packetloom.session import materialize

TYPES = ("email", "phone", "id_number", "address", "name")
JSON_MEMBERS = ("reason_for_request", "special_instructions", "snippet")

_AT = r"(?:@|\s+at\s+|\s*[\[(]\s?at\s?[\])]\s*)"
_DOT = r"(?:\.|\s+dot\s+|\s*[\[(]\s?dot\s?[\])]\s*)"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])", re.I)
_SEP = r"[-.\s ]?"
PHONE = re.compile(
    rf"(?<![\w(+.\-])(?:(?:\+?1{_SEP})?(?:\(\d{{3}}\)\s?|\d{{3}}{_SEP})[2-9]\d\d{_SEP}\d{{4}}|\d{{3}}-\d{{4}}|(?<=[a-z:]\s)[2-9]\d\d[.\s]\d{{4}})(?![\w-]|\.\d)"
)
ID_NUMBER = re.compile(r"(?<![\w-])(?:\d{10}V\d{6}|(?:DL|ID)\s?\d{2}-\d{3}-\d{4}|[A-Z]{2}-\d{6}-\d{2}|\d{3}([- ])\d{2}\1\d{4}|\d{3}\s\d{2}\s\d{4}|(?<=SSN )\d{9}|(?<=SSN: )\d{9})(?![\w-])", re.I)
_SUFFIX = r"(?:Ave|Avenue|St|Street|Rd|Road|Dr|Drive|Ln|Lane|Ct|Court|Loop|Way|Blvd|Boulevard|Pl|Place|Ter|Terrace|Cir|Circle|Hwy|Highway|Pkwy|Parkway|Trl|Trail|Row|Path|Run|Sq|Square|Alley|Route\s+\d{1,3})"
_UNIT = r"(?:,?\s+(?:Apt|Apartment|Unit|Suite|Ste|Rm|Lot)\.?\s+#?\w{1,4}\b|,?\s+#\s?\w{1,4}\b)?"
_STREET = rf"\d{{1,5}}\s+(?:(?:[NSEW]|NE|NW|SE|SW)\.?\s+)?(?:[A-Z][\w@']*\s+){{0,3}}?[A-Z][\w@']*\s+{_SUFFIX}\b\.?(?!\w){_UNIT}"
_BOX = r"P\.?\s?O\.?\s+Box\s+\d{1,6}"
_IS_BOX = re.compile(r"P\.?\s?O", re.I)
ADDRESS = re.compile(rf"(?<![\w-])(?:{_STREET}|{_BOX})(?!\w)")
ADDRESS_ANY = re.compile(ADDRESS.pattern, re.I)
ADDRESS_UPPER = re.compile(ADDRESS.pattern.replace("Avenue", "Avenue|AVE|AVENUE|ST|STREET|RD|ROAD|DR|DRIVE|LN|LANE|CT|COURT|LOOP|WAY|BLVD|BOULEVARD|PL|PLACE|TER|TERRACE|CIR|HWY|PKWY").replace("Apt", "APT|UNIT|STE|Apt").replace("Box", "(?:Box|BOX)"))
_NOT_PHONE = re.compile(r"(?:NPI|serial|Reference|Claim line|batch|Authorization(?: Number)?|device|invoice)\W{0,3}(?:no\.?|number|#)?\W{0,3}$", re.I)

_BREAK = r"(?:[-­¬‐] ?\n[a-z0-9@]+)?"
_CAP = rf"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ0-9@|'’]*[A-Za-zÀ-ÖØ-öø-ÿ0-9@|]{_BREAK}"
_SHORT = r"(?!Mr|Ms|Dr|Mx|St\.)[A-Z][a-z]{0,3}\."
_CREDENTIAL = r"(?:MD|M\.D|DO|D\.O|NP|N\.P|PA|P\.A|DPT|D\.P\.T|RN|PhD)\b"
_NAME = rf"(?:{_CAP},\s+(?!{_CREDENTIAL})(?:{_CAP}|{_SHORT})(?:\s+[A-Z]\b\.?)?|(?:{_SHORT}|[A-Z]\s(?=[A-Z])|{_CAP})\s+(?:[A-Z]\.?\s+)?(?!{_CREDENTIAL}){_CAP})"
_TITLE = r"(?:(?:Dr|Mr|Mrs|Ms|Miss|Prof)\.?\s+)?"
CUED = re.compile(
    rf"(?:(?:^|(?<=\n))\W{{0,2}}(?:Patient Name|Name|Veteran|Member|Ordering Provider|Referring Provider|Provider|Signed by)\s*[:;]\s*|(?:^|(?<=\n))\W{{0,2}}Patient\s*[-:]\s*|\battention\s+|\bspouse\s+|\b[Ss]een\s+with\s+|\bleft\s+for\s+|\b[Dd]iscussed\s+with\s+|\b(?:Daughter|Son|Mother|Father|Wife|Husband|Sister|Brother|Spouse|Partner|Caregiver|Guardian|Aunt|Uncle|Niece|Nephew)\s+){_TITLE}(?P<name>{_NAME})"
)
TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)\b\.?\s+(?P<name>(?:{_SHORT}|[A-Z]\s|{_CAP}\s+(?={_CAP}))?\s?{_CAP})")
BEFORE = re.compile(rf"(?<![\w.])(?P<name>{_NAME})(?=\s+(?:signed\s+the\s+f|states\s+that|was\s+seen)|,\s+callback|\s+\(\s)")
#: Words before and after a name that tell a person (fixed values of English use).
_DOING = r"(?:called|calls|reports|reported|states|stated|says|said|told|tells|denies|denied|describes|described|signed|asked|asks|wrote|writes|presents|presented|lives|agreed|agrees|prefers|requested|requests|attended|arrived|returned|complains|complained|confirmed|explained|mentioned|notes|noted|was\s+(?:seen|examined|treated|called|told|asked)|by\s+(?:phone|fax|mail|email)|on\s+the\s+phone|left\s+a\s+message)"
DOES = re.compile(rf"\s+{_DOING}\b")
_TOLD = r"(?:(?:seen|signed|reviewed|examined|treated|dictated|prepared|completed|witnessed|referred)\s+by|(?:spoke|met|talked|discussed|visit|appointment|follow-up)\s+with|(?:call|letter|message|note|voicemail)\s+from|referred\s+to|addressed\s+to|attn:?|care\s+of)"
TOLD = re.compile(rf"\b(?i:{_TOLD})\s+{_TITLE}$")
#: Two capitalised words, or a surname, a comma and a given name: a name if the gazetteer knows it.
PAIR = re.compile(rf"(?<![\w@.-])(?P<name>{_CAP},\s+(?![A-Z]{{2}}\b){_CAP}|{_CAP}\s+(?:[A-Z]\.?\s+)?{_CAP})(?!\s*:)(?![\w@])")
_CAPITAL_AFTER = re.compile(r"\s+[A-Z][a-z]")
_CAPITAL_BEFORE = re.compile(r"[A-Z][\w'’]*\s+$")
_NO_PERSON = re.compile(r"\b(?:The|This|That|Patient|Name|Veteran|Member|Ordering|Referring|Provider|Signed|Date|Birth|Number|Authorization|Reference|Address|Notes|Clinical|Report|Request|Letter|Summary|Sheet|Form|Page|Street|Road|Box|Route|Dr|Mr|Mrs|Ms|Miss)\b", re.I)
#: In one-line remarks names come in any case.
REMARK = re.compile(r"\s-\s+(?:per\s+)?(?P<name>[a-z][\w'’]*\.?,?\s+(?:[a-z]\.?\s+)?[a-z][\w'’]+|[a-z]\.\s?[a-z][\w'’]+)\s*(?=[;|,/\t\n•\"”]|$)", re.I)
_NO_NAME = re.compile(r"\b(?:left|right|hip|knee|ankle|wrist|shoulder|lumbar|thoracic|cervical|sacroiliac|lumbosacral|stable|spine|email|id|pt|cell|lives|region)\b", re.I)
_FACILITY = re.compile(r"\b(?:Center|Clinic|Institute|Services|Associates|Group|Department|Hospital|Imaging|Medical|Physical|Therapy)\b", re.I)


def mentions(text: str, remark: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions of a text, in order, without overlap; "name?" are those the gazetteer must know.

    `remark`: a short remark typed in any case (diagnosis_text) rather than running text.
    """
    found: list[tuple[int, int, str]] = []
    if "@" in text or " at" in text or "\nat" in text or "[at" in text or "(at" in text:
        found += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text) if "@" in m[0] or re.search(r"\bdot\b|\[at|\(at", m[0], re.I)]
    for m in ID_NUMBER.finditer(text):
        found.append((m.start(), m.end(), "id_number"))
    for m in PHONE.finditer(text):
        if not _NOT_PHONE.search(text, max(0, m.start() - 40), m.start()):
            found.append((m.start(), m.end(), "phone"))
    for m in (ADDRESS_ANY if remark else ADDRESS_UPPER).finditer(text):
        found.append((m.start(), m.end(), "address"))
    maybe: list[tuple[int, int, str]] = []
    if remark:
        for m in REMARK.finditer(text):
            if not _NO_NAME.search(m["name"]):
                told = "per " in m[0].lower() or len(re.findall(r"\w+", m["name"])[0]) == 1
                (found if told else maybe).append((m.start("name"), m.end("name"), "name" if told else "name?"))
    else:
        for how in (CUED, BEFORE, TITLED):
            for m in how.finditer(text):
                if not _FACILITY.search(m["name"]) and len(_NO_PERSON.findall(m["name"])) < 2 and sum(c.isdigit() for c in m["name"]) < 3:
                    found.append((m.start("name"), m.end("name"), "name"))
        at = 0
        while m := PAIR.search(text, at):
            s, at = m.span("name")
            if _NO_PERSON.search(m["name"]) or _FACILITY.search(m["name"]) or sum(c.isdigit() for c in m["name"]) > 2:
                at = s + len(m["name"].split()[0])
            elif not _FACILITY.match(text, at + 1):
                told = (DOES.match(text, at) and not _CAPITAL_BEFORE.search(text, max(0, s - 30), s)) or (TOLD.search(text, max(0, s - 40), s) and not _CAPITAL_AFTER.match(text, at))
                (found if told else maybe).append((s, at, "name" if told else "name?"))
    kept: list[tuple[int, int, str]] = []
    order = {t: i for i, t in enumerate(TYPES)}
    for s, e, t in sorted(found, key=lambda x: (x[0], order[x[2]], -x[1])):
        if not kept or s >= kept[-1][1]:
            kept.append((s, e, t))
        elif t == kept[-1][2] == "name" and e > kept[-1][1] and s == kept[-1][0]:
            kept[-1] = (s, e, t)
    if maybe:
        kept = sorted(kept + [x for x in maybe if not any(s < x[1] and x[0] < e for s, e, _ in kept)])
    return kept


def name_key(name: str) -> str | None:
    """The two words that name a person, in one order; None of what is no full name."""
    words = [w for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"[-­¬‐] ?\n", "", name.lower())) if w not in CREDENTIALS and w not in TITLES]
    return " ".join(sorted(words)) if len(words) == 2 else None


def gazetteer(names: DataFrame) -> DataFrame:
    """(known): keys of the full names of names(name); organisations have other words and stay out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = {name_key(n) for n in b["name"] if n and not _FACILITY.search(n)}
            yield pd.DataFrame({"known": sorted(k for k in keys if k)}, dtype=object)

    return names.select("name").mapInPandas(run, "known string").select(F.xxhash64("known").alias("known")).distinct()


def json_texts(text: str) -> list[str]:
    """The free-text members of readable JSON at any depth, JSON inside strings included."""
    out: list[str] = []

    def read(value: object, name: str) -> None:
        if isinstance(value, str):
            if name in JSON_MEMBERS and value.strip():
                out.append(value)
            elif value.lstrip()[:1] in ("{", "[", '"') and value.strip():
                try:
                    read(json.loads(value), name)
                except (ValueError, RecursionError):
                    pass
        elif isinstance(value, dict):
            for k, v in value.items():
                read(v, k)
        elif isinstance(value, list):
            for v in value:
                read(v, name)

    if text and text.lstrip()[:1] in ("{", "[", '"'):
        read(text, "")
    return out


def find_mentions(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(field, row_key, pii_type, value) of rows(field, row_key, texts); JSON texts are read, remarks have any case.

    `names(name)`: the corpus' name columns, for names that nothing around them tells.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: set[tuple] = set()
            for field, key, texts in zip(b["field"], b["row_key"], b["texts"]):
                for t in texts if texts is not None else ():
                    if not t:
                        continue
                    for one in json_texts(t) if field == "fields_json" else (t,):
                        for s, e, kind in mentions(one, field == "diagnosis_text"):
                            known = name_key(one[s:e]) if kind == "name?" else None
                            if kind != "name?" or known:
                                out.add((field, key, kind.rstrip("?"), one[s:e], known))
            yield pd.DataFrame(list(out), columns=["field", "row_key", "pii_type", "value", "known"])

    columns = ["field", "row_key", "pii_type", "value"]
    found = rows.select("field", "row_key", "texts").mapInPandas(run, "field string, row_key string, pii_type string, value string, known string")
    if names is None:
        return found.where("known IS NULL").select(columns).distinct()
    found = materialize(found, "mentions")
    told = found.where("known IS NOT NULL").withColumn("known", F.xxhash64("known")).join(gazetteer(names), "known", "left_semi")
    return found.where("known IS NULL").select(columns).unionByName(told.select(columns)).distinct()


# Surrogates


def parts_of(kind: str, value: str) -> list[tuple[str, str]]:
    """(part type, canonical form) of what a mention refers to; forms of one thing share parts."""
    if kind == "name":
        words = [w for w in re.findall(r"[\w@|'’]+", re.sub(r"[-­¬‐] ?\n", "", value)) if len(w) > 1]
        return [("name", IRREGULAR.get(w.lower(), w.lower())) for w in words]
    if kind == "email":
        plain = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", re.sub(r"\s*[\[(]?\bat\b[\])]?\s*", "@", value.lower()))
        return [("email", plain)]
    if kind == "phone":
        return [("phone", re.sub(r"\D", "", value)[-10:])]
    if kind == "id_number":
        return [("id_number", re.sub(r"\W", "", value.upper()))]
    if _IS_BOX.match(value):
        return [("box", re.sub(r"\D", "", value))]
    return [("address", " ".join(re.findall(r"\w+", value.lower())))]


_SYLLABLES = [a + b for a in ("b", "br", "c", "cl", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "st", "t", "th", "v", "w") for b in ("a", "e", "i", "o", "u")]
_ENDS = ["by", "combe", "den", "ford", "ham", "ley", "low", "more", "ney", "rick", "sby", "ton", "wick", "worth"]
#: Endings of given names of women in common use; a stand-in keeps the kind of ending.
_FEMALE_ENDS = ("a", "ine", "elle", "ette")


def surrogate(part: str, canon: str, key: bytes, attempt: int) -> str:
    """Keyed stand-in of one part: digits for digits, a name for a name."""
    draw = int.from_bytes(hmac.new(key, f"{part}|{canon}|{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")
    if part in ("name", "email"):
        n = len(_SYLLABLES)
        ends = _FEMALE_ENDS if part == "name" and canon.endswith(_FEMALE_ENDS) else _ENDS
        word = "".join(_SYLLABLES[(draw // n**i) % n] for i in range(2 + (attempt > 1) + (attempt > 4))) + ends[(draw // n**5) % len(ends)]
        return f"{word}{draw % 997}" if part == "email" else word.capitalize()
    digits = re.sub(r"\D", "", canon)
    new = str(draw % 10 ** max(1, len(digits))).zfill(len(digits))
    if part == "phone" and len(digits) >= 7 and attempt < 2:  # few numbers have 555, so later attempts vary all digits
        new = new[:-7] + "555" + new[-4:]
    if part == "box":  # the length of the original leaves few numbers, so later attempts take more digits
        return str(draw % 10 ** (len(digits) + attempt)).zfill(len(digits) + attempt)
    if part == "address":  # the house number and street as they are written
        n = len(_SYLLABLES)
        more = _SYLLABLES[draw // 7000003 % n] if attempt > 1 else ""
        return f"{new[:4]} {(_SYLLABLES[draw // 7 % n] + _SYLLABLES[draw // 701 % n] + more + _ENDS[draw // 99991 % len(_ENDS)]).capitalize()}"
    return new


def _fill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order; further digits of the shape repeat the last ones."""
    new = iter(digits[-sum(c.isdigit() for c in shape) :].rjust(sum(c.isdigit() for c in shape), "1"))
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word


def in_place(kind: str, value: str, given: dict[tuple[str, str], str]) -> str:
    """What stands in place of a mention: "[TYPE:surrogate]", written like the mention."""
    parts = parts_of(kind, value)
    new = value
    if kind == "name":
        flat = re.sub(r"[-­¬‐] ?\n", "", value)

        def swap(m: re.Match) -> str:
            w = m[0]
            if len(w) == 1:
                return w
            return _cased(w, given.get(("name", IRREGULAR.get(w.lower(), w.lower())), "Person"))

        new = re.sub(r"[\w@|'’]+", swap, flat)
    elif kind == "email":
        new = given.get(parts[0], "person") + "@example.org"
    elif kind == "address":
        stand_in = given.get(parts[0], "1" if parts[0][0] == "box" else "1 Street")
        new = f"PO Box {stand_in}" if parts[0][0] == "box" else f"{stand_in} {value.split()[-1] if re.search(_SUFFIX + '$', value) else 'Street'}"
    else:
        new = _fill(value, given.get(parts[0], ""))
    return f"[{kind.upper()}:{' '.join(new.split())}]"


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """(part, canon, stand_in) of distinct parts(part, canon); no two canonical forms of a type share one.

    Stand-ins are keyed anew while shared; later attempts draw from more.
    """
    secret = key.encode()

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        @F.pandas_udf("string")
        def draw(part: pd.Series, canon: pd.Series) -> pd.Series:
            return pd.Series([surrogate(p, c, secret, attempt) for p, c in zip(part, canon)], index=part.index, dtype=object)

        return df.select("part", "canon", draw("part", "canon").alias("stand_in"))

    done = None
    wanted = materialize(parts.distinct(), "surrogate-parts")
    rest = wanted
    attempt = 0
    while True:
        table = materialize(drawn(rest, attempt), "surrogates")
        kept = table.groupBy("part", "stand_in").agg(F.min("canon").alias("canon")).select("part", "canon", "stand_in")
        if done is not None:
            kept = kept.join(done.select("part", "stand_in"), ["part", "stand_in"], "left_anti").select("part", "canon", "stand_in")
        done = kept if done is None else done.unionByName(kept)
        done = materialize(done, "surrogates")
        rest = wanted.join(done.select("part", "canon"), ["part", "canon"], "left_anti")
        if not rest.take(1):
            return done
        attempt += 1


def redact(rows: DataFrame, key: str, names: DataFrame | None = None) -> DataFrame:
    """(field, row_key, at, text): every text of rows(field, row_key, texts) with stand-ins for its mentions.

    `key` is the secret the stand-ins are keyed with, `names(name)` as in `find_mentions`. `at` is the
    index of the text in its row. JSON texts are redacted member by member: their free-text members
    come out one by one.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for field, k, texts in zip(b["field"], b["row_key"], b["texts"]):
                flat = [x for t in (texts if texts is not None else ()) for x in ((json_texts(t) if t else []) if field == "fields_json" else [t])]
                for at, t in enumerate(flat):
                    spans = mentions(t, field == "diagnosis_text") if t else []
                    spans = [(s, e, kind, name_key(t[s:e]) if kind == "name?" else None) for s, e, kind in spans]
                    spans = [x for x in spans if x[2] != "name?" or x[3]]
                    out.append((field, k, at, t, [{"s": s, "e": e, "kind": kind.rstrip("?"), "known": known, "parts": [{"part": p, "canon": c} for p, c in parts_of(kind.rstrip("?"), t[s:e])]} for s, e, kind, known in spans]))
            yield pd.DataFrame(out, columns=["field", "row_key", "at", "text", "spans"], dtype=object)

    schema = "field string, row_key string, at int, text string, spans array<struct<s:int,e:int,kind:string,known:string,parts:array<struct<part:string,canon:string>>>>"
    texts = materialize(rows.select("field", "row_key", "texts").mapInPandas(split, schema), "redaction-texts").withColumn("id", F.xxhash64("field", "row_key", "at", "text"))
    long = texts.select("id", F.explode("spans").alias("x")).select("id", "x.s", F.xxhash64("x.known").alias("known"), F.col("x.known").isNull().alias("told"), "x.parts")
    if names is not None:
        known = long.where("NOT told").join(gazetteer(names), "known", "left_semi").select("id", "s", "known", "told", "parts")
        long = long.where("told").unionByName(known)
    else:
        long = long.where("told")
    long = long.select("id", "s", F.explode("parts").alias("p")).select("id", "s", "p.part", "p.canon").distinct()
    table = surrogate_table(long.select("part", "canon"), key)
    stand_ins = long.join(table, ["part", "canon"]).groupBy("id").agg(F.collect_list(F.struct("s", "part", "canon", "stand_in")).alias("known"))

    @F.pandas_udf("string")
    def written(text: pd.Series, spans: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for t, where, have in zip(text, spans, known):
            given = {(r["part"], r["canon"]): r["stand_in"] for r in have}
            real = {r["s"] for r in have}
            pieces, last = [], 0
            for x in where:
                if x["s"] in real:
                    pieces += [t[last : x["s"]], in_place(x["kind"], t[x["s"] : x["e"]], given)]
                    last = x["e"]
            out.append("".join(pieces) + t[last:])
        return pd.Series(out, index=text.index, dtype=object)

    plain = texts.join(stand_ins.select("id"), "id", "left_anti").select("field", "row_key", "at", "text")
    changed = texts.join(stand_ins, "id").select("field", "row_key", "at", written("text", "spans", "known").alias("text"))
    return plain.unionByName(changed)
