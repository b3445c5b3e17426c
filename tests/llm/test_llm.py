import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from packetloom.llm import canonical_values, lookalikes, mixing, name_variants, personal_information, scan_repair, survivors, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZER_DIR), reason="no vocabulary files")


# p1


def test_readings_and_codes():
    assert canonical_values.read_code("ICD-10: k7O.7") == "K707"
    assert canonical_values.read_code("N45 .4") == canonical_values.read_code("n454") == "N454"
    assert canonical_values.read_code("C38.B5 (lumbar)") == "C3885"
    assert canonical_values.read_code("left hip sprain (k78.32)") == "K7832"
    assert canonical_values.read_code("benign mole") is None
    assert canonical_values.readings("lig sprain - hip left - per j. doe")[1] == ["lig", "sprain", "hip", "left"]
    assert canonical_values.explained(["left", "hip", "ligament", "sprain"], ["lig", "sprain", "hip", "lft"]) < 1.5
    assert len(canonical_values.readings(" - ".join(f"part{i}" for i in range(9)))) == 9
    assert canonical_values.words_of("C-spine T2 osteo-arthritis") == ["cervical", "t", "two", "osteoarthritis"]
    assert canonical_values.explained(["left", "hip", "bursitis"], ["hip", "left", "bursitsi"]) == 1
    assert canonical_values.explained(["left", "hip", "bursitis"], ["right", "hip", "bursitis"]) is None


def test_mapping_against_brute_force(spark):
    ref = [("K78.32", "left hip ligament sprain"), ("K78.48", "right hip ligament sprain"), ("H44.2", "lumbar spinal stenosis"), ("N45.3", "chronic insomnia")]
    rnd = random.Random(4)
    values = ["benign mole", "K7832", "X99.9", "ligament sprain, right hip", "lumb stenosis", "", None, "  ", "hip sprain"]
    for _, name in ref:
        for _ in range(25):
            words = name.split()
            rnd.shuffle(words)
            k = rnd.randrange(len(words))
            i = rnd.randrange(len(words[k]))
            words[k] = words[k][:i] + rnd.choice("aeiou") + words[k][i + 1 :]
            values.append(" ".join(words))
    got = {r.value: r.ref_code for r in canonical_values.map_values(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(ref, "ref_code string, ref_name string")).collect()}
    assert got["K7832"] == "K78.32" and got["ligament sprain, right hip"] == "K78.48" and got["lumb stenosis"] == "H44.2"
    assert got["benign mole"] == got["X99.9"] == got["hip sprain"] == "UNMATCHED" and "" not in got
    words = {c: canonical_values.words_of(n) for c, n in ref}
    vocabulary = {w for ws in words.values() for w in ws}
    implied = {c: {w for w in ws for by in ws if by != w and all(w in x for x in words.values() if by in x)} for c, ws in words.items()}

    def read(reading):
        out, unknown = set(), 0
        for w in set(reading):
            costs = {m: c for m in vocabulary if (len(w) > 1 or m == w) and (c := canonical_values.word_cost(m, w)) is not None}
            out |= {m for m, c in costs.items() if c <= min(costs.values()) + 0.15}
            unknown += not costs and len(w) > 3
        return out, unknown

    for v in got:
        if canonical_values.read_code(v):
            continue
        found = []
        for reading in canonical_values.readings(v):
            means, unknown = read(reading)
            for c, canon in words.items():
                common = len(means & set(canon))
                jaccard = common / (len(means) + unknown + len(canon) - common)
                e = canonical_values.explained(canon, reading, implied[c])
                if jaccard >= 0.5 and e is not None:
                    found.append((-round(jaccard, 3), e, -len(canon), c))
        assert got[v] == min(found, default=(0, 0, 0, "UNMATCHED"))[3], v


def test_a_list_of_other_entries(spark):
    """Held out: entries, abbreviations and word orders of none of the tables; nothing of them is kept in the module."""
    ref = [("E11.1", "type two diabetes mellitus"), ("E10.1", "type one diabetes mellitus"), ("J45.2", "mild persistent asthma"), ("I50.4", "chronic congestive heart failure"), ("B20.1", "acute viral bronchitis"), ("B20.2", "acute bacterial bronchitis"), ("C10.1", "acute bacterial sinusitis")]
    want = {
        "t2 diabetes mellitus": "E11.1", "diabetes mellitus type 2": "E11.1", "diabetes mel., type one": "E10.1", "persist asthma, mild": "J45.2", "asthma mild persistant": "J45.2", "chf": "I50.4", "chr congestive heart failure": "I50.4", "cchf": "I50.4",
        "viral bronchitis": "B20.1", "bronchitis": "UNMATCHED", "bact sinusitis": "C10.1", "E1O.l": "E10.1", "E10.2": "UNMATCHED", "broken toe": "UNMATCHED", "acute bactreial bronchitis - seen twice - by phone - again": "B20.2", "acute bact sinusits": "C10.1",
    }
    df = spark.createDataFrame([(v,) for v in [*want, None, "", " "]] * 2, "value string")
    got = {r.value: r.ref_code for r in canonical_values.map_values(df, spark.createDataFrame(ref, "ref_code string, ref_name string")).collect()}
    assert {v: c for v, c in got.items() if want[v] != c} == {} and len(got) == len(want)
    assert canonical_values.map_values(df, spark.createDataFrame(ref, "ref_code string, ref_name string").limit(0)).where("ref_code <> 'UNMATCHED'").count() == 0


# p2


def test_lookups_meet_every_edit():
    rnd = random.Random(1)
    for _ in range(400):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(6, 16)))
        b = a
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(b))
            b = rnd.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "y" + b[i + 1 :]])
        if len(b) <= 3:
            continue
        index = {(len(b), i, b[s : s + n]) for i, (s, n) in enumerate(name_variants.segments(len(b), 3))}
        assert index & set(name_variants.lookups(a, 3)), (a, b)


def pairs_of(spark, names):
    df = spark.createDataFrame([(*x, "c") for x in names], "kind string, block string, name string, n bigint, roster string")
    return {(r.name_a, r.name_b) for r in name_variants.variant_pairs(df).collect()}


def test_variants(spark):
    same = ["Harold Jasubrook, MD", "DR. H. M. Jasubrook", "jasubrook, harrold", "Hal Jasubrook"]
    other = ["Jocelyn Jasubrook, MD", "Joss N. Jasubrook"]
    org = ["Aster Hill Medical Center", "AsterHill Med Ctr, LLC", "Medical Center of Aster Hill"]
    noise = ["Aster Hill Spine Center", "TBD", " ", "-", "unknown", "Valerie Quilomfax, DO"]
    names = [("provider", "", x, 9 if "MD" in x else 2) for x in same + other + org + noise] + [("provider", "", None, 1), ("provider", None, "X Y", 1)]
    want = {tuple(sorted(p)) for g in (same, other, org) for p in itertools.combinations(g, 2)}
    assert pairs_of(spark, names) == want
    assert pairs_of(spark, []) == set()


def test_ambiguous_initial_stays_alone(spark):
    names = [("patient", "d", x, 1) for x in ("Edward Norfield", "Elizabeth Norfield", "E. Norfield")]
    assert pairs_of(spark, names) == set()


def test_short_forms():
    same = [("Kenneth", "Ken"), ("Nicholas", "Nick"), ("Jennifer", "Jen"), ("Michael", "Mike"), ("Christina", "Tina"), ("Daniel", "Dan"), ("James", "Jim"), ("Bettina", "Tina"), ("Kendrick", "Ken"), ("William", "Wm"), ("Robert", "Robt"), ("Susannah", "Susie"), ("Frederica", "Freddy")]
    assert all(name_variants.may_mean(short.lower(), long.lower()) for long, short in same)
    other = [("Daniel", "Tim"), ("Harold", "Howard"), ("Margaret", "Mary"), ("Kendrick", "Kent"), ("Oscar", "Olga")]
    assert not any(name_variants.may_mean(short.lower(), long.lower()) for long, short in other)


def test_short_surnames_are_indexed(spark):
    names = [("patient", "d", x, 1) for x in ("J. Li", "Jia Li", "Jia Wu", "Bo Ek", "B. Ek")]
    assert pairs_of(spark, names) == {("J. Li", "Jia Li"), ("B. Ek", "Bo Ek")}


def test_other_names_than_in_the_test_data(spark):
    """Held out: given names, short forms and surnames of none of the tables; one short form only the corpus tells."""
    formal = {"Alistair": "Ali", "Kenneth": "Ken", "Michael": "Mike", "Jennifer": "Jenny", "Christopher": "Chris", "Susannah": "Sukey", "Gregory": "Greg", "Philippa": "Pippa"}
    surnames = [a + b for a in ("Ack", "Brom", "Cald", "Dunst", "Elph", "Gars", "Hollin", "Inch", "Kirk", "Maws") for b in ("able", "erton", "inforth")]
    rnd = random.Random(9)
    rows, want = [], set()
    for i in range(120):
        g, s = rnd.choice(list(formal)), surnames[i % 30] + rnd.choice(["", "e", "son", "well"])
        k = rnd.randrange(1, len(s) - 1)
        forms = {f"{g} {s}", f"{s}, {g}", f"{formal[g]} {s}", f"{g[0]}. {s}", f"{g} {s[:k]}{s[k + 1]}{s[k]}{s[k + 2 :]}"}
        rows += [(f"0{i}", f, 3 if f == f"{g} {s}" else 1) for f in forms]
        want |= {tuple(sorted(p)) + (f"0{i}",) for p in itertools.combinations(forms, 2)}
    names = spark.createDataFrame([("patient", d, x, n) for d, x, n in rows], "kind string, block string, name string, n bigint")
    got = {(r.name_a, r.name_b, r.block) for r in name_variants.variant_pairs(names, names.withColumn("place", F.col("block"))).collect()}
    assert len(got & want) >= 0.95 * max(len(got), len(want))


def test_lookups_meet_swaps():
    rnd = random.Random(2)
    for _ in range(2000):
        a = "".join(rnd.sample("abcdefghijklmnopqrst", rnd.randint(6, 16)))
        b, spots = a, sorted(rnd.sample(range(0, len(a) - 1, 2), 3))
        for i in spots:
            b = b[:i] + b[i + 1] + b[i] + b[i + 2 :] if rnd.random() < 0.8 else b[:i] + "x" + b[i + 1 :]
        index = {(len(b), i, b[s : s + n]) for i, (s, n) in enumerate(name_variants.segments(len(b), 3))}
        assert index & set(name_variants.lookups(a, 3)), (a, b)


def test_ambiguous_initials_keep_each_other(spark):
    names = [("patient", "d", x, n) for x, n in (("Edward Norfield", 3), ("Elizabeth Norfield", 3), ("E. Norfield", 2), ("Norfield, E", 1))]
    assert pairs_of(spark, names) == {("E. Norfield", "Norfield, E")}


# p5


def test_mentions():
    t = "Patient Name: Roe, Jane\nReach the spouse Robert\nDoe on (907) 555-0123. NPI 1440247341 appears. Mail goes to 12 North Weir Way Apt 3, Town, CO. Write r.doe at example dot org or DL 17-202-8569."
    got = [(k, t[s:e]) for s, e, k in personal_information.mentions(t)]
    assert got == [("name", "Roe, Jane"), ("name", "Robert\nDoe"), ("phone", "(907) 555-0123"), ("address", "12 North Weir Way Apt 3"), ("email", "r.doe at example dot org"), ("id_number", "DL 17-202-8569")]
    assert personal_information.mentions("The at-home program uses level 3 dot stickers. Claim line 719-55. The Alder Court Clinic closed.") == []


def test_surrogates_are_distinct_and_coreferent(spark):
    texts = ["Mr. Roe states that he left.", "attention Robert Roe.", None, "", "Nothing here."]
    df = spark.createDataFrame([("pages", "k", texts)], "field string, row_key string, texts array<string>")
    got = {r.at: r.text for r in personal_information.redact(df, "k").collect()}
    one, two = got[0].split("[NAME:")[1].split("]")[0], got[1].split("[NAME:")[1].split("]")[0]
    assert two.split()[-1] == one and one != "Roe" and got[2] is None and got[3] == "" and got[4] == "Nothing here."
    parts = spark.createDataFrame([("name", f"name{i}") for i in range(3000)], "part string, canon string")
    table = personal_information.surrogate_table(parts, "k").collect()
    assert len(table) == len({r.stand_in for r in table}) == 3000


def written_for(spark, kind, values):
    """What stands in place of each value, with one table of stand-ins for all of them."""
    parts = sorted({p for v in values for p in personal_information.parts_of(kind, v)})
    table = personal_information.surrogate_table(spark.createDataFrame(parts, "part string, canon string"), "k").collect()
    given = {(r.part, r.canon): r.stand_in for r in table}
    return [personal_information.in_place(kind, v, given) for v in values]


def test_written_addresses_are_distinct(spark):
    boxes = [f"PO Box {i}" for i in range(1000, 4000)] + [f"{i} North Weir Way Apt {i % 7}" for i in range(1000, 3000)]
    assert len(set(written_for(spark, "address", boxes))) == len(boxes)
    assert len(set(written_for(spark, "address", ["PO Box 4821", "P.O. Box 4821", "P O Box 4821"]))) == 1


def test_stand_ins_of_names(spark):
    """Distinct names, distinct stand-ins; endings of women's names stay; one stand-in for a short form and its full name."""
    given = "Anna Berta Clara Dora Emma Frida Greta Hanna Nadine Celine Otto Paul Karl Hans Kurt Emil Georg Ernst".split()
    written = [w[6:-1].split()[0] for w in written_for(spark, "name", [f"{x} Roe" for x in given])]
    assert len(set(written)) == len(given) and not set(written) & set(given)
    ends = personal_information._FEMALE_ENDS
    assert all(x.endswith(ends) == w.endswith(ends) for x, w in zip(given, written))
    assert len(set(written_for(spark, "name", ["Bob Roe", "Robert Roe"]))) == 1


def test_names_of_no_list():
    """Held out: persons of none of the tables, told by what stands around them."""
    people = ["Kenneth Alderworth", "Jennifer Wexcombe", "Priya Raman", "José Núñez", "Olu Adeyemi"]
    shapes = ["{} called about transport.", "{} reports less pain", "A message from {} was left.", "Seen by {} today", "We spoke with {} at noon", "Patient Name: {}\nDOB", "Update from {} by phone.", "Mr. {} was seen.", "The daughter of\nSigned by: {}"]
    texts = [(n, s.format(n)) for n in people for s in shapes]
    found = [{t[a:b] for a, b, k in personal_information.mentions(t) if k == "name"} for _, t in texts]
    assert sum({n} == f for (n, _), f in zip(texts, found)) >= 0.95 * len(texts)
    for t in ("Physical Therapy reports progress", "The letter from Amber Creek Imaging Services arrived", "Patient Name: \nClinical Notes was seen", "Silver Fen Medical Center called"):
        assert not [t[a:b] for a, b, k in personal_information.mentions(t) if k == "name"], t


def test_names_the_gazetteer_knows(spark):
    df = spark.createDataFrame([("pages", "k", ["The brace of Priya Raman broke. Alder Falls is far, and so is Raman, Priya."]), ("diagnosis_text", "7", ["sprain - olu adeyemi", "sprain - left hip"])], "field string, row_key string, texts array<string>")
    names = spark.createDataFrame([("RAMAN, Priya K.",), ("Adeyemi, Olu MD",), ("Alder Falls Medical Center",), (None,)], "name string")
    assert {r.value for r in personal_information.find_mentions(df, names).collect()} == {"Priya Raman", "Raman, Priya", "olu adeyemi"}
    assert personal_information.find_mentions(df).count() == 0
    got = {(r.field, r.at): r.text for r in personal_information.redact(df, "k", names).collect()}
    assert "Priya" not in got["pages", 0] and got["pages", 0].startswith("The brace of [NAME:") and "Alder Falls" in got["pages", 0] and got["diagnosis_text", 1] == "sprain - left hip"


def test_phones_outnumber_the_555_numbers():
    drawn = {personal_information.surrogate("phone", f"{i:07d}", b"k", attempt) for i in range(3000) for attempt in range(8)}
    assert len(drawn) > 10_000 and all(len(x) == 7 for x in drawn)
    assert personal_information.surrogate("phone", "2345678", b"k", 0).startswith("555")


# p6


def test_skyline_against_brute_force(spark):
    rnd = random.Random(7)
    fields = ["a", "b", "c"]
    rows = [(rnd.choice("xyz"), i, rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, 0.1, 0.5, 0.9]), *[rnd.choice([None, "-", f"v{i}"]) for _ in fields]) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, id bigint, day int, trust double, a string, b string, c string").withColumn("at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)"))
    df = df.union(df.limit(5))  # repeated rows
    vec = {r[1]: (r[2] if r[2] is not None else -1, r[3] if r[3] is not None else -1, sum(v not in (None, "-") for v in r[4:])) for r in rows}
    beats = lambda p, q: p != q and all(a >= b for a, b in zip(p, q))
    measured = survivors.measured(df, "k", "id", "at", "trust", fields)
    for hot in (1000, 3):
        got = {r.record for r in survivors.skyline(measured, 3, hot).collect()}
        assert got == {r[1] for r in rows if not any(s[0] == r[0] and beats(vec[s[1]], vec[r[1]]) for s in rows)}
    a = survivors.survivor(df, "k", "id", "at", "trust", fields).drop("layers", "records").collect()
    b = survivors.survivor(df, "k", "id", "at", "trust", fields, hot=3, salts=3).drop("layers", "records").collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == 3


def test_hot_groups_count_all_records_and_layers(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("xxxy"), i, rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, 0.1, 0.5, 0.9]), rnd.choice([None, "a"]), rnd.choice([None, "b"])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, id bigint, day int, trust double, a string, b string").withColumn("at", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)"))
    vec = {r[1]: (r[2] if r[2] is not None else -1, r[3] if r[3] is not None else -1, sum(v is not None for v in r[4:])) for r in rows}
    want = {}
    for k in "xy":
        left, layers = {r[1] for r in rows if r[0] == k}, 0
        count = len(left)
        while left:
            left = {i for i in left if any(vec[j] != vec[i] and all(a >= b for a, b in zip(vec[j], vec[i])) for j in left)}
            layers += 1
        want[k] = (layers, count)
    cold, hot = (survivors.survivor(df, "k", "id", "at", "trust", ["a", "b"], hot=n).collect() for n in (1000, 3))
    assert {r.key: (r.layers, r.records) for r in hot} == want
    assert sorted(map(str, cold)) == sorted(map(str, hot))


# p7


def test_scan_units():
    assert scan_repair.misread_cost("imaging", "irnagirig") == 2 and scan_repair.misread_cost("clinical", "chnical") == 1
    assert scan_repair.misread_cost("same", "same") is None and scan_repair.misread_cost("cat", "dog") is None
    lines = ["Pine Hollow Spine Center | Page 1 of 2", "CLINICAL NOTES", "text goes on and on with pulse", "71.", "- 1 -"]
    assert scan_repair.furniture_lines(lines) == {0, 4}
    assert scan_repair.breaks_of(["long-", "standing pain com¬", "pared"], set()) == [(0, "long", "standing"), (1, "com", "pared")]


def test_scan_repair(spark):
    good = "The imaging report shows long-standing pain compared with the earlier visit and the request"
    noisy = "10/26/2025 17:18    Pine Hollow Pain Clinic    1/2\nThe irnaging rep0rt shows long-\nstanding pain com¬\npared with fhe earlier visit\npg 1"
    pages = spark.createDataFrame([(f"g{i}", [good]) for i in range(30)] + [("n", [noisy, None, "", "  "]), ("e", None), ("z", [])], "packet_id string, pages array<string>")
    got = {(r.page_index, r.line_no, r.kind, r.fixed) for r in scan_repair.repairs(pages).where("packet_id = 'n'").collect()}
    assert got == {(0, 1, "running", ""), (0, 5, "running", ""), (0, 2, "hyphen", "long-standing"), (0, 3, "hyphen", "compared"), (0, 2, "misread", "imaging"), (0, 2, "misread", "report"), (0, 4, "misread", "the")}
    text = {r.page_index: r.text for r in scan_repair.repaired_pages(pages).where("packet_id = 'n'").collect()}
    assert text[0] == "The imaging report shows long-standing pain compared with the earlier visit" and text[1] is None


def test_weights_of_edits():
    cost = scan_repair.misread_cost
    assert cost("report", "rep0rt") < cost("report", "rcport") < cost("report", "repart") and cost("report", "rxpqrt") is None
    assert cost("clinical", "c1inica1") == 2 * scan_repair.SIGN and cost("visits", "visit") == scan_repair.OTHER


def test_long_words_are_repaired(spark):
    word = "pneumonoultramicroscopicsilicovolcanoconiosis" + "electroencephalographically"
    seen = [word.replace("m", "rn", 1), word.replace("lly", "1ly"), word[:2] + "c" + word[3:-1] + word[-1], word.replace("o", "0", 1)]
    df = spark.createDataFrame([("x", [f"it says {word} here"] * 40 + [f"it says {w} here" for w in seen])], "packet_id string, pages array<string>")
    got = {r.page_index - 40: r.fixed for r in scan_repair.repairs(df).where("kind = 'misread'").collect()}
    assert got == {i: word for i in range(len(seen))}


def test_running_headers_by_repetition(spark):
    """Headers and titles of none of the tables: the header stands alone or within furniture, the title also below it."""
    title, body = "DISCHARGE PLAN", "The ward sent the plan to the family and asked for an answer within a week"
    pages = [(f"a{i}", [f"Orchard Street Hospice | Page 1 of 2\n{title}\n{body} {i}", f"Orchard Street Hospice\n{title}\n{body} {i}"]) for i in range(12)]
    pages += [(f"b{i}", [f"{title}\n{body}", f"Orchard Sfreet H0spice\n{title}\n{body}"]) for i in range(12)] + [("e", [None, ""]), ("z", None)]
    df = spark.createDataFrame(pages, "packet_id string, pages array<string>")
    got = {(r.packet_id[0], r.page_index, r.line_no) for r in scan_repair.repairs(df).where("kind = 'running'").collect()}
    assert got == {("a", 0, 1), ("a", 1, 1), ("b", 1, 1)}


def test_broken_words_with_a_frequent_misread(spark):
    pages = [(f"g{i}", ["The imaging report shows the request"]) for i in range(30)] + [(f"m{i}", ["The irnaging report shows the request"]) for i in range(5)]
    df = spark.createDataFrame([*pages, ("n", ["The irnag-\ning report shows the request"])], "packet_id string, pages array<string>")
    assert [r.fixed for r in scan_repair.repairs(df).where("packet_id = 'n' AND kind = 'hyphen'").collect()] == ["imaging"]


# p8


@needs_vocabulary
def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    rnd = random.Random(3)
    texts = [None, "", " ", "\n\n  x", "It's <|endoftext|> naïve 😀 нет 12345", "a" * 5000] + ["".join(rnd.choice("abc é1'sX\n😀ñ ") for _ in range(60)) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    for r in tokens.encode_corpus(df).collect():
        assert list(r.ids) == (own.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])


# p9


def test_mix_shares(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["big", "big", "small", None, "other"]), rnd.choice([0, 5, 9, 30])) for i in range(3000)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.45, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(sized, targets)
    tokens_of = {i: n for i, _, n in docs}
    used = {}
    for r in chosen.collect():
        assert r.uses <= {"big": 1, "small": 3}[r.source] and r.n_tokens == tokens_of[r.doc_id] > 0
        used[r.source] = used.get(r.source, 0) + r.uses * r.n_tokens
    for r in report.collect():
        assert used.get(r.source, 0) == r.tokens <= r.wanted_tokens
        assert r.source == "absent" or r.wanted_tokens - r.tokens < 30
    assert mixing.mix(sized.where("false"), targets)[0].count() == 0


# p10


def test_mix_passes_over_a_long_document(spark):
    docs = [(i, "a", 7) for i in range(400)] + [(1000 + i, "a", 900 + i) for i in range(3)] + [(2000 + i, "b", 1) for i in range(1000)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 1)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        chosen, report = mixing.mix(sized, targets, seed=seed)
        assert all(r.wanted_tokens * 0.995 <= r.tokens <= r.wanted_tokens for r in report.collect())
        assert chosen.count() == chosen.select("doc_id").distinct().count()


def alike(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, base string")
    return {(r.doc_id_a, r.doc_id_b) for r in lookalikes.alike_pairs(lookalikes.canonical(df)).collect()}


def test_alike(spark):
    words = "the patient reports a steady improvement after treatment"
    texts = [words, words.replace("a", "а"), "​".join(words), words.translate({ord(" "): " "}), "".join(chr(ord(c) + 0xFEE0) if c != " " else "　" for c in words), words.replace("steady", "Steady"), words + " 1", None, "", " ​ ", " ", words, "страница файла а", "стрaницa файла a", "mejoró año", "mejoró año"]
    same = [0, 1, 2, 3, 4, 11]
    want = {tuple(sorted(p)) for p in itertools.combinations(same, 2)} - {(0, 11)} | {(12, 13), (14, 15)}
    assert alike(spark, texts) == want


def test_emoji_joiners_are_visible(spark):
    assert lookalikes.one_form("\U0001f9d1‍⚕️ a‍b") == "\U0001f9d1‍⚕️ ab"
    assert lookalikes.written_in("страница", "LATIN") is None and lookalikes.written_in("аcе", "LATIN") == "ace"


def test_pairs_come_through_the_repair(spark):
    """Other words and letters than in the test data; without the repair these pairs are not equal."""
    words = "quarterly basalt inspection covers every access hatch beyond expected pressure".split()
    rnd = random.Random(6)
    texts, want = [" ".join(words)] * 3, set()
    for n in range(40):
        base = " ".join(rnd.sample(words, 7)) + f" {n}"
        to = {"e": "е", "o": "о", "a": "а", "c": "с", "p": "р", "x": "х", "y": "у"}
        odd = "".join(to[c] if c in to and rnd.random() < 0.4 else c for c in base)
        want |= {(len(texts), len(texts) + 1)} if odd != base else set()
        texts += [base, odd]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    canon = lookalikes.canonical(df)
    found = {(r.doc_id_a, r.doc_id_b) for r in lookalikes.alike_pairs(canon).collect()}
    unrepaired = lookalikes.alike_pairs(canon.withColumn("canonical", F.col("base"))).count()
    assert len(found & want) >= 0.95 * max(len(want), len(found)) and unrepaired == 0


def test_copies_are_not_paired_with_each_other(spark):
    assert alike(spark, ["same text here"] * 50 + ["sаme text here"]) == {(i, 50) for i in range(50)}
