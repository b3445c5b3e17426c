import json
import random

from packetloom.operators.nested_json import extract, flatten


def nodes(spark, *texts):
    df = spark.createDataFrame([("f", i, t, "x") for i, t in enumerate(texts)], "field string, row_id bigint, text string, node string")
    return {(r.row_id, r.node, r.parent) for r in flatten(df).collect()}


def test_arrays_and_parents(spark):
    t = json.dumps({"a": {"b": [{"c": [1, {"d": []}, {"e": [{"x": "}]{\\\"[,"}]}]}]}, "z": [[{"q": 1}]]})
    assert nodes(spark, t) == {(0, "a.b[0]", ""), (0, "a.b[0].c[1]", "a.b[0]"), (0, "a.b[0].c[2]", "a.b[0]"), (0, "a.b[0].c[2].e[0]", "a.b[0].c[2]"), (0, "z[0][0]", "")}


def test_lone_object_counts_where_others_hold_arrays(spark):
    got = nodes(spark, '{"p": [{"s": 1}]}', '{"p": {"s": {"k": 2}}}')
    assert got == {(0, "p[0]", ""), (1, "p[0]", "")}


def test_json_inside_strings(spark):
    inner = json.dumps([{"m": json.dumps({"n": [{}]})}])
    got = nodes(spark, json.dumps(json.dumps({"o": inner})))
    assert got == {(0, "o[0]", ""), (0, "o[0].m.n[0]", "o[0]")}


def test_unreadable_and_missing(spark):
    assert nodes(spark, None, "", "  ", '{"a": [{"b": 1}', "null", "plain", '"text"', "[]", '{"a": [1, 2]}', '{"ü\\u00e9": [{}]}') == {(9, "üé[0]", "")}


def test_many_texts_in_one_buffer():
    items = [((i,), json.dumps({"k": [{"v": '\\"' * i}] * (i % 3)})) for i in range(300)]
    assert len(extract(items)) == sum(i % 3 for i in range(300))


def test_of_a_repeated_name_the_last_counts():
    assert extract([((0,), '{"a": [{"x": 1}], "a": []}')]) == []
    assert [x[1] for x in extract([((0,), '{"a": 1, "b": {"a": [{}], "a": [{}, {}]}}')])] == ["b\x02\x03", "b\x02\x03\x01a[0]\x03", "b\x02\x03\x01a[1]\x03"]


def test_same_as_a_plain_walk():
    rnd = random.Random(5)

    def value(deep):
        how = rnd.randrange(7) if deep else rnd.randrange(4)
        if how < 3:
            return rnd.choice([None, True, -1.5e3, "", "}{", '\\"[', "ü\n:", " {x", "[1"])
        if how == 3:
            return json.dumps([{"q": rnd.randrange(9)}])
        return [value(deep - 1) for _ in range(rnd.randrange(4))] if how == 4 else {rnd.choice(["a", "b", 'c"]', "d\\"]): value(deep - 1) for _ in range(rnd.randrange(4))}

    def walk(v, path, out):
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "[", '"'):
            try:
                return walk(json.loads(v), path, out)
            except ValueError:
                return out
        if isinstance(v, dict):
            if path:
                out.append(path)
            for k, x in v.items():
                walk(x, f"{path}\x01{k}" if path else k, out)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", out)
        return out

    values = [value(5) for _ in range(400)]
    got = {}
    for i, path, _ in extract([((i,), json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)]):
        got.setdefault(i, []).append(path.replace("\x02", "").replace("\x03", ""))
    for i, v in enumerate(values):
        assert sorted(got.get(i, [])) == sorted(walk(v, "", [])), v
