from packetloom.operators.packed_values import atoms, unpack, unquote


def rows_of(spark, texts, field="f"):
    return spark.createDataFrame([(field, str(i), t, "clash") for i, t in enumerate(texts)], "field string, row_key string, text string, value string")


def test_quotes_protect_delimiters():
    assert atoms('"a, b"; c', True) == (['"a, b"', " c"], [";"])
    assert unquote(' "form ""RFS""" ') == 'form "RFS"'
    assert unquote("“x, y”") == "x, y"
    assert unquote('5" nail') == '5" nail'


def test_values_with_position(spark):
    # phones stand in lone values too, so the character model knows them
    common = ["alpha", "beta", "gamma"] * 20 + [f"beta - pt cell (907)555-0{k}" for k in range(100, 130)]
    texts = [*common, "alpha, beta", 'gamma | "alpha, one" | beta', " alpha ;; beta ; ", None, "", "  ", ";;", *[f"beta - pt cell +1(907)555-0{k}" for k in range(130, 190)]]
    got = {}
    for r in unpack(rows_of(spark, texts)).collect():
        got.setdefault(int(r.row_key), []).append((r.pos, r.value, r.of))
    n = len(common)
    assert sorted(got[n]) == [(1, "alpha", 2), (2, "beta", 2)]
    assert [v for _, v, _ in sorted(got[n + 1])] == ["gamma", "alpha, one", "beta"]
    assert [v for _, v, _ in sorted(got[n + 2])] == ["alpha", "beta"]
    assert all(i not in got for i in (n + 3, n + 4, n + 5, n + 6))
    assert [v for _, v, _ in got[n + 7]] == ["beta - pt cell +1(907)555-0130"]  # a plus that separates nothing


def test_repeats_and_empty_input(spark):
    twice = rows_of(spark, ["a; b"]).union(rows_of(spark, ["a; b"]))
    assert unpack(twice).count() == 2
    assert unpack(rows_of(spark, ["x"]).where("false")).count() == 0


def test_very_long_text(spark):
    long = "; ".join(["value"] * 5000)
    assert unpack(rows_of(spark, [long, "value"])).where("row_key = '0'").count() == 5000
