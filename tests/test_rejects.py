import json

import pytest

from waygraph.operators.rejects import diagnose, parsed_lines

GOOD = '{"RouteId": "1", "RouteVarId": "2", "lat": [10.5, 11], "lng": [106, 1.5e2]}'
R = {"RouteId": "1", "RouteVarId": "2", "lat": [10.5], "lng": [106.0]}


def deep(n, inner="", close=None):
    return GOOD[:-1] + ', "x": ' + '[{"y":' * n + (inner or "1") + ("}]" * n if close is None else close) + "}"


def variant(**x):
    return json.dumps({k: v for k, v in (R | x).items() if v is not ...})


CASES = [
    (GOOD.replace("}", ', "x": ' + "7" * 6000 + "}"), None),
    (GOOD.replace("}", ', "x": {"y": -' + "7" * 6000 + "}}"), None),
    (GOOD.replace("10.5", "9" * 6000), "out_of_range"),
    (deep(30), None),
    (GOOD, None),
    ("  \t" + GOOD + " \r\n", None),
    (variant(note='a "b" {c} [d]', extra={"x": [1, {}]}), None),
    (GOOD.replace(", ", ",\n"), None),
    (variant(RouteId=" "), None),
    (variant(RouteId="é😀"), None),
    ('{"RouteId":"1","RouteVarId":"2","lat":[90,-90],"lng":[-180,180]}', None),
    ('{"RouteId":"1","RouteId":"3","RouteVarId":"2","lat":[-0.0],"lng":[1E1]}', None),
    (None, "blank"),
    ("", "blank"),
    (" \t\r\n ", "blank"),
    ("x", "syntax"),
    (GOOD[:-1], "syntax"),
    (GOOD + GOOD, "syntax"),
    (GOOD + "," + GOOD, "syntax"),
    (GOOD + "\n" + GOOD, "syntax"),
    ("[" + GOOD + "]", "not_object"),
    ("7", "not_object"),
    (GOOD.replace('"', "'"), "syntax"),
    (GOOD.replace("]", ",]", 1), "syntax"),
    (GOOD.replace("10.5", "+10.5"), "syntax"),
    (GOOD.replace("10.5", "010.5"), "syntax"),
    (GOOD.replace("10.5", "10."), "syntax"),
    (GOOD.replace("10.5", "NaN"), "not_finite"),
    (GOOD.replace("10.5", "-Infinity"), "not_finite"),
    (GOOD.replace("10.5", "1e999"), "not_finite"),
    (GOOD.replace("10.5", "true"), "not_number"),
    (GOOD.replace("10.5", "null"), "not_number"),
    (GOOD.replace("10.5", '"10.5"'), "not_number"),
    (GOOD.replace("10.5", "[10.5]"), "not_number"),
    (GOOD.replace("10.5", "90.001"), "out_of_range"),
    (GOOD.replace("106", "-181"), "out_of_range"),
    (GOOD.replace("106", "9" * 400), "out_of_range"),
    (GOOD.replace("10.5, 11", "10.5"), "unequal_length"),
    (variant(lat=[], lng=[]), "empty_array"),
    (variant(lat=None), "not_array"),
    (variant(lat={"a": 1}), "not_array"),
    (variant(lat=...), "missing_field"),
    (GOOD.replace("RouteId", "routeid"), "missing_field"),
    (variant(RouteId=""), "id_not_text"),
    (variant(RouteVarId=7), "id_not_text"),
    (GOOD.replace('"1"', '"1\t"'), "syntax"),
    ('{"RouteId":"1","RouteVarId":"2","x":[{"y":1}', "syntax"),
    ('{"z":1}],"lat":[1],"lng":[1]}', "syntax"),
]


DEEP = [
    (deep(20_000), None),
    (GOOD[:-1] + ', "x": ' + "[" * 20_000 + "]" * 20_000 + "}", None),
    (deep(20_000, close="}]" * 19_999 + "}"), "syntax"),
    (deep(20_000, "1,"), "syntax"),
    (deep(20_000, "1 2"), "syntax"),
    (deep(20_000, "tru"), "syntax"),
    (deep(20_000) + "]", "syntax"),
    (deep(20_000).replace("10.5", "null"), "not_number"),
    (deep(20_000).replace("10.5, 11", "10.5"), "unequal_length"),
    ("[" * 20_000 + "]" * 20_000, "not_object"),
]


@pytest.mark.parametrize(("body", "want"), DEEP)
def test_deep_nesting(body, want):
    reason, record = diagnose(body)
    assert (reason and reason.split(":")[0]) == want
    assert want or record["lat"] == [10.5, 11.0]


@pytest.mark.parametrize("copies", [1, 40])
def test_cases(spark, copies):
    rows = [(i * 1000 + k, "f", body, k) for k in range(copies) for i, (body, _) in enumerate(CASES)]
    got = {r.line_id: r for r in parsed_lines(spark.createDataFrame(rows, "line_id long, feed string, body string, status int").repartition(2)).collect()}
    assert len(got) == len(rows)
    for line, _, body, _ in rows:
        want = CASES[line // 1000][1]
        r = got[line]
        if want == "blank":
            assert (r.status, r.reason, r.lat) == ("blank", None, None)
        elif want is None:
            record = diagnose(body)[1] if len(body) > 5000 else json.loads(body)
            assert (r.status, r.reason) == ("good", None), (body, r)
            assert (r.RouteId, r.RouteVarId, r.lat, r.lng) == tuple(record[k] for k in ("RouteId", "RouteVarId", "lat", "lng"))
        else:
            assert r.status == "bad" and r.reason.split(":")[0] == want, (body, r)
            assert r.lat is None and r.RouteId is None
            assert diagnose(body)[0] == r.reason


def test_repeats_and_empty(spark):
    schema = "line_id long, feed string, body string"
    rows = [(1, None, GOOD), (1, None, GOOD), (2, None, "{"), (2, None, "{")]
    assert parsed_lines(spark.createDataFrame(rows, schema)).count() == 2
    assert parsed_lines(spark.createDataFrame([], schema)).count() == 0


NO_JSON = ["NaN", "Infinity", "-Infinity", "Inf", "-Inf", "-NaN", "[1,NaN]", "[ NaN]", '["a",\t-Infinity, "b"]', r'"x\\",  "q":-Inf', r'1,"x\"y":NaN']
NO_JSON_FIRST = '{"speed" : NaN,"RouteId":"1","RouteVarId":"2","lat":[1.5],"lng":[2]}'


def test_further_fields_are_read_strictly(spark):
    line = lambda x: f'{{"RouteId":"1","RouteVarId":"2","lat":[1.5],"lng":[2],"speed":{x}}}'
    sound = [line(x) for x in ("1", '"NaN"', '"a,Infinity"', '", NaN"', '[":Inf"]', "null")]
    rows = [(i, "f", body) for i, body in enumerate([*map(line, NO_JSON), *sound, NO_JSON_FIRST])]
    got = {r.line_id: r for r in parsed_lines(spark.createDataFrame(rows, "line_id long, feed string, body string")).collect()}
    for i, _, body in rows:
        assert got[i].status == ("good" if body in sound else "bad"), body
        assert got[i].reason == diagnose(body)[0]


def test_half_a_surrogate_pair(spark):
    rows = [(1, "f", GOOD.replace('"1"', '"\\ud800"')), (2, "f", GOOD.replace('"2"', '"a\\udc00b"')), (3, "f", GOOD.replace('"1"', '"\\ud83d\\ude00"')), (4, "f", GOOD), (5, "f", "{"), (6, "f", DEEP[0][0]), (7, "f", DEEP[1][0])]
    got = {r.line_id: r for r in parsed_lines(spark.createDataFrame(rows, "line_id long, feed string, body string")).collect()}
    assert [got[i].status for i in range(1, 6)] == ["good"] * 4 + ["bad"] and got[6].status == got[7].status == "good"
    assert (got[1].RouteId, got[2].RouteVarId, got[3].RouteId) == ("\ufffd", "a\ufffdb", "\U0001f600")
