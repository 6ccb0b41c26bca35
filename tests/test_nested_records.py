import json

from pyspark.sql import functions as F

from sheafline.operators.nested_records import NestedTables, _valid_at_any_depth, json_values
from sheafline.sources.schemas import DOCUMENT

WRONG = ["", "  ", "{", '{"a": }', '{"a": 1', "nope", '{"a": NaN}', '["x", ]', '"open']


def walk(value, path="$", places=()):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    yield path, places, kind
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}", places)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, path + ".[]", (*places, i))


GOOD = [
    '{"a": [1, -2.5e3, null, true, []], "b": {}, "c": {"d": [[["x"]], {"e": "q\\"],{:"}]}}',
    "[]", "{}", "3", '"s"', "null", ' [ "a\\\\" , "b" ] ', '{"k\\u0041": "\\u00e9", "z": [{"y": 1}, {"y": [2, 3]}]}',
    json.dumps({"deep": {"x": [[{"y": [1, [2, [3]]]}]] * 3}}, indent=2), json.dumps({"t": "é" * 3000, "l": list(range(500))}),
]


def test_values_equal_a_walk(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(GOOD + WRONG)] + [(99, None)], "id long, body string")
    got: dict = {}
    for r in json_values(df, "id", "body").collect():
        got.setdefault(r.doc, []).append((r.path, tuple(r.places), r.kind))
    assert set(got) == set(range(len(GOOD)))
    for i, x in enumerate(GOOD):
        assert sorted(got[i]) == sorted(walk(json.loads(x)))


def test_scalar_values(spark):
    df = spark.createDataFrame([(1, '{"s": "a\\n\\u20ac", "n": -1.50, "b": false, "z": null}')], "id long, body string")
    assert {r.path: r.value for r in json_values(df, "id", "body").collect()} == {"$": None, "$.s": "a\n€", "$.n": "-1.50", "$.b": "false", "$.z": None}


def tables(spark, typed, bodies, extra=False):
    raw = spark.createDataFrame([(b,) for b in bodies], "body string")
    d = spark.createDataFrame(typed, DOCUMENT)
    if extra:
        raw, d = raw.withColumn("doc", F.lit(1)).withColumn("path", F.lit("x")), d.withColumn("section_no", F.lit(9)).withColumn("value", F.lit("v"))
    return NestedTables(d, raw)


def block(**x):
    return {"type": "table", "text": None, **x}


BODY = {"document_id": "r1", "content": {"sections": [None, {"blocks": [None, block(rows=[["a", None, ""], None, [1, True]], items=["i", None])]}]}}


def found(t):
    cells = {(r.document_id, r.section_no, r.block_no, r.row_no, r.cell_no, r.value) for r in t.cells().collect()}
    return cells, {(r.document_id, r.section_no, r.block_no, r.item_no, r.value) for r in t.items().collect()}


def test_every_writing_of_a_record(spark):
    inner = json.dumps(BODY["content"])
    lone = {"metadata": {"document_id": "r2"}, "content": {"sections": {"blocks": {"rows": "x", "items": "y", "other": 1}}}}
    bodies = [json.dumps(BODY), json.dumps(BODY), json.dumps({"document": BODY}), json.dumps({"document_id": "r3", "content": inner}), json.dumps(lone), None, "", "{broken", "[1]", '{"content": null}', '{"document_id": "n", "content": "not json"}']
    cells, items = found(tables(spark, [], bodies, extra=True))
    want = {(0, 0, "a"), (0, 2, ""), (2, 0, "1"), (2, 1, "true")}
    assert cells == {(d, 1, 1, *w) for d in ("r1", "r3") for w in want} | {("r2", 0, 0, 0, 0, "x")}
    assert items == {("r1", 1, 1, 0, "i"), ("r3", 1, 1, 0, "i"), ("r2", 0, 0, 0, "y")}


def test_typed_records_and_parents(spark):
    typed = [
        {"document_id": "d", "content": {"title": "T", "sections": [{"heading": "H", "blocks": [{"type": "list", "items": ["a", None]}, None, {"type": "table", "rows": [["x"], None, [None, "y"]]}]}, None]}},
        {"document_id": "e", "content": None}, {"document_id": None, "content": {"sections": []}}, {"document_id": "f", "content": {"sections": [{"blocks": None}]}},
    ]
    t = tables(spark, typed + typed[:1], [], extra=True)
    cells, items = found(t)
    assert cells == {("d", 0, 2, 0, 0, "x"), ("d", 0, 2, 2, 1, "y")} and items == {("d", 0, 0, 0, "a")}
    assert t.blocks().count() == 2 and t.rows().count() == 2 and t.documents().count() == 4
    assert {(r.document_id, r.section_no, r.heading) for r in t.sections().collect()} == {("d", 0, "H"), ("f", 0, None)}


def test_empty_tables(spark):
    t = tables(spark, [], [])
    assert [getattr(t, n)().count() for n in ("documents", "sections", "blocks", "rows", "cells", "items")] == [0] * 6


def test_bodies_nested_very_deep(spark):
    deep = 20_000
    good, broken = "[" * deep + "]" * deep, '{"a":' * deep + "1" + "}" * (deep - 1)
    body = '{"document_id": "r", "content": {"sections": [{"blocks": [{"items": ["i"], "x": %s}]}]}}'
    assert found(tables(spark, [], [body % good, body % broken]))[1] == {("r", 0, 0, 0, "i")}
    values = json_values(spark.createDataFrame([(1, good)], "id long, body string"), "id", "body", 3)
    assert values.count() == 4


def test_validity_token_by_token():
    for x in GOOD:
        assert _valid_at_any_depth(x) and _valid_at_any_depth(f" [{x}, {x}] ")
    for x in WRONG + ["1 2", "[1,]", "{,}", '{"a" 1}', "[1}", '{"a": 1]', "]", "[]]", "01", '"a\nb"', '"\\x"', '{1: 2}', '{"a": 1,}', "[:]", "tru"]:
        assert not _valid_at_any_depth(x)
