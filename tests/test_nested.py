import json

from palimpsest.operators.nested import flatten_nested, refused, route, shape_of, state_of, subtype_table, subtypes, variants

DOCS = [
    (1, json.dumps({"a": {"xs": [{"k": "v", "ys": ["p", None, "q"]}, None, "bare"]}, "other": {"zs": [1]}})),
    (2, json.dumps({"wrap": {"a": json.dumps({"xs": {"k": 3, "ys": "single"}})}})),
    (3, None),
    (4, "   "),
    (5, "null"),
    (6, "{broken"),
    (7, json.dumps({"a": {"xs": []}})),
    (8, json.dumps({"a": [["n"], {"t": True}, 5]})),
]


def rows(spark, docs):
    df = spark.createDataFrame([(*d, "x") for d in docs], "id long, doc string, parent_path string")
    return flatten_nested(df, "id", "doc", ("a",), wrapper="wrap")


def test_bare_values_are_lists_of_one(spark):
    got = {(r.id, r.parent_path, r.child_path) for r in rows(spark, DOCS[:7]).collect()}
    assert got == {
        (1, "a", "a.xs[0]"),
        (1, "a.xs[0]", "a.xs[0].ys[0]"),
        (1, "a.xs[0]", "a.xs[0].ys[2]"),
        (1, "a", "a.xs[2]"),
        (2, "a", "a.xs[0]"),
        (2, "a.xs[0]", "a.xs[0].ys[0]"),
    }


def test_lists_in_lists(spark):
    got = {(r.parent_path, r.child_path, r.kind) for r in rows(spark, DOCS[7:]).collect()}
    assert got == {("a", "a[0][0]", "text"), ("a", "a[1]", "object")}


def test_empty_table(spark):
    assert rows(spark, []).count() == 0


def test_subtypes_keep_keys(spark):
    elements = rows(spark, DOCS[:7])
    typed = subtype_table(elements, "id", "a.xs", {"k": "int"}).collect()
    assert {(r.id, r.child_path, r.k) for r in typed} == {(1, "a.xs[0]", None), (2, "a.xs[0]", 3)}
    assert {(r.list_path, r.n) for r in variants(elements).filter("kind = 'text'").collect()} == {("a.xs", 1), ("a.xs[].ys", 3)}


def test_shapes_do_not_depend_on_key_order():
    assert shape_of({"a": 1, "b": ["x", {"c": 1}]}) == shape_of({"b": [{"d": 2}, "y"], "a": 2.5})
    assert shape_of({"a": 1}) != shape_of({"a": "1"})


def test_states_tell_structures_apart_at_every_depth():
    assert state_of({"a": [{"x": 1}]}) != state_of({"a": [{"x": "s"}]})
    assert state_of({"a": {"x": 1}}) != state_of({"a": {"y": "s"}})
    assert state_of({"a": [{"x": 1}, {"x": 2}], "b": None}) == state_of({"b": None, "a": [{"x": 3}]})
    assert state_of([[[]]]) == "[[[]]]"


def test_routed_tables_hold_every_element(spark):
    elements = rows(spark, DOCS[:7])
    routed = route(elements)
    keys = ["id", "parent_path", "child_path"]
    assert sorted(map(tuple, subtypes(routed, "id").select(keys).collect())) == sorted(map(tuple, elements.select(keys).collect()))
    assert {r.subtype for r in routed.select("subtype").distinct().collect()} == {"a.xs/object", "a.xs/text", "a.xs[].ys/text"}
    assert {(r.id, r.k) for r in subtype_table(routed, "id", "a.xs", {"k": "int"}).collect()} == {(1, None), (2, 3)}


def test_too_deep_documents_are_named(spark):
    deep = '{"a": ' + "[" * 200_000 + "]" * 200_000 + "}"
    far = '{"a": ' + "[" * 500 + '"x"' + "]" * 500 + "}"
    df = spark.createDataFrame([(1, deep), (2, "{broken"), (3, None), (4, far)], "id long, doc string")
    assert {tuple(r) for r in refused(df, "id", "doc").collect()} == {(1, "too deep"), (2, "no JSON")}
    got = flatten_nested(df, "id", "doc", ("a",)).collect()
    assert [(r.id, r.child_path) for r in got] == [(4, "a" + "[0]" * 500)]
