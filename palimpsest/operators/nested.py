"""Deeply nested JSON records turned into related flat tables by structural variants.

The first pass over the documents collects the *list fields*: generic paths (list positions left out) under which any
record holds a list; their number is bounded by the schema, not by the data. The second runs a bottom-up tree automaton
over each document: the state of a leaf is its type, that of a list the set of its elements' states, that of an object
its keys with the states of its children, so that equal structures have equal states in every record, whatever the
order of keys. Each element of a list becomes a row with its state and the path of its parent.

``route`` writes the elements as one table per subtype (a list field, and objects or texts in it), in which every row
keeps the supertype's keys: record, parent and child path, position and state. ``subtypes`` reads all of them by these
keys, ``subtype_table`` one of them with typed columns, and ``variants`` lists the states.

Nothing recurses: documents are walked with a stack, and ``refused`` names those that are no rows because they aren't
JSON or are nested deeper than the parser goes.

Defined results: a NULL, blank, ``null`` or unparseable document has no rows; null elements have no row but count in
positions; numbers and booleans in lists are no elements; a list inside a list adds its own position to the path; an
empty list has no rows; a repeated document id gives its rows once per delivery (callers drop duplicates); extra
columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.shared import materialize

#: More list fields than this mean that keys are data (ids, dates), not field names.
MOST_LIST_FIELDS = 100_000

ELEMENT_SCHEMA = (
    "list_path string, parent_path string, child_path string, ordinal int, depth int, kind string, shape string, "
    "state string, text string, fields map<string,string>"
)
#: A state with a longer name is named by its hash.
LONGEST_STATE = 400


def _parsed(text) -> tuple[object, str | None]:
    """The tree of a JSON text, or None and why there is none."""
    if not isinstance(text, str) or not text.strip():
        return None, None
    try:
        return json.loads(text), None
    except RecursionError:
        return None, "too deep"
    except ValueError:
        return None, "no JSON"


def _loads(text):
    return _parsed(text)[0]


def _sections(document: str | None, sections: tuple[str, ...], wrapper: str | None) -> Iterator[tuple[str, object]]:
    tree = _loads(document)
    while wrapper and isinstance(tree, dict) and wrapper in tree and not any(s in tree for s in sections):
        tree = _loads(tree[wrapper]) if isinstance(tree[wrapper], str) else tree[wrapper]
    if not isinstance(tree, dict):
        return
    for name in sections:
        value = tree.get(name)
        if isinstance(value, str):
            parsed = _loads(value)
            value = parsed if isinstance(parsed, dict | list) else value
        if value is not None:
            yield name, value


def _list_paths(value: object, path: str, found: set[str]) -> None:
    stack = [(value, path)]
    while stack:
        value, path = stack.pop()
        if isinstance(value, dict):
            stack += [(child, f"{path}.{key}") for key, child in value.items()]
        elif isinstance(value, list):
            found.add(path)
            # A list inside a list is a level of its own; other elements share the field's path with a mark.
            stack += [(child, f"{path}[]") for child in value]


def _leaf(value: object) -> str:
    """State of a leaf."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return "number" if isinstance(value, int | float) else "text"


def _named(state: str) -> str:
    return state if len(state) <= LONGEST_STATE else "#" + blake2b(state.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _states(root: object) -> dict[int, tuple[str, str]]:
    """State and shape of every object and list below ``root``, by identity; children come before their parents."""
    found: dict[int, tuple[str, str]] = {}
    stack = [(root, False)]
    while stack:
        value, ready = stack.pop()
        if not isinstance(value, dict | list):
            continue
        children = value.values() if isinstance(value, dict) else value
        if not ready:
            stack.append((value, True))
            stack += [(child, False) for child in children]
            continue
        both = [found[id(c)] if isinstance(c, dict | list) else (_leaf(c),) * 2 for c in children]
        if isinstance(value, list):
            state = "[" + "|".join(sorted({x for x, _ in both})) + "]"
            shape = "[" + "|".join(sorted({"object" if isinstance(c, dict) else x for c, (_, x) in zip(value, both, strict=True)})) + "]"
        else:
            named = sorted(zip(value, both, value.values(), strict=True), key=lambda x: x[0])
            state = "{" + ",".join(f"{k}:{x}" for k, (x, _), _ in named) + "}"
            shape = "{" + ",".join(f"{k}:{'object' if isinstance(c, dict) else x}" for k, (_, x), c in named) + "}"
        found[id(value)] = (_named(state), _named(shape))
    return found


def state_of(value: object) -> str:
    """State that the bottom-up tree automaton reaches at a value: equal for equal structure at every depth."""
    return _states(value)[id(value)][0] if isinstance(value, dict | list) else _leaf(value)


def shape_of(value: object) -> str:
    """The outer shape alone: keys and kinds of the children, without what is inside objects."""
    return _states(value)[id(value)][1] if isinstance(value, dict | list) else _leaf(value)


def _walk(section, name: str, lists: frozenset[str], rows: list) -> None:
    """Rows of the elements below a section."""
    states = _states(section)
    # Values of fields, or elements with their position: generic path, nearest element, path, position, depth.
    stack = [(section, name, name, name, None, 1)]
    while stack:
        value, generic, parent, path, i, depth = stack.pop()
        if i is None and generic in lists and isinstance(value, dict | str):
            i, path = 0, f"{path}[0]"
        if isinstance(value, list):
            inner = generic if i is None else f"{generic}[]"
            stack += [(child, inner, parent, f"{path}[{k}]", k, depth) for k, child in enumerate(value)]
        elif i is not None and isinstance(value, str):
            rows.append((generic, parent, path, i, depth, "text", "text", "text", value, None))
        elif isinstance(value, dict) and i is not None:
            flat = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in value.items() if v is not None and not isinstance(v, dict | list)]
            state, shape = states[id(value)]
            rows.append((generic, parent, path, i, depth, "object", shape, state, None, flat))
            stack += [(child, f"{generic}[].{key}", path, f"{path}.{key}", None, depth + 1) for key, child in value.items()]
        elif isinstance(value, dict):
            stack += [(child, f"{generic}.{key}", parent, f"{path}.{key}", None, depth) for key, child in value.items()]


def list_fields(df: DataFrame, document: str, sections: tuple[str, ...], wrapper: str | None = None) -> list[str]:
    """Generic paths of all fields that hold a list in any record; one small row per field reaches the driver."""

    def find(batches):
        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for name, value in _sections(text, sections, wrapper):
                    _list_paths(value, name, found)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["path"])

    rows = df.select(F.col(document)).mapInArrow(find, "path string").distinct().limit(MOST_LIST_FIELDS + 1).collect()
    if len(rows) > MOST_LIST_FIELDS:
        raise ValueError("keys of the documents look like data; name the fields to flatten")
    return sorted(r.path for r in rows)


def flatten_nested(
    df: DataFrame, key: str, document: str, sections: tuple[str, ...], wrapper: str | None = None, lists: list[str] | None = None
) -> DataFrame:
    """One row per non-null object or text of every list at any depth, with links to the parent element.

    ``key`` names the record, ``document`` its JSON text; only the fields ``sections`` are flattened, also where a
    record wraps them in an object ``wrapper`` or stores a section as JSON text. A bare object or text in a field
    that is a list in other records counts as a list of one.
    """
    known = frozenset(list_fields(df, document, sections, wrapper) if lists is None else lists)
    kind = df.schema[key].dataType.simpleString()
    names = [s.strip().split(" ")[0] for s in ELEMENT_SCHEMA.replace("map<string,string>", "map").split(",")]
    types = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 4 + [pa.map_(pa.string(), pa.string())]

    def expand(batches):
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                before = len(rows)
                for name, value in _sections(text, sections, wrapper):
                    _walk(value, name, known, rows)
                at.extend([i] * (len(rows) - before))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [key, *names]
            )

    return df.select(F.col(key), F.col(document)).mapInArrow(expand, f"{key} {kind}, {ELEMENT_SCHEMA}")


def refused(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, reason) of the documents that hold something but have no rows: ``too deep`` or ``no JSON``."""
    kind = df.schema[key].dataType.simpleString()

    def find(batches):
        for batch in batches:
            reasons = [_parsed(text)[1] for text in batch.column(1).to_pylist()]
            at = [i for i, reason in enumerate(reasons) if reason]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array([reasons[i] for i in at], pa.string())], [key, "reason"])

    return df.select(F.col(key), F.col(document)).mapInArrow(find, f"{key} {kind}, reason string")


def route(elements: DataFrame) -> DataFrame:
    """The elements written as one table per subtype; a read of one subtype touches its table alone."""
    return materialize(elements.withColumn("subtype", F.concat_ws("/", "list_path", "kind")), "subtypes", ["subtype"])


def subtypes(routed: DataFrame, key: str) -> DataFrame:
    """The union of all subtype tables by the keys they have in common."""
    return routed.select(key, "subtype", "parent_path", "child_path", "ordinal", "state")


def variants(elements: DataFrame) -> DataFrame:
    """The states that occur in each list field and how often: the catalogue of subtype tables."""
    return elements.groupBy("list_path", "kind", "shape", "state").agg(F.count("*").alias("n"))


def subtype_table(elements: DataFrame, key: str, list_path: str, fields: dict[str, str], shape: str | None = None) -> DataFrame:
    """The objects of one list (of one shape, if given) as a typed table with the common keys and parent link."""
    rows = elements.filter((F.col("list_path") == list_path) & (F.col("kind") == "object"))
    if "subtype" in elements.columns:
        rows = rows.filter(F.col("subtype") == f"{list_path}/object")
    if shape is not None:
        rows = rows.filter(F.col("shape") == shape)
    return rows.select(
        key, "parent_path", "child_path", "ordinal", "shape", *[F.expr(f"try_cast(fields['{f}'] as {t})").alias(f) for f, t in fields.items()]
    )
