"""Deeply nested documents as flat tables whose rows name their parents.

Typed documents are exploded level by level. JSON texts go through a structural index: over
the bytes of a whole batch, bitmaps of quotes, brackets and delimiters are built, nesting
depth is a prefix sum over the brackets outside of strings, and the spans between delimiters
become value rows that are linked to their containers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.plans.storage import stored
from sheafline.sources.tables import table

#: Bytes of JSON text indexed at a time; a longer text is indexed alone.
BATCH_BYTES = 4 << 20
#: Levels below the root that the tables name: an outer object, content, sections, blocks, rows and their elements.
TABLE_DEPTH = 9

_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def _constant(name: str):
    raise ValueError(name)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)')


def _valid_at_any_depth(text: str) -> bool:
    """Token by token, with the open brackets in a list."""
    opened: list[str] = []
    wanted, at, end = "value", 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        token = _TOKEN.match(text, at)
        if token is None:
            return False
        at, mark, is_string = token.end(), token[1], token[2] is not None
        if wanted == "first key" and mark == "}" or wanted == "first value" and mark == "]" or wanted == "next" and opened and mark == {"[": "]", "{": "}"}[opened[-1]]:
            opened.pop()
            wanted = "next"
        elif wanted in ("key", "first key"):
            if not is_string:
                return False
            wanted = "colon"
        elif wanted == "colon":
            if mark != ":":
                return False
            wanted = "value"
        elif wanted == "next":
            if mark != "," or not opened:
                return False
            wanted = "key" if opened[-1] == "{" else "value"
        elif mark in ("[", "{"):
            opened.append(mark)
            wanted = "first value" if mark == "[" else "first key"
        elif mark is None:
            wanted = "next"
        else:
            return False
    return wanted == "next" and not opened


def valid_json(text: str) -> bool:
    """Whether the text is one JSON value, nested however deep; NaN and infinities are none."""
    try:
        json.loads(text, parse_constant=_constant)
        return True
    except ValueError:
        return False
    except RecursionError:
        return _valid_at_any_depth(text)


def structural_index(texts: list[bytes]) -> dict[str, np.ndarray | list]:
    """Linked value rows of valid JSON texts.

    ``doc`` text number, ``node``/``parent`` row numbers (parent -1 at the root), ``key``
    (None in arrays), ``index`` place in the container, ``start``/``end`` span of the value in
    the joined bytes, ``depth``, and the joined ``data``.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]].astype(np.int64)
    # a quote counts when an even number of backslashes stands before it
    at = np.arange(len(data))
    solid = np.maximum.accumulate(np.where(data != 0x5C, at, -1))
    slashes = np.r_[0, (at - solid)[:-1]]
    quote = (data == 0x22) & (slashes % 2 == 0)
    inside = np.cumsum(quote) % 2 == 1
    opened = ((data == _OPEN[0]) | (data == _OPEN[1])) & ~inside
    closed = ((data == _CLOSE[0]) | (data == _CLOSE[1])) & ~inside
    delimiter = ((data == 0x2C) | (data == 0x3A)) & ~inside
    marks = np.flatnonzero(opened | closed | delimiter)
    depth_at = np.cumsum(opened.astype(np.int32) - closed.astype(np.int32))
    char = data[marks]
    depth = depth_at[marks]
    # container of each mark: the last bracket opened at its depth; every depth but 0 begins with one
    is_open = np.isin(char, _OPEN)
    by_depth = np.argsort(depth, kind="stable")
    last = np.maximum.accumulate(np.where(is_open[by_depth], np.arange(len(marks)), -1))
    container = np.full(len(marks), -1)
    container[by_depth[last >= 0]] = by_depth[last[last >= 0]]
    # values stand after an opened array, a colon, a comma in an array, and at the start of a text
    in_array = np.zeros(len(marks), bool)
    known = container >= 0
    in_array[known] = char[container[known]] == _OPEN[1]
    leads = np.flatnonzero((char == 0x3A) | ((char == 0x2C) & in_array) | (char == _OPEN[1]))
    value_from = np.r_[begins, marks[leads] + 1]
    holder = np.r_[np.full(len(begins), -1), np.where(is_open[leads], leads, container[leads])]
    lead = np.r_[np.full(len(begins), -1), leads]
    # trim: the first visible byte at or after the start
    visible = np.where(~_SPACE[data], at, len(data))
    nxt = np.minimum.accumulate(visible[::-1])[::-1]
    start = nxt[value_from]
    fine = start < len(data)
    # an opened array that closes at once holds no value
    fine[fine] &= ~(closed[start[fine]])
    order = np.argsort(start[fine], kind="stable")
    start, holder, lead = (x[fine][order] for x in (start, holder, lead))
    # where a value is a container its end is the matching bracket, else the last visible byte before the next mark
    following = np.searchsorted(marks, start)
    ends_at = np.r_[marks, len(data)]
    text_of = np.searchsorted(begins, start, side="right") - 1
    stop = np.minimum(ends_at[following], np.r_[begins[1:], len(data)][text_of] - 1)
    prev = np.maximum.accumulate(np.where(~_SPACE[data], at, -1))
    end = prev[stop - 1] + 1
    own = np.full(len(start), -1)
    boxed = np.zeros(len(start), bool)
    boxed[following < len(marks)] = marks[following[following < len(marks)]] == start[following < len(marks)]
    own[boxed] = following[boxed]
    node_of = np.full(len(marks) + 1, -1)
    node_of[own[boxed]] = np.flatnonzero(boxed)
    parent = np.where(holder >= 0, node_of[holder], -1)
    # place in the container
    by = np.lexsort((start, parent, text_of))
    run = np.r_[True, (parent[by][1:] != parent[by][:-1]) | (text_of[by][1:] != text_of[by][:-1])] if len(by) else np.zeros(0, bool)
    index = np.empty(len(start), np.int64)
    index[by] = np.arange(len(by)) - np.flatnonzero(run)[np.cumsum(run) - 1] if len(by) else 0
    # the key of a member is the string between the mark before its colon and the colon
    keyed = (lead >= 0) & (np.r_[char, 0][lead] == 0x3A)
    key_span = np.zeros((len(start), 2), np.int64)
    k = lead[keyed]
    key_span[keyed, 0] = nxt[marks[k - 1] + 1] + 1
    key_span[keyed, 1] = prev[marks[k] - 1]
    return {"doc": text_of, "parent": parent, "keyed": keyed, "key_span": key_span, "index": index, "start": start, "end": end, "boxed": boxed, "data": data}


def _string(raw: bytes) -> str:
    return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode()


_NODES = "doc long, path string, places array<int>, kind string, value string"


def _rows(keys: list[int], texts: list[bytes], deepest: float) -> pa.RecordBatch:
    x = structural_index(texts)
    data = x["data"].tobytes()
    parent, keyed, span = x["parent"].tolist(), x["keyed"].tolist(), x["key_span"].tolist()
    paths: list[str] = []
    places: list[tuple] = []
    depths: list[int] = []
    kinds, values, shown = [], [], []
    kind_of = {0x22: "string", 0x7B: "object", 0x5B: "array", 0x74: "boolean", 0x66: "boolean", 0x6E: "null"}
    for i, (p, k, s, e, n, boxed) in enumerate(zip(parent, keyed, x["start"].tolist(), x["end"].tolist(), x["index"].tolist(), x["boxed"].tolist())):
        depths.append(depths[p] + 1 if p >= 0 else 0)
        if depths[i] > deepest:
            paths.append("")
            places.append(())
            continue
        above, where = (paths[p] + ".", places[p]) if p >= 0 else ("", ())
        shown.append(i)
        if p < 0:
            paths.append("$")
            places.append(())
        elif k:
            a, b = span[i]
            paths.append(above + _string(data[a:b]).replace(".", "\\."))
            places.append(where)
        else:
            paths.append(above + "[]")
            places.append((*where, n))
        kind = kind_of.get(data[s], "number")
        kinds.append(kind)
        values.append(None if boxed or kind == "null" else _string(data[s + 1 : e - 1]) if kind == "string" else data[s:e].decode())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(keys, np.int64)[x["doc"][shown]]), pa.array([paths[i] for i in shown], pa.string()), pa.array([list(places[i]) for i in shown], pa.list_(pa.int32())), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
        names=["doc", "path", "places", "kind", "value"],
    )


def _index_json(deepest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not valid_json(body):
                    continue
                raw = body.encode("utf-8", "surrogatepass")
                if texts and size + len(raw) > BATCH_BYTES:
                    yield _rows(keys, texts, deepest)
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(raw)
                size += len(raw)
            if texts:
                yield _rows(keys, texts, deepest)

    return run


def json_values(bodies: DataFrame, key: str, body: str, deepest: float = np.inf) -> DataFrame:
    """``doc, path, places, kind, value``: a row for each value of each valid JSON text.

    ``path`` names the members from the root ``$`` on, ``[]`` standing for a list element whose
    place is in ``places``. Null, empty and broken texts give no row. Values more than
    ``deepest`` levels below the root are left out; a path is as long as its value is deep.
    """
    return bodies.where(F.col(body).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(body).cast("string")).mapInArrow(_index_json(deepest), _NODES)


def raw_values(raw: DataFrame) -> DataFrame:
    """Values of ``raw_records`` with content given as JSON text opened and an outer ``document`` removed."""
    bodies = raw.select("body").where("body is not null").distinct().withColumn("doc", F.xxhash64("body"))
    values = stored(json_values(bodies, "doc", "body", TABLE_DEPTH).withColumn("path", F.regexp_replace("path", r"^\$\.document\.", r"\$.")))
    texts = values.where("path = '$.content' and kind = 'string'").select("doc", "value").distinct()
    inner = json_values(texts, "doc", "value", TABLE_DEPTH).withColumn("path", F.concat(F.lit("$.content"), F.expr("substring(path, 2)")))
    return values.where("not (path = '$.content' and kind = 'string')").unionByName(inner)


def _place(tail: str, before: tuple[str, ...]) -> Column:
    """Place in the list ``tail``; a lone value stands at 0."""
    has = lambda t: F.col("path").rlike(t).cast("int")
    at = F.lit(1)
    for t in before:
        at = at + has(t)
    return F.when(F.col("path").rlike(tail), F.element_at("places", at)).otherwise(0)


_S, _B, _R, _C, _I = (r"^\$\.content\.sections\.\[\]", r"\.blocks\.\[\]", r"\.rows\.\[\]", r"\.rows\.\[\]\.\[\]$", r"\.items\.\[\]$")


def _leaf(values: DataFrame, pattern: str) -> DataFrame:
    return values.where(F.col("path").rlike(r"^\$\.content\.sections(\.\[\])?" + pattern)).withColumn("section_no", _place(_S, ()))


class NestedTables:
    """Flat tables of structured and raw documents; ``document_id`` and the numbers name the parents.

    Numbers are 0-based places in the stored lists, nulls counted. A lone value in a list's
    place is a list of one. Null lists and null elements give no row of their own. Documents
    without an id keep a null ``document_id``. Repeated documents give the same rows once.
    Texts of any length are indexed whole. Empty tables give empty tables. Only the named
    columns are read, so others cannot clash.
    """

    def __init__(self, structured: DataFrame, raw: DataFrame):
        self._typed = structured.select("document_id", "document_type", "content")
        self._values = stored(raw_values(raw))
        id_ = lambda p: F.min(F.when(F.col("path") == p, F.col("value")))
        members = self._values.where(F.col("path").isin("$.document_id", "$.metadata.document_id", "$.document_type", "$.content.title") & F.col("kind").isin("string", "number"))
        named = self._values.select("doc").distinct().join(members.groupBy("doc").agg(F.coalesce(id_("$.document_id"), id_("$.metadata.document_id")).alias("document_id"), id_("$.document_type").alias("document_type"), id_("$.content.title").alias("title")), "doc", "left")
        self._named = stored(named)

    def _with_id(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._named.select("doc", "document_id"), "doc")

    def _typed_blocks(self) -> DataFrame:
        s = self._typed.select("document_id", F.posexplode("content.sections").alias("section_no", "s"))
        return s.select("document_id", "section_no", F.posexplode("s.blocks").alias("block_no", "b"))

    def documents(self) -> DataFrame:
        typed = self._typed.select("document_id", "document_type", F.col("content.title").alias("title"))
        return typed.unionByName(self._named.select("document_id", "document_type", "title")).distinct()

    def sections(self) -> DataFrame:
        typed = self._typed.select("document_id", F.posexplode("content.sections").alias("section_no", "s")).where("s is not null").select("document_id", "section_no", F.col("s.heading").alias("heading"))
        place = ["doc", "section_no"]
        found = _leaf(self._values, "$").where("kind not in ('null', 'array')").select(*place).distinct()
        heading = _leaf(self._values, r"\.heading$").select(*place, F.col("value").alias("heading"))
        return typed.unionByName(self._with_id(found.join(heading, place, "left")).select("document_id", "section_no", "heading")).distinct()

    def blocks(self) -> DataFrame:
        typed = self._typed_blocks().where("b is not null").select("document_id", "section_no", "block_no", F.col("b.type").alias("type"), F.col("b.text").alias("text"))
        v = lambda p: _leaf(self._values, r"\.blocks(\.\[\])?" + p).withColumn("block_no", _place(_B, (_S,)))
        place = ["doc", "section_no", "block_no"]
        found = v("$").where("kind not in ('null', 'array')").select(*place).distinct()
        for member in ("type", "text"):
            found = found.join(v(rf"\.{member}$").select(*place, F.col("value").alias(member)), place, "left")
        return typed.unionByName(self._with_id(found).select("document_id", "section_no", "block_no", "type", "text")).distinct()

    def rows(self) -> DataFrame:
        """A row for each non-null row of a table block."""
        typed = self._typed_blocks().select("document_id", "section_no", "block_no", F.posexplode("b.rows").alias("row_no", "r")).where("r is not null").drop("r")
        v = _leaf(self._values, r"\.blocks(\.\[\])?\.rows(\.\[\])?$").withColumn("block_no", _place(_B, (_S,))).withColumn("row_no", _place(_R, (_S, _B)))
        lone = F.col("path").rlike(r"\.rows$") & (F.col("kind") == "array")
        found = v.where((F.col("kind") != "null") & ~lone).select("doc", "section_no", "block_no", "row_no")
        return typed.unionByName(self._with_id(found).drop("doc").select(*typed.columns)).distinct()

    def cells(self) -> DataFrame:
        typed = self._typed_blocks().select("document_id", "section_no", "block_no", F.posexplode("b.rows").alias("row_no", "r"))
        typed = typed.select("document_id", "section_no", "block_no", "row_no", F.posexplode("r").alias("cell_no", "value")).where("value is not null")
        v = _leaf(self._values, r"\.blocks(\.\[\])?\.rows(\.\[\]){0,2}$").withColumn("block_no", _place(_B, (_S,))).withColumn("row_no", _place(_R, (_S, _B))).withColumn("cell_no", _place(_C, (_S, _B, _R)))
        held = F.col("path").rlike(_C) | (F.col("kind") != "array")
        found = v.where((F.col("kind") != "null") & held).select("doc", "section_no", "block_no", "row_no", "cell_no", "value")
        return typed.unionByName(self._with_id(found).select(*typed.columns)).distinct()

    def items(self) -> DataFrame:
        typed = self._typed_blocks().select("document_id", "section_no", "block_no", F.posexplode("b.items").alias("item_no", "value")).where("value is not null")
        v = _leaf(self._values, r"\.blocks(\.\[\])?\.items(\.\[\])?$").withColumn("block_no", _place(_B, (_S,))).withColumn("item_no", _place(_I, (_S, _B)))
        held = F.col("path").rlike(_I) | (F.col("kind") != "array")
        found = v.where((F.col("kind") != "null") & held).select("doc", "section_no", "block_no", "item_no", "value")
        return typed.unionByName(self._with_id(found).select(*typed.columns)).distinct()


def nested_tables(spark: SparkSession, folder: str) -> NestedTables:
    return NestedTables(table(spark, folder, "structured_documents"), table(spark, folder, "raw_records", "body"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    tables = nested_tables(spark, folder)
    place = ["document_id", "section_no", "block_no"]
    cells = tables.cells().select(*place, F.lit("cell").alias("element"), "row_no", "cell_no")
    items = tables.items().select(*place, F.lit("item").alias("element"), F.col("item_no").alias("row_no"), F.lit(0).alias("cell_no"))
    return cells.unionByName(items).distinct()


def _query(name: str):
    return lambda spark, folder: getattr(nested_tables(spark, folder), name)()


QUERIES = {"p2_found": p2_found} | {f"p2_{n}": _query(n) for n in ("documents", "sections", "blocks", "rows", "cells", "items")}

_json_list = "case when {0} is null or json_type({0}) = 'NULL' then []::json[] when json_type({0}) = 'ARRAY' then from_json({0}, '[\"json\"]') else [{0}] end".format
_json_text = "case when json_type({0}) not in ('NULL', 'ARRAY', 'OBJECT') then {0} ->> '$' end".format
_there = "({0} is not null and json_type({0}) <> 'NULL')".format
_pieces = "unnest({0}) as {1}, generate_subscripts({0}, 1) - 1 as {2}".format


def _level(name: str, above: str, keep: str, held: str, value: str, number: str) -> str:
    """One level of lists below ``above``: its columns ``keep``, each ``value`` of the list ``held``, and its ``number``."""
    return f"{name} as (select {keep}, {_pieces('l', value, number)} from (select {keep}, {held} as l from {above}))"


_AT, _BLOCK = "document_id, section_no", "document_id, section_no, block_no"
_ID = "coalesce({}, {})".format(*(f"case when json_type({x}) in ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') then {_json_text(x)} end" for x in ("j -> '$.document_id'", "j -> '$.metadata.document_id'")))
#: Typed levels begin with t, those of the JSON texts with r.
_LEVELS = ", ".join(
    (
        "bodies as (select cast(body as json) as b from (select distinct body from raw_records where json_valid(body)))",
        "opened as (select case when json_type(b -> '$.document') = 'OBJECT' then b -> '$.document' else b end as j from bodies)",
        f"named as (select {_ID} as document_id, {_json_text('document_type')} as document_type, case when json_type(c) <> 'VARCHAR' then c when json_valid(c ->> '$') then cast(c ->> '$' as json) end as content from (select j, j -> '$.document_type' as document_type, j -> '$.content' as c from opened))",
        _level("ts", "structured_documents", "document_id", "content.sections", "s", "section_no"),
        _level("tb", "ts", _AT, "s.blocks", "b", "block_no"),
        _level("tr", "tb", _BLOCK, "b.rows", "r", "row_no"),
        _level("tc", "tr", _BLOCK + ", row_no", "r", "c", "cell_no"),
        _level("ti", "tb", _BLOCK, "b.items", "c", "item_no"),
        _level("rs", "named", "document_id", _json_list("(content -> '$.sections')"), "s", "section_no"),
        _level("rb", "rs", _AT, _json_list("(s -> '$.blocks')"), "b", "block_no"),
        _level("rr", "rb", _BLOCK, _json_list("(b -> '$.rows')"), "r", "row_no"),
        _level("rc", "rr", _BLOCK + ", row_no", _json_list("r"), "c", "cell_no"),
        _level("ri", "rb", _BLOCK, _json_list("(b -> '$.items')"), "c", "item_no"),
    )
)
_row, _cell, _item = _BLOCK + ", row_no", _BLOCK + ", row_no, cell_no", _BLOCK + ", item_no"
_text_of = lambda x, member: _json_text(f"({x} -> '$.{member}')") + f" as {member}"
_SELECTS = {
    "documents": f"select document_id, document_type, content.title as title from structured_documents union select document_id, document_type, {_text_of('content', 'title')} from named",
    "sections": f"select {_AT}, s.heading as heading from ts where s is not null union select {_AT}, {_text_of('s', 'heading')} from rs where {_there('s')} and json_type(s) <> 'ARRAY'",
    "blocks": f"select {_BLOCK}, b.type as type, b.text as text from tb where b is not null union select {_BLOCK}, {_text_of('b', 'type')}, {_text_of('b', 'text')} from rb where {_there('b')} and json_type(b) <> 'ARRAY'",
    "rows": f"select {_row} from tr where r is not null union select {_row} from rr where {_there('r')}",
    "cells": f"select {_cell}, c as value from tc where c is not null union select {_cell}, {_json_text('c')} from rc where {_there('c')}",
    "items": f"select {_item}, c as value from ti where c is not null union select {_item}, {_json_text('c')} from ri where {_there('c')}",
}
_found = f"select {_BLOCK}, 'cell' as element, row_no, cell_no from (select * from cells) union select {_BLOCK}, 'item', item_no, 0 from (select * from items)"
SQL = {f"p2_{name}": f"with {_LEVELS} {select}" for name, select in _SELECTS.items()}
SQL["p2_found"] = f"with {_LEVELS}, cells as ({_SELECTS['cells']}), items as ({_SELECTS['items']}) {_found}"
