"""Markdown texts to a table of their blocks: headings, rules, tables, lists and paragraphs.

A text's lines are told apart by how they begin, and neighbours of a kind are one block:
table rows without their divider, items of one sort of list (also across a single blank
line, when an item follows it), lines of a paragraph.  Line breaks inside a paragraph are blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: What counts as blank, and what a line may hold: fixed values of ECMAScript's patterns.
_BLANKS = "\t\n\v\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S, _ANY = f"[{_BLANKS}]", "[^\n\r\u2028\u2029]"
_TRIMMED = re.compile(f"^{_S}+|{_S}+$")
#: How a line of each kind looks, in the order in which they are tried; the group is what it holds.
KINDS = (
    ("blank", re.compile(f"{_S}*()")),
    ("heading", re.compile(f"#{{1,6}}{_S}+({_ANY}*)")),
    ("rule", re.compile(f"{_S}*(?:-{{3,}}|\\*{{3,}}|_{{3,}}){_S}*()")),
    ("row", re.compile(f"{_S}*\\|({_ANY}*)\\|{_S}*")),
    ("bullet", re.compile(f"{_S}*[-*+]{_S}+({_ANY}*)")),
    ("numbered", re.compile(f"{_S}*[0-9]+[.)]{_S}+({_ANY}*)")),
    ("prose", re.compile("([^\n]*)")),
)
_DIVIDER = re.compile(f"{_S}*\\|(?:{_S}|[|:-])+\\|{_S}*")
BLOCK = "ordinal int, kind string, level int, ordered boolean, text string, items array<string>, head array<string>, body array<array<string>>"


def _read(line: str) -> tuple[str, str]:
    for kind, look in KINDS:
        if m := look.fullmatch(line):
            return kind, m[1]
    return "prose", line


def _cells(inside: str) -> list[str]:
    return [_TRIMMED.sub("", c) for c in inside.split("|")]


def blocks(text: str | None) -> Iterator[dict]:
    """The blocks of one text, each with what its kind has."""
    lines = [(line, *_read(line)) for line in (text or "").replace("\r\n", "\n").split("\n")]
    at, n = 0, len(lines)

    def run(kind: str, loose: bool = False) -> list[int]:
        """The lines of ``kind`` from here on; ``loose``: single blank lines between them do not part them."""
        nonlocal at
        found = []
        while at < n:
            if lines[at][1] == kind:
                found.append(at)
            elif not (loose and lines[at][1] == "blank" and at + 1 < n and lines[at + 1][1] == kind):
                break
            at += 1
        return found

    while at < n:
        line, kind, inside = lines[at]
        if kind == "row":
            rows = [_cells(lines[k][2]) for k in run("row") if not _DIVIDER.fullmatch(lines[k][0])]
            yield {"kind": "table", "head": rows[0] if rows else [], "body": rows[1:]}
        elif kind in ("bullet", "numbered"):
            yield {"kind": "list", "ordered": kind == "numbered", "items": [lines[k][2] for k in run(kind, loose=True)]}
        elif kind == "prose":
            yield {"kind": "paragraph", "text": " ".join(_TRIMMED.sub("", lines[k][0]) for k in run("prose"))}
        else:
            at += 1
            if kind == "heading":
                yield {"kind": "heading", "level": len(line) - len(line.lstrip("#")), "text": inside}
            elif kind == "rule":
                yield {"kind": "rule"}


def markdown_blocks(texts: DataFrame, text_col: str = "text", most: int = 4_000) -> DataFrame:
    """A row a block, in order by ``ordinal``, with the columns of ``texts`` but its text; ``most`` blocks an Arrow batch.

    A null or empty text has none.
    """
    keep = [c for c in texts.columns if c != text_col]
    shape = StructType.fromDDL(BLOCK)
    schema = StructType([*[f for f in texts.schema.fields if f.name in keep], *[StructField(f.name, f.dataType) for f in shape.fields]])
    names = shape.fieldNames()
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []

            def out():
                arrays = [batch.column(k).take(pa.array(of, pa.int64())) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*arrays, *[pa.array([b.get(c) for b in found], t) for c, t in zip(names, kinds, strict=True)]], schema.names)

            for row, text in enumerate(batch.column(len(keep)).to_pylist()):
                for ordinal, block in enumerate(blocks(text)):
                    of.append(row)
                    found.append(block | {"ordinal": ordinal})
                    if len(found) >= most:
                        yield out()
                        of, found = [], []
            if found:
                yield out()

    return texts.select(*keep, text_col).mapInArrow(run, schema)
