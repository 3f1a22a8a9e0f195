"""Files to flat rows by a parse in Python: one parse of each file, dealt over all cores."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields by kind of node, those aside that hold no nodes.
_HOLD = {c: tuple(f for f in c._fields if f not in ("ctx", "type_comment", "kind", "attr", "asname")) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)}
#: Texts whose rows a task remembers, and their length at most: copies are parsed once.
COPIES, COPY = 64, 1 << 14
#: Rows that are handed on at once, and tasks for each core: files differ in size.
ROWS, TASKS = 8192, 4
_KINDS = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of which each stands for much work, dealt over all cores by ``key``, however few splits they are read in."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism, key)


def walked(node: ast.AST) -> list[ast.AST]:
    """The nodes of a tree in the order of ``ast.walk``; contexts, operators and other nodes without fields are left out."""
    out, hold = [node], _HOLD
    for n in out:
        if n.__class__ is ast.Name or n.__class__ is ast.Constant:
            continue
        for f in hold[n.__class__]:
            value = getattr(n, f)
            if value.__class__ is list:
                out += [x for x in value if hold.get(x.__class__)]
            elif hold.get(value.__class__):
                out.append(value)
    return out


def parsed(files: DataFrame, path_col: str, text_col: str, rows_of: Callable[[str, str], Iterable[tuple]], schema: str, copies: bool = False) -> DataFrame:
    """The rows ``rows_of(path, text)`` of every file, by ``schema``. Null texts are empty.

    With ``copies``, rows follow from the text but for the path that begins them, and short texts that come again are
    not parsed again.
    """
    fields = [f.split(" ") for f in schema.split(", ")]
    names, kinds = [f[0] for f in fields], [_KINDS[f[1]] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(COPIES)(lambda text: [r[1:] for r in rows_of("", text)])
        of = (lambda p, t: ((p, *r) for r in known(t)) if len(t) <= COPY else rows_of(p, t)) if copies else rows_of
        each = (zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        rows = chain.from_iterable(of(p, t or "") for p, t in chain.from_iterable(each))
        while some := list(islice(rows, ROWS)):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names=names)

    return files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
