"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over words of the normalised items and carries, for every class
of equal end positions, the items in which its strings occur. Training text is streamed
through it one word at a time; the state and the matched length give the longest suffix
of the text so far that occurs in an item, so a window of ``window`` item words ends
wherever that length reaches ``window``. An item shorter than a window is one window.

Items are broadcast in blocks of bounded size (``block_words``): more test items mean
more blocks, each a stated set run against all documents, never a larger broadcast.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.common import saved, table
from guardlake.llm.words import trim

WINDOW = 10
#: A-Z to a-z; bytes 00-2F, 3A-60 and 7B-7F to a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: dict[object, list[bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        coded = {k: [self.ids.setdefault(w, len(self.ids)) for w in ws] for k, ws in items.items() if ws}
        for ws in coded.values():
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: By state: items with a window among its strings (a window is a whole item if that is shorter).
        self.items: dict[int, set] = defaultdict(set)
        #: By state: lengths of its strings that are windows; at most one is a class of its own length.
        self.sizes: dict[int, set[int]] = defaultdict(set)
        for k, ws in coded.items():
            state = matched = 0
            for i, w in enumerate(ws):
                state, matched = self.next[state][w], matched + 1
                if len(ws) < window:
                    if i == len(ws) - 1:
                        self._mark(state, len(ws), k)
                elif matched >= window:
                    self._mark(state, window, k)
        #: By state: the marked states on its suffix path, with the window lengths there.
        self.marked: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.link)
        self.least = min((n for s in self.sizes.values() for n in s), default=0)

    def _mark(self, state: int, size: int, item: object) -> None:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        self.items[state, size].add(item)
        self.sizes[state].add(size)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def _windows(self, state: int) -> tuple[tuple[int, int], ...]:
        """(state, size) of the windows that are suffixes of the state's strings, largest first."""
        found, s = [], state
        while s > 0:
            found += [(s, n) for n in sorted(self.sizes.get(s, ()), reverse=True)]
            s = self.link[s]
        self.marked[state] = tuple(found)
        return self.marked[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged word spans that occur as windows, and the items they are windows of."""
        ids, nxt, link, length, marked = self.ids.get, self.next, self.link, self.length, self.marked
        spans: list[list[int]] = []
        met: set[tuple[int, int]] = set()
        state = matched = 0
        least = self.least
        for i, w in enumerate(map(ids, words)):
            if w is None:
                state = matched = 0
                continue
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= least:
                at = marked[state]
                for s, n in self._windows(state) if at is None else at:
                    if n <= matched:
                        met.add((s, n))
                        a, b = i + 1 - n, i + 1
                        while spans and spans[-1][1] >= a:
                            a = min(a, spans.pop()[0])
                        spans.append([a, b])
        return [(a, b) for a, b in spans], set().union(*(self.items[x] for x in met)) if met else set()


_built: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items, window: int) -> SuffixAutomaton:
    """One automaton per Python worker: that of the block in use."""
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(items.value, window)
    return _built[key]


#: An item's id as a string, or null, and a number that tells items of one id apart.
Item = tuple[str | None, int]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[dict[Item, list[bytes]]]:
    """Items in blocks of up to ``block_words`` words (or one item); repeated ids and texts join, items without a text are none."""
    block: dict[Item, list[bytes]] = {}
    size = 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("k"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct()
    for r in rows.orderBy("k", "t").toLocalIterator():
        ws = tokens(r.t.encode())
        if block and size + len(ws) > block_words:
            yield block
            block, size = {}, 0
        block[r.k, len(block)], size = ws, size + len(ws)
    yield block


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = 200_000, prefix: str = "", finish=None) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (start, end in words, merged) and ``items`` (ids as sorted strings).

    The new names get ``prefix``; columns so named in ``docs`` are replaced. A null text has no words; items that
    have a null or empty text or no words are in no document; items with a null id hit words, but cannot be named in
    ``items``, which counts no such item either; rows that repeat each get their
    result. Further blocks of items read the result of the block before. ``finish`` may
    turn each batch of the last block into one of the schema of ``docs``, in the same pass.
    """
    sc = docs.sparkSession.sparkContext
    new = [prefix + c for c in ("n_words", "spans", "items")]
    plain = docs.drop(*new)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*plain.schema.fields, T.StructField(new[0], T.LongType()), T.StructField(new[1], span), T.StructField(new[2], T.ArrayType(T.StringType()))])
    at, n = plain.columns.index(text_col), len(plain.columns)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(block, key: str, last=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = _automaton(key, block, window)
            for whole in batches:
                for first in range(0, whole.num_rows, 1000):
                    b = whole.slice(first, 1000)
                    before = zip(b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()) if b.num_columns > n else None
                    n_words, spans, items = [], [], []
                    for t in b.column(at):
                        ws = tokens(t.as_buffer().to_pybytes()) if t.is_valid else []
                        found, names = auto.scan(ws)
                        names = {k for k, _ in names if k is not None}
                        if before is not None:
                            old, old_names = next(before)
                            found, names = merge(found + [(x["start"], x["end"]) for x in old]), names | {*old_names}
                        n_words.append(len(ws))
                        spans.append([{"start": x, "end": y} for x, y in found])
                        items.append(sorted(names))
                    columns = [*b.columns[:n], pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.string()))]
                    batch = pa.record_batch(columns, names=schema.names)
                    yield batch if last is None else last(batch)
            trim()

        return run

    out, before = plain, None
    for block in item_blocks(benchmark, item_id, item_text, block_words):
        if before is not None:
            out = saved(out.mapInArrow(scan(*before), schema))
        before = sc.broadcast(block), uuid.uuid4().hex
    return out.mapInArrow(scan(*before, finish), plain.schema if finish else schema)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_ends(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the words."""
    out, at, plain = [], 0, text.translate(NORMAL)
    for w in plain.split():
        at = plain.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_coverage: float = 0.5, **options) -> DataFrame:
    """``docs`` without benchmark passages: matched spans are cut out of the text, and a document
    of whose words more than ``max_coverage`` are matched is dropped. Others stay as they are."""
    at, n = docs.columns.index(text_col), len(docs.columns)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        for text, words, spans in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
            keep.append(sum(s["end"] - s["start"] for s in spans) <= max_coverage * words or not spans)
            if spans and keep[-1]:
                data = text.encode()
                place = word_ends(data)
                for s in reversed(spans):
                    data = data[: place[s["start"]][0]] + data[place[s["end"] - 1][1] :]
                text = data.decode("utf-8", "replace")
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:n])]
        return pa.record_batch(columns, names=b.schema.names[:n]).filter(pa.array(keep, pa.bool_()))

    return contaminated_spans(docs, benchmark, id_col, text_col, prefix="_hit_", finish=cut, **options)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated_spans(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
