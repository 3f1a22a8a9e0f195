"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that merging in rank
order produces. It starts as one state with a loop for every base symbol; each merge
(u, v) in turn applies one gadget: where an arc ``u`` leads to a state with an arc ``v``,
a new arc ``uv`` leads to where ``v`` led, and ``u`` leads to a copy of its state without
``v`` (Berglund, Martens and van der Merwe, 2024). All arcs of one label lead to one
state, and a state is a copy of that of its token's right part, less the arcs it lost.

The finished automaton is compiled into arrays. Tokens are numbered so that the arcs lost
in one gadget, and those that would have grown out of them, are one interval; equal states
are merged; a state's row is its sorted intervals of missing arcs. Words are encoded from
left to right, a whole batch at a time: a trie of reversed labels, in arrays too, gives the
tokens that end at each byte, and exactly one of them is an arc of the state that the bytes
before it lead to. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from guardlake.llm.common import table
from guardlake.llm.words import trim

END = "</w>"
#: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces of a chunk without white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")


def byte_labels() -> list[str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class _Gadgets:
    """The automaton while merges are applied, one gadget each, in rank order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        n = max(vocab.values()) + 1
        self.never = len(merges) + 1
        #: By token: left part, right part and the rank at which it was made; base symbols have no parts.
        self.left, self.right, self.made = ([x] * n for x in (-1, -1, -1))
        #: By token: the arcs its state lost, with the rank of the loss.
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        for rank, (u, v) in enumerate(merges):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            if self._arc(a, b):
                self.left[w], self.right[w], self.made[w] = a, b, rank
                self.lost[a][b] = rank

    def _spine(self, t: int, child: list[int]) -> Iterator[tuple[int, int]]:
        """The token and its outermost parts on one side, each with the rank at which it became part of the next."""
        until = self.never
        while t >= 0:
            yield t, until
            until, t = self.made[t], child[t]

    def _arc(self, state: int, t: int) -> bool:
        """Whether the state has the arc: no part at its head was lost, before it grew, by the state or by one it was copied from before the copy."""
        heads = list(self._spine(t, self.left))
        for y, copied in self._spine(state, self.right):
            if lost := self.lost[y]:
                for x, grown in heads:
                    if (r := lost.get(x)) is not None and r < copied and r <= grown:
                        return False
        return True

    def numbered(self) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
        """Numbers of the tokens, each before those it is the left part of, which follow from the latest made to the first; those tokens; the last number below each."""
        n = len(self.left)
        grown: list[list[int]] = [[] for _ in range(n)]
        for t in sorted(range(n), key=lambda t: -self.made[t]):
            if self.left[t] >= 0:
                grown[self.left[t]].append(t)
        number, below, at = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        todo = [(t, False) for t in range(n - 1, -1, -1) if self.left[t] < 0]
        while todo:
            t, done = todo.pop()
            if done:
                below[t] = at - 1
                continue
            number[t], at = at, at + 1
            todo.append((t, True))
            todo += [(x, False) for x in reversed(grown[t])]
        return number, grown, below

    def missing(self) -> tuple[np.ndarray, list[tuple[tuple[int, int], ...]]]:
        """The tokens' numbers, and by token the intervals of arcs that its state lacks."""
        number, grown, below = self.numbered()
        rows: list[list[tuple[int, int, int]]] = [[] for _ in self.left]
        for t in sorted(range(len(rows)), key=lambda t: self.made[t]):
            for x, r in self.lost[t].items():
                later = [y for y in grown[x] if self.made[y] >= r]
                rows[t].append((int(number[x]), int(below[later[-1]] if later else number[x]), r))
            if self.right[t] >= 0:
                rows[t] += [z for z in rows[self.right[t]] if z[2] < self.made[t]]
        return number, [tuple(_united((lo, hi) for lo, hi, _ in row)) for row in rows]


def _united(intervals) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(intervals):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class TokenAutomaton:
    """The compiled automaton: arrays only, a few MB for a vocabulary of 50,000."""

    #: Longer words are walked one by one, as a batch takes steps as its longest word has bytes.
    LONG = 200

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = END) -> None:
        build = _Gadgets(vocab, merges)
        self.number, rows = build.missing()
        merged: dict[tuple, int] = {}
        #: The state that each token leads to, and the missing arcs: state and first number, last number.
        self.state = np.array([merged.setdefault(row, len(merged)) for row in rows], np.int64)
        self.lost_from = np.array([s << 20 | lo for row, s in merged.items() for lo, _ in row], np.int64)
        self.lost_to = np.array([hi for row in merged for _, hi in row], np.int64)
        byte = {c: i for i, c in enumerate(byte_labels())}
        inner, last = {}, {}
        for label, i in vocab.items():
            bare = label.removesuffix(end) if label != end else label
            if build.made[i] >= 0 or len(bare) == 1:
                (last if label.endswith(end) and label != end else inner)[bytes(byte[c] for c in reversed(bare))] = i
        self.size = np.zeros(len(rows), np.int64)
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 2  # the roots: 0 within words, 1 at their ends
        for root, tokens in enumerate((inner, last)):
            for label, i in tokens.items():
                at = root
                for c in label:
                    key = at << 8 | c
                    if key not in edges:
                        edges[key], nodes = nodes, nodes + 1
                    at = edges[key]
                ends[at] = i
                self.size[i] = len(label)
        keys = sorted(edges)
        self.edge, self.edge_to = np.array(keys, np.int64), np.array([edges[k] for k in keys], np.int64)
        self.token = np.full(nodes, -1, np.int64)
        self.token[list(ends)] = list(ends.values())

    def arcs(self, before: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the states that tokens ``before`` lead to have the arcs ``t``."""
        state, number = self.state[before], self.number[t]
        at = np.searchsorted(self.lost_from, state << 20 | number, "right") - 1
        return (at < 0) | (self.lost_from[at] >> 20 != state) | (self.lost_to[at] < number)

    def _ending(self, data: np.ndarray, place: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and token of all tokens that end at a byte, from the shortest; ``place`` is the byte's place in its word."""
        at, node, found = np.arange(len(data)), root, []
        step = 0
        while len(at):
            key = node << 8 | data[at - step]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[edge] == key
            at, node = at[ok], self.edge_to[edge[ok]]
            t = self.token[node]
            hit = t >= 0
            found.append((at[hit], t[hit]))
            step += 1
            more = place[at] >= step
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's tokens as little-endian 32-bit ids."""
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(data)) - start[word]
        at, t = self._ending(data, place, (place == size[word] - 1).astype(np.int64))
        order = np.argsort(np.where(size[word[at]] > self.LONG, 1 << 40, place[at]), kind="stable")
        at, t = at[order], t[order]
        last = np.full(len(data), -1, np.int64)  # by byte: the last token of the bytes up to it
        cut = np.searchsorted(place[at[: int((size[word[at]] <= self.LONG).sum())]], np.arange(self.LONG + 1))
        for lo, hi in zip(cut, cut[1:]):
            if lo == hi:
                continue
            a, x = at[lo:hi], t[lo:hi]
            first = place[a] + 1 == self.size[x]
            before = np.where(first, 0, last[a - self.size[x]])
            ok = first | (before >= 0) & self.arcs(before, x)
            last[a[ok]] = x[ok]
        if cut[-1] < len(at):
            self._walk(last, place, at[cut[-1] :], t[cut[-1] :])
        return self._read(last, start, size)

    def _walk(self, last: np.ndarray, place: np.ndarray, at: np.ndarray, t: np.ndarray) -> None:
        """Byte by byte through long words."""
        order = np.lexsort((self.size[t], at))
        known: dict[tuple[int, int], bool] = {}
        now = {}
        for a, x, n, p in zip(at[order].tolist(), t[order].tolist(), self.size[t[order]].tolist(), place[at[order]].tolist()):
            if p == 0:
                now = {}
            before = None if p + 1 == n else now.get(p - n)
            if p in now or (before is None and p + 1 != n):
                continue
            if before is not None:
                if (before, x) not in known:
                    known[before, x] = bool(self.arcs(np.array([before]), np.array([x]))[0])
                if not known[before, x]:
                    continue
            now[p] = last[a] = x

    def _read(self, last: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The tokens back from the ends of the words."""
        at, word, found = start + size - 1, np.arange(len(size)), []
        at, word = at[size > 0], word[size > 0]
        while len(at):
            t = last[at]
            found.append((word, t))
            at = at - self.size[t]
            more = at >= start[word]
            at, word = at[more], word[more]
        if not found:
            return [b""] * len(size)
        word, t = (np.concatenate(x[::-1]) for x in zip(*found))
        order = np.argsort(word, kind="stable")
        ids = t[order].astype("<u4").tobytes()
        ends = 4 * np.append(0, np.cumsum(np.bincount(word, minlength=len(size))))
        return [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


class Tokenizer:
    """Encodes texts to ids as little-endian 32-bit integers, and decodes them."""

    #: Chunks and words known to a worker before it starts afresh, between batches.
    KNOWN = 250_000

    def __init__(self, model: dict) -> None:
        self.auto, self.labels, self.special = model["auto"], model["labels"], model["special"]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._chunks: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Encode chunks without white space."""
        pieces = {c: PIECES.findall(unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()) for c in chunks}
        new = list({x for p in pieces.values() for x in p if x not in self._words})
        words = [x.encode() for x in new]
        at = 0
        while at < len(new):  # a few MB at once
            to, size = at, 0
            while to < len(new) and (to == at or size + len(words[to]) < 1 << 18):
                size += len(words[to])
                to += 1
            self._words.update(zip(new[at:to], self.auto.encode(words[at:to])))
            at = to
        for c, p in pieces.items():
            self._chunks[c] = b"".join([self._words[x] for x in p])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._chunks) > self.KNOWN or len(self._words) > self.KNOWN:
            self._chunks.clear()
            self._words.clear()
        parts: list[list] = []
        for text in texts:
            own = []
            for part in self.split.split(text) if self.split is not None and "<|" in text else (text,):
                if part in self.special:
                    own.append(np.array([self.special[part]], "<u4").tobytes())
                else:
                    own.append(part.split() if not re.search("[\x1c-\x1f]", part) else [c for c in re.split(f"[{SPACE}]+", part) if c])
            parts.append(own)
        new = set()
        for own in parts:
            for part in own:
                if type(part) is list:
                    new.update(part)
        self._learn(new.difference(self._chunks))
        known = self._chunks.__getitem__
        return [b"".join([part if type(part) is bytes else b"".join(map(known, part)) for part in own]) for own in parts]

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()])


def read_model(path: str) -> dict:
    """The compiled automaton, labels and special tokens of a tokenizers file of this kind (a few MB at most)."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    m = j["model"]
    if m["type"] != "BPE" or m["end_of_word_suffix"] != END or m.get("continuing_subword_prefix") or m.get("dropout"):
        raise ValueError("not a BPE file with word ends")
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
    special = {x["content"]: x["id"] for x in j["added_tokens"]}
    labels = [""] * (max([*m["vocab"].values(), *special.values()]) + 1)
    for label, i in (m["vocab"] | special).items():
        labels[i] = label
    return {"auto": TokenAutomaton(m["vocab"], merges), "labels": labels, "special": special}


_ready: dict[str, Tokenizer] = {}


def mapped(docs: DataFrame, path: str, row, fields: list[T.StructField], text_col: str, drop: tuple[str, ...] = ()) -> DataFrame:
    model, key = docs.sparkSession.sparkContext.broadcast(read_model(path)), uuid.uuid4().hex
    names = [f.name for f in fields]
    src = docs.drop(*[c for c in names if c in docs.columns])
    at = src.columns.index(text_col)
    keep = [i for i, c in enumerate(src.columns) if c not in drop]
    schema = T.StructType([src.schema.fields[i] for i in keep] + fields)
    types = [{T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}[f.dataType] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ready:
            _ready.clear()
            _ready[key] = Tokenizer(model.value)
        tok = _ready[key]
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                new = [row(tok, ids) for ids in tok.encode([t or "" for t in b.column(at).to_pylist()])]
                yield pa.record_batch([*(b.column(i) for i in keep), *(pa.array([r[i] for r in new], t) for i, t in enumerate(types))], names=schema.names)
        trim()

    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens``.

    Null and empty texts have no tokens. Columns of those names in ``docs`` are replaced;
    rows that repeat each get their result.
    """

    def row(tok: Tokenizer, ids: bytes) -> tuple:
        return ids, len(ids) // 4

    return mapped(docs, path, row, [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], text_col)


def digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Each row's other columns with the number of tokens and SHA-256 of ids and decoded text."""

    def row(tok: Tokenizer, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tok.decode(ids).encode()).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return mapped(docs, path, row, fields, text_col, (text_col,))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
