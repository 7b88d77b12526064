"""Exact repeats of word windows across documents, by fixed-block anchors.

A window of w words holds a whole block of b = (w + 1) // 2 words that starts at a multiple
of b. So the index takes only the non-overlapping blocks of each document, and every
rolling b-word window of every document probes it. A block that two documents have is an
anchor; each hit is extended over the words around it to the w-word windows that hold it.

Texts are dealt once to homes, and the work goes to and fro between homes and buckets of
hashes. A home speaks for all its documents: it sends a hash once, however many of them have
it, so a passage that every document has costs a bucket one entry a home.

1. Homes deal their block hashes (32 bits and the bucket) to buckets, marked where a block
   stands in the index.
2. Buckets tell homes the anchors: indexed somewhere, and in two documents.
3. Homes extend the hits to windows and deal those by 64-bit hashes, each with its smallest
   document.
4. Buckets line up the homes of a window by that document and ask each home to send the
   window to the next one: a chain, so that no home serves all others.
5. Homes send runs of consecutive windows as text, the maximal repeats.
6. Homes compare the words, of what they were sent and of windows that their own documents
   share, and cut those that are the same. A hash never decides alone: words differ, words
   stay.

Homes and buckets grow in number with the bytes of the texts, without an upper limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbuf import _mix as mix
from .textbuf import buffers, release, run_hash, runs, slices

WINDOW = 13
#: Bytes of text in a home: at least, and at most; between them as the root of all bytes.
LEAST_HOME, MOST_HOME, ROOT_FROM = 8 << 20, 64 << 20, 32 << 30
MESSAGE = "{} long, sender long, blob binary"


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (wrapping over text ends; the caller masks those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0xD1342543DE82EF95)
        h += words[j : j + n]
    return mix(h)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class Home:
    """The words of a group of texts: their spans in one buffer, and their hashes."""

    def __init__(self, table: pa.Table, window: int):
        ids, text = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
        self.data, self.at = buffers(text)
        parts, base = [], 0
        for lo, _, data, at in slices(text):
            starts, ends, first = runs(data, at)
            h = run_hash(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
            parts.append((starts + self.at[lo], ends + self.at[lo], h, first[:-1] + base))
            base += len(starts)
        whole = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, kind)
        self.starts, self.ends, self.words = whole(0, np.int64), whole(1, np.int64), whole(2, np.uint64)
        self.first = np.append(whole(3, np.int64), base)
        self.ids, self.known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        self.usable = self.known & (np.diff(self.first) >= window)
        self.row = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def windows(self, k: int) -> np.ndarray:
        """Starts of k-word windows within one text that has an id and enough words."""
        if not len(self.row):
            return np.empty(0, np.int64)
        place = np.arange(len(self.row))
        return place[self.usable[self.row] & (place + k <= self.first[self.row + 1])]

    def least(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each hash once, the smallest document that has it, its first place there) of windows at the given places."""
        doc = self.ids[self.row[at]]
        order = np.lexsort((at, doc, h))
        order = order[_edges(h[order])]
        return h[order], doc[order], at[order]

    def text(self, a: int, b: int) -> list[bytes]:
        """Words a to b (exclusive)."""
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes().split()


def _messages(name: str, sender: int, key: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for each key: who sends, and the key's part of each column, one after the other."""
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")  # few keys: a radix sort
    key, columns = key[order], [c[order] for c in columns]
    at = _edges(key)
    blobs = [b"".join([np.uint32(b - a).tobytes(), *(np.packbits(c[a:b]).tobytes() if c.dtype == bool else c[a:b].tobytes() for c in columns)]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(key)][: len(at)], strict=True)]
    return pa.table({name: pa.array(key[at], pa.int64()), "sender": pa.array(np.full(len(at), sender), pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _received(table: pa.Table, *kinds: str) -> list[np.ndarray]:
    """The sender of every entry, and the columns of all messages."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    senders, counts = table.column("sender").to_numpy(), []
    for blob in table.column("blob").to_pylist():
        n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
        counts.append(n)
        for part, kind in zip(parts, kinds, strict=True):
            if kind == "bool":
                size = (n + 7) // 8
                part.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n).astype(bool))
            else:
                size = n * np.dtype(kind).itemsize
                part.append(np.frombuffer(blob, kind, n, at))
            at += size
    return [np.repeat(senders, counts).astype(np.int64), *(np.concatenate(p) if p else np.empty(0, k) for p, k in zip(parts, kinds, strict=True))]


def _key(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _anchor_key(h: np.ndarray, bits: int) -> np.ndarray:
    """The bucket and 32 bits of a block hash."""
    return (_bucket(h, bits).astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _probes(window: int, bits: int) -> Callable:
    block = (window + 1) // 2

    def group(table: pa.Table) -> pa.Table:
        release()
        home = Home(table, window)
        at = home.windows(block)
        row = home.row[at]
        key = _anchor_key(rolling(home.words, block)[at], bits)
        aligned = (at - home.first[row]) % block == 0
        order = np.argsort(key)
        key, row = key[order], row[order]
        edge = _edges(key)
        of = lambda f, x: f.reduceat(x, edge) if len(edge) else np.empty(0, x.dtype)
        several, indexed = of(np.minimum, row) != of(np.maximum, row), of(np.logical_or, aligned[order])
        key = key[edge]
        return _messages("bucket", _key(table, "home"), (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype("<u4"), several, indexed)

    return group


def _anchors(table: pa.Table) -> pa.Table:
    release()
    home, value, several, indexed = _received(table, "<u4", "bool", "bool")
    order = np.argsort(value, kind="stable")
    edge = _edges(value[order])
    count = np.diff(np.append(edge, len(value)))
    if len(edge):
        good = (np.logical_or.reduceat(several[order], edge) | (count > 1)) & np.logical_or.reduceat(indexed[order], edge)
        order = order[np.repeat(good, count)]
    return _messages("home", _key(table, "bucket"), home[order], value[order])


def _extended(window: int, bits: int) -> Callable:
    block = (window + 1) // 2

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        bucket, value = _received(right, "<u4")
        if not left.num_rows or not len(value):
            return _messages("bucket", 0, np.empty(0, np.int64))
        anchors, home = np.sort((bucket.astype(np.uint64) << np.uint64(32)) | value), Home(left, window)
        at = home.windows(block)
        hit = np.zeros(len(home.words) + 1, np.int64)
        key = _anchor_key(rolling(home.words, block)[at], bits)
        place = np.minimum(np.searchsorted(anchors, key), len(anchors) - 1)
        hit[at[anchors[place] == key] + 1] = 1
        seen, at = np.cumsum(hit), home.windows(window)
        at = at[seen[at + window - block + 1] > seen[at]]  # windows that hold an anchor
        h, doc, _ = home.least(at, rolling(home.words, window)[at])
        order = np.argsort(doc, kind="stable")
        return _messages("bucket", _key(left, "home"), _bucket(h[order], bits), doc[order].astype("<i8"), h[order])

    return group


def _chained(table: pa.Table) -> pa.Table:
    """Orders to homes: send these windows to that home."""
    release()
    home, doc, h = _received(table, "<i8", "<u8")
    order = np.lexsort((home, doc, h))
    home, doc, h = home[order], doc[order], h[order]
    tie = _edges(h, doc)
    before = np.repeat(tie, np.diff(np.append(tie, len(h)))) - 1  # the last entry with a smaller document, if the hash is the same
    to = np.flatnonzero((before >= 0) & (h[before] == h)) if len(h) else np.empty(0, np.int64)
    return _messages("home", _key(table, "bucket"), home[before[to]], home[to].astype("<i8"), h[to])


def _sent(window: int) -> Callable:
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        _, to, h = _received(right, "<i8", "<u8")
        if not left.num_rows or not len(h):
            return _messages("home", 0, np.empty(0, np.int64))
        home = Home(left, window)
        at = home.windows(window)
        own, asked = rolling(home.words, window)[at], np.unique(h)
        place = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
        there = asked[place] == own
        own, _, at = home.least(at[there], own[there])
        at = at[np.searchsorted(own, h)]
        order = np.lexsort((at, to))
        to, at = to[order], at[order]
        begin = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (at[1:] != at[:-1] + 1)]))
        end = at[np.append(begin[1:], len(at)) - 1] + window
        lines: dict[int, list[bytes]] = {}
        for t, a, b in zip(to[begin].tolist(), at[begin].tolist(), end.tolist(), strict=True):
            lines.setdefault(t, []).append(b" ".join(home.text(a, b)))
        return pa.table({"home": pa.array(list(lines), pa.int64()), "sender": pa.array([_key(left, "home")] * len(lines), pa.int64()), "blob": pa.array([b"\n".join(x) for x in lines.values()], pa.binary())})

    return group


def _same(home: Home, p: np.ndarray, other: Home, q: np.ndarray, window: int) -> np.ndarray:
    """Places p whose window has the very words of other's window at q; runs along a diagonal are compared at once."""
    begin = _edges(q - p, p - np.arange(len(p)))
    good = np.ones(len(p), bool)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(p)][: len(begin)], strict=True):
        n = b - a + window - 1
        if home.text(p[a], p[a] + n) != other.text(q[a], q[a] + n):
            good[a:b] = [home.text(p[i], p[i] + window) == other.text(q[i], q[i] + window) for i in range(a, b)]
    return p[good]


def _repeated(home: Home, received: list[bytes], window: int) -> np.ndarray:
    """Places of windows whose words a smaller document has, here or elsewhere."""
    at = home.windows(window)
    h = rolling(home.words, window)[at]
    by_hash = np.sort(h)  # values alone sort several times as fast as places
    several = np.unique(by_hash[1:][by_hash[1:] == by_hash[:-1]])
    twice = several[np.minimum(np.searchsorted(several, h), len(several) - 1)] == h if len(several) else np.zeros(len(h), bool)
    p, g = at[twice], h[twice]
    least, doc, first = home.least(p, g)
    of = np.searchsorted(least, g)
    later = home.ids[home.row[p]] > doc[of]
    found = [_same(home, p[later], home, first[of[later]], window)]
    lines = [x for blob in received for x in blob.split(b"\n")]
    if lines:
        sent = Home(pa.table({"doc_id": pa.array(np.zeros(len(lines), np.int64)), "text": pa.array(lines, pa.large_binary())}), window)
        q = sent.windows(window)
        least, _, first = sent.least(q, rolling(sent.words, window)[q])
        of = np.minimum(np.searchsorted(least, h), len(least) - 1)
        there = least[of] == h
        found.append(_same(home, at[there], sent, first[of[there]], window))
    return np.concatenate(found)


def _cut(window: int, keep_text: bool) -> Callable:
    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        home = Home(left, window)
        p = _repeated(home, right.column("blob").to_pylist(), window)
        size, raw = len(home.words) + 1, home.data.tobytes()
        gone = np.cumsum(np.bincount(p, minlength=size) - np.bincount(p + window, minlength=size))[:-1] > 0
        n, removed, kept = np.diff(home.first), np.diff(np.concatenate([[0], np.cumsum(gone)])[home.first]), []
        for i, (a, b) in enumerate(zip(home.first[:-1].tolist(), home.first[1:].tolist(), strict=True)):
            if removed[i]:
                rest = a + np.flatnonzero(~gone[a:b])
                words = [raw[s:e] for s, e in zip(home.starts[rest].tolist(), home.ends[rest].tolist(), strict=True)]
            else:
                words = raw[home.at[i] : home.at[i + 1]].split()
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        out = {"doc_id": left.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())}
        out |= {"t": left.column("text")} if keep_text else {}
        return pa.table(out | ({"row": left.column("row")} if "row" in left.column_names else {}))

    return group


def home_count(docs: DataFrame) -> int:
    """A power of two that grows with the bytes of the texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = min(MOST_HOME, max(LEAST_HOME, LEAST_HOME * math.sqrt(size / ROOT_FROM)))
    return max(16, 1 << math.ceil(math.log2(max(1, size / each))))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one space) of every row.

    A word goes if a window of its document covers it whose words also start in a document
    with a smaller doc_id; windows are judged on the input. Null texts have no words; rows
    with one id are no smaller than each other, so they take nothing from one another, and
    each gets a row; rows without an id neither lose words nor make others lose them. An
    empty table gives an empty result. keep_text adds the source text as t, null where it is
    null. Columns named in carry come back in a struct, row; others are left out.
    """
    row_of = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row_of)
    n = home_count(docs)
    bits = int(math.log2(n))
    # by id and text, so that neither one id nor missing ids with very many rows make a large home
    homes = docs.withColumn("home", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n).cast("long"))).groupBy("home")
    to_bucket, to_home = MESSAGE.format("bucket"), MESSAGE.format("home")
    anchors = homes.applyInArrow(_probes(window, bits), to_bucket).groupBy("bucket").applyInArrow(_anchors, to_home)
    windows = homes.cogroup(anchors.groupBy("home")).applyInArrow(_extended(window, bits), to_bucket)
    orders = windows.groupBy("bucket").applyInArrow(_chained, to_home)
    repeats = homes.cogroup(orders.groupBy("home")).applyInArrow(_sent(window), to_home)
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
    if keep_text:
        schema = schema.add("t", "string")
    if carry:
        schema = schema.add("row", docs.schema["row"].dataType)
    return homes.cogroup(repeats.groupBy("home")).applyInArrow(_cut(window, keep_text), schema)
