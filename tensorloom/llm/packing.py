"""Hierarchical packing of tokenised documents into sequences of several lengths.

Each document's ids end with an end id. Full windows of the longest tier are cut off first;
the rest of a document is routed to the shortest tier that holds it. Tiers are packed from
the longest down, each into windows of its own length: the tier's largest item opens a
window, and the gap it leaves is filled with the largest items that fit, looked for in its
own tier and then in shorter ones; what still stays open is filled by cutting the smallest
item in two. Only items that cannot fill a last window are left at a partition's end, less
than a window of the longest tier in all; they are laid out in sequences whose lengths are
powers of two, so nothing is padded.

A step group holds sequences of one length and step_tokens tokens. What is left of each
length at a partition's end forms groups of as many tokens over several lengths; only the
last group of a partition holds fewer.

The work is a single pass over the scan partitions: no shuffle, and a lost task recomputes
the same pieces with the same sequence ids, which hold the partition number.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import Interner, ragged, release, runs, slices
from .token_count import byte_alphabet

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_length long, step_group long"
TIERS = (512, 1024, 2048, 4096)
#: Printable ASCII and composed Latin letters that lower to one letter.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


class WordEncoder:
    """Encodes with a BPE .json whose words end where white space stands.

    The normaliser composes (NFC), folds white space to one space and lowers letters one by
    one; the pre-tokeniser drops white space. None of these looks across ASCII white space,
    so a text's ids are those of its space-separated chunks, one after the other.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or split.get("behavior") != "Removed" or not split.get("invert"):
            raise ValueError(f"{path}: not a lower-casing word vocabulary")
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.words: dict[str, list[int]] = {}
        self.table = Interner(self._chunks)

    def _chunks(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Plain chunks here, word by word; anything unusual and special strings by the library."""
        out: list[int] = []
        counts = np.empty(len(parts), np.int64)
        joined = b" ".join(parts)  # a chunk has no space
        marked = any(s in joined for s in self.special)
        known, find, plain, before = self.words, self.pattern.findall, _PLAIN.fullmatch, 0
        for i, text in enumerate(joined.decode("utf-8", "replace").split(" ") if parts else ()):
            if plain(text) and not (marked and any(s in parts[i] for s in self.special)):
                low = text.lower()
                for w in (low,) if low.isalpha() else find(low):  # letters alone are one word
                    ids = known.get(w)
                    out += self._word(w) if ids is None else ids
            else:
                out += self.whole.encode(text, add_special_tokens=False).ids
            counts[i] = len(out) - before
            before = len(out)
        return np.array(out, np.int32), counts

    def _word(self, word: str) -> list[int]:
        """The ids of a word that is not in the table; printable ASCII stands for itself in the byte alphabet."""
        spelled = word if word.isascii() else "".join([self.stand_in[b] for b in word.encode()])
        ids = [t.id for t in self.model.tokenize(spelled)]
        if len(word) <= 32:
            if len(self.words) >= 1 << 18:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        starts, ends, first = runs(data, at)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        flat, start, count = self.table.lookup(data, starts, ends)
        return ragged(flat, start, count), np.concatenate([[0], np.cumsum(count)])[first]


@functools.lru_cache(4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@dataclass
class Item:
    doc: int
    row: int
    start: int
    ids: np.ndarray
    total: int


@dataclass
class Packer:
    """Collects items and closes sequences; holds at most about hold tokens, and a step group of each length."""

    part: int
    tiers: tuple[int, ...] = TIERS
    hold: int = 1 << 20
    step_tokens: int = 1 << 16
    items: list[Item] = field(default_factory=list)
    held: int = 0
    made: int = 0
    groups: int = 0
    waiting: dict[int, list[list[tuple]]] = field(default_factory=dict)  # by length: sequences whose step group is not full
    rows: list[tuple] = field(default_factory=list)

    def add(self, doc: int, row: int, ids: np.ndarray) -> None:
        longest, at = self.tiers[-1], 0
        while len(ids) - at >= longest:
            self._close([Item(doc, row, at, ids[at : at + longest], len(ids))], longest)
            at += longest
        if at < len(ids):
            self.items.append(Item(doc, row, at, ids[at:], len(ids)))
            self.held += len(ids) - at
        if self.held >= self.hold:
            self.pack(False)

    def pack(self, last: bool) -> None:
        """Route the items to tiers and fill windows; what cannot fill one waits, or is laid out at the end."""
        items, self.items, self.held = self.items, [], 0
        pools: list[list[tuple[int, int]]] = [[] for _ in self.tiers]
        for i, it in enumerate(items):
            pools[bisect.bisect_left(self.tiers, len(it.ids))].append((len(it.ids), i))
        for p in pools:
            p.sort()
        for tier in reversed(range(len(self.tiers))):
            window, within = self.tiers[tier], pools[: tier + 1]
            left = sum(n for p in within for n, _ in p)
            while pools[tier] and left >= window:
                chosen, gap = [], window
                while gap:
                    pick = self._largest(within, gap)
                    if pick is None:
                        break
                    chosen.append(items[pick])
                    gap -= len(items[pick].ids)
                if gap:  # the smallest item at hand is cut in two
                    n, i = next(p for p in within if p).pop(0)
                    it = items[i]
                    chosen.append(Item(it.doc, it.row, it.start, it.ids[:gap], it.total))
                    items[i] = Item(it.doc, it.row, it.start + gap, it.ids[gap:], it.total)
                    bisect.insort(pools[bisect.bisect_left(self.tiers, n - gap)], (n - gap, i))
                self._close(chosen, window)
                left -= window
        rest = [items[i] for p in reversed(pools) for _, i in reversed(p)]
        left = sum(len(it.ids) for it in rest)  # less than the longest window
        if not last:
            self.items, self.held = rest, left
            return
        size = self.tiers[-1]
        while rest:  # powers of two, the largest first: full ones, never padded
            while size > left:
                size //= 2
            chosen, gap = [], size
            while gap:
                it = rest.pop(0)
                n = min(gap, len(it.ids))
                chosen.append(Item(it.doc, it.row, it.start, it.ids[:n], it.total))
                if n < len(it.ids):
                    rest.insert(0, Item(it.doc, it.row, it.start + n, it.ids[n:], it.total))
                gap -= n
            self._close(chosen, size)
            left -= size
        group, tokens = [], 0
        for length in sorted(self.waiting, reverse=True):  # powers of two in this order fill groups exactly
            for sequence in self.waiting[length]:
                group.append(sequence)
                tokens += length
                if tokens >= self.step_tokens:
                    self._step(group)
                    group, tokens = [], 0
        if group:
            self._step(group)
        self.waiting = {}

    def _largest(self, pools: list[list[tuple[int, int]]], gap: int) -> int | None:
        for p in reversed(pools):
            k = bisect.bisect_right(p, (gap, 1 << 62))
            if k:
                return p.pop(k - 1)[1]
        return None

    def _close(self, chosen: list[Item], length: int) -> None:
        sequence = (self.part << 32) + self.made
        self.made += 1
        offset, rows = 0, []
        for it in chosen:
            raw = np.ascontiguousarray(it.ids, "<u4").tobytes()
            rows.append((it.doc, it.start, len(it.ids), zlib.crc32(raw), it.total, sequence, offset, length, length))
            offset += len(it.ids)
        same = self.waiting.setdefault(length, [])
        same.append(rows)
        if len(same) * length >= self.step_tokens:
            self._step(self.waiting.pop(length))

    def _step(self, sequences: list[list[tuple]]) -> None:
        group = (self.part << 32) + self.groups
        self.groups += 1
        self.rows.extend((*r, group) for rows in sequences for r in rows)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    doc_id, start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset, then sequence_tokens, sequence_length (the length it is padded to)
    and step_group (equal tokens a group; of one length but at a partition's end).

    Null and empty texts hold the end id alone. Rows with one id are packed each by itself,
    so their pieces appear once for each row. Other columns are left out; an empty table
    gives an empty result. tiers must be powers of two, ascending. A partition packs what
    it reads; documents longer than the last tier are cut into several sequences.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be ascending powers of two")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer, row = word_encoder(path), Packer(TaskContext.get().partitionId(), tiers), 0
        for batch in it:
            ids_of = batch.column(0).to_pylist()
            for lo, hi, data, at in slices(batch.column(1)):
                flat, first = own.encode(data, at)
                first = first.tolist()
                for i in range(hi - lo):
                    packer.add(ids_of[lo + i], row, np.append(flat[first[i] : first[i + 1]], np.int32(end_id)))
                    row += 1
                if packer.rows:
                    yield packer.taken()
        packer.pack(True)
        if packer.rows:
            yield packer.taken()
        del packer
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, SCHEMA)
