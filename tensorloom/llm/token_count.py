"""Token counts of whole texts, with chunks of huge texts joined at proven boundaries.

A text longer than chunk_chars is encoded in overlapping chunks. Both encodings of an
overlap carry token offsets; they are spliced at a position where both start a token and
where the pre-tokeniser must start a piece whatever stands around it: a white-space
character after a character that is neither white space. Scanning starts afresh there, so
what follows does not depend on what came before. Without such a position the overlap is
doubled, up to the whole rest of the text, so the result always equals one encoding of the
whole text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: The pre-tokeniser pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode's White_Space property lists it (fixed value).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STABLE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Encodes with the vocabulary of a byte-level BPE .json file."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, back = spec["model"], byte_alphabet()
        ranks = {bytes(back[c] for c in piece): i for piece, i in model["vocab"].items()}
        pre = spec["pre_tokenizer"]
        merged = [bytes(back[c] for c in "".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        order = [ranks[m] for m in merged]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or order != sorted(order):
            raise ValueError(f"{path}: not a byte-level BPE whose ids follow its merges")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.width[i] = len(piece)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offset of each token in the text)."""
        ids = np.array(self.core.encode_ordinary(text), np.int64)
        width = self.width[ids]
        return ids, np.cumsum(width) - width

    def count(self, text: str, chunk_chars: int, overlap_chars: int) -> int:
        if not text:
            return 0
        if self.split is None or not self.split.search(text):
            return self._plain(text, chunk_chars, overlap_chars)
        parts = self.split.split(text)
        return len(parts) - 1 + sum(self._plain(p, chunk_chars, overlap_chars) for p in parts if p)

    def _plain(self, text: str, chunk_chars: int, overlap_chars: int) -> int:
        if len(text) <= chunk_chars:
            return len(self.core.encode_ordinary(text))
        return self._spliced(text, chunk_chars, overlap_chars)

    def _spliced(self, text: str, chunk_chars: int, overlap_chars: int) -> int:
        total, at = 0, 0  # at: start of the present chunk, a proven boundary
        while len(text) - at > chunk_chars:
            end, overlap = at + chunk_chars, overlap_chars
            while True:
                begin = max(at, end - overlap)
                cut = self._common(text, at, begin, end) if begin > at else None
                if cut or end >= len(text):
                    break
                if begin <= at:  # the whole chunk overlaps and still disagrees: take a longer one
                    end = min(len(text), at + 2 * (end - at))
                    overlap = overlap_chars
                else:
                    overlap *= 2
            if not cut:
                break
            total, at = total + cut[0], cut[1]
        return total + len(self.core.encode_ordinary(text[at:]))

    def _common(self, text: str, at: int, begin: int, end: int) -> tuple[int, int] | None:
        """(tokens before the splice, its position), the last one that both encodings prove."""
        _, left = self.encode(text[at:end])
        stable = [m.start() for m in _STABLE.finditer(text, begin, end)]
        if not stable:
            return None
        _, right = self.encode(text[begin : min(len(text), end + (end - begin))])
        head, base = len(text[at:begin].encode()), None
        mine = {int(x) - head: i for i, x in enumerate(left) if x >= head}
        theirs = set(right.tolist())
        base = np.cumsum([0, *(len(text[a:b].encode()) for a, b in zip([begin, *stable], stable, strict=False))])[1:]
        for p, b in zip(reversed(stable), reversed(base.tolist()), strict=True):
            if p > at and b in mine and b in theirs:
                return mine[b], p
        return None


@functools.lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Null text counts as empty: no bytes, no tokens. Rows with one id are counted each by
    itself, other columns are left out, an empty table gives an empty result. Nothing is
    truncated; memory is bounded by one batch and, for a text without white space, by it.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in it:
            texts = batch.column(1).to_pylist()
            n = [own.count(t or "", chunk_chars, overlap_chars) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, SCHEMA)
