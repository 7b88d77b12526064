"""SentencePiece encoding and decoding that keeps byte spans of the source.

Normalisation walks the compiled character map of the model (a double-array trie with
replacement strings): at each place the longest prefix that the map knows is replaced, any
other character stays. Every normalised byte remembers the source byte range it came from,
so each piece can be projected to a span of the original text. Texts in which no byte can
start a rule skip the walk; their alignment is the identity.

Segmentation is BPE over the normalised text. Merges cannot cross a place where no piece of
the vocabulary has the two neighbouring characters inside it, so the text is cut before
each run of spaces and around isolated line ends (both proven from the vocabulary when the
model is loaded) and the encodings of the cut segments are kept in a table. A literal
escape sign (U+2581) counts as a space there: pieces of several reach from it to the spaces
behind it.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import Interner, ragged, slices

SPACE = "▁"
_SIGN = SPACE.encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharsMap:
    """The compiled character map: uint32 size of the trie, its units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        self.starts = np.zeros(256, bool)
        for b in range(256):
            self.starts[b] = bool(self.units) and self._step(self._offset(self.units[0]), b) is not None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, node: int, byte: int) -> tuple[int, int] | None:
        """(child, its unit) of a node by one byte."""
        child = node ^ byte
        unit = self.units[child] if child < len(self.units) else 0x80000000
        return (child, unit) if unit & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest rule that matches at a place."""
        if not self.units:
            return None
        node, best = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            step = self._step(node, text[i])
            if step is None:
                break
            node = step[0] ^ self._offset(step[1])
            if (step[1] >> 8) & 1:
                value = self.units[node] & 0x7FFFFFFF
                best = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return best

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised bytes, source begin of each, source end of each)."""
        out, begin, end, i = bytearray(), [], [], 0
        while i < len(text):
            rule = self.longest(text, i)
            if rule is None:
                n = 1
                while i + n < len(text) and text[i + n] & 0xC0 == 0x80:
                    n += 1
                rule = (n, text[i : i + n])
                spans = [(i + k, i + k + 1) for k in range(n)]
            else:
                spans = [(i, i + rule[0])] * len(rule[1])
            out += rule[1]
            begin += [s for s, _ in spans]
            end += [e for _, e in spans]
            i += rule[0]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)


@dataclass
class Encoded:
    """Ids of one text and the source byte span of each piece."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


class PieceCodec:
    """Encoder and decoder of one .model file (BPE with byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        if model.trainer_spec.model_type != 2 or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only BPE models with spaces before words are read")
        spec = model.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.kinds = [p.type for p in model.pieces]
        pieces = self.pieces = [p.piece for p in model.pieces]
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.unknown_surface = model.trainer_spec.unk_surface.encode()
        if not self.escape or USER_DEFINED in self.kinds or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only models with byte fallback, escaped spaces and no user-defined pieces are read")
        joined = [p for p, k in zip(pieces, self.kinds, strict=True) if k in (NORMAL, UNUSED) and len(p) > 1]
        #: Segments may start at a run of spaces if no piece has a space after another character.
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in joined)
        self.cut_lines = not any("\n" in p for p in joined)
        # the pieces alone, without a normaliser: what it is given is normalised already
        model.normalizer_spec.precompiled_charsmap = b""
        model.normalizer_spec.add_dummy_prefix = False
        model.normalizer_spec.remove_extra_whitespaces = False
        self.core = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.raw = [self._surface(p, k) for p, k in zip(pieces, self.kinds, strict=True)]
        self.width = np.array([len(x) if x is not None else -1 for x in self.raw], np.int64)
        self.joined = np.frombuffer(b"".join(x or b"" for x in self.raw), np.uint8)
        self.at = np.cumsum(np.maximum(self.width, 0)) - np.maximum(self.width, 0)
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.table = Interner(self._segments)

    def _surface(self, piece: str, kind: int) -> bytes | None:
        """Bytes that a piece stands for, a space for each escaped one; None: it depends on the text."""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return None
        return piece.replace(SPACE, " ").encode()

    def _segments(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and source widths of segments in one array: id, width, id, width and so on."""
        ids = self.core.encode([p.decode("utf-8", "replace") for p in parts], num_threads=1)
        out, counts = [], np.empty(len(parts), np.int64)
        for i, (part, own) in enumerate(zip(parts, ids, strict=True)):
            out.append(self._widths(part, np.array(own, np.int64)))
            counts[i] = 2 * len(own)
        return (np.concatenate(out) if out else np.empty(0, np.int64)).astype(np.int32), counts

    def _widths(self, part: bytes, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        if int(width.sum()) != len(part):  # a literal escape sign stands in the text: it takes its own bytes
            text, at = part.decode("utf-8", "replace"), 0
            for k, i in enumerate(ids.tolist()):
                if self.kinds[i] != BYTE:
                    n = len(self.pieces[i])
                    width[k], at = len(text[at : at + n].encode()), at + n
                elif self.raw[i][0] & 0xC0 != 0x80:
                    at += 1
        return np.column_stack([ids, width]).ravel()

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
        """(normalised text with plain spaces, source begins, source ends); None: one byte each, in order."""
        if not text:
            return b"", None, None
        plain = not self.map.units or not self.map.starts[np.frombuffer(text, np.uint8)].any()
        out, begin, end = (text, None, None) if plain else self.map.normalize(text)
        if self.squeeze:
            if begin is None:
                begin = np.arange(len(out))
                end = begin + 1
            own = np.frombuffer(out, np.uint8) == 0x20
            keep = ~own | np.concatenate([[False], ~own[:-1]])
            last = np.flatnonzero(~own)
            keep[(last[-1] + 1 if len(last) else 0) :] = False
            out, begin, end = np.frombuffer(out, np.uint8)[keep].tobytes(), begin[keep], end[keep]
        if self.dummy and out:
            out = b" " + out
            if begin is not None:
                begin, end = np.concatenate([[begin[0]], begin]), np.concatenate([[begin[0]], end])
        return out, begin, end

    def encode_all(self, texts: list[bytes]) -> list[Encoded]:
        """Each text with ids and byte spans of its pieces in the source."""
        done = [self.normalize(t) for t in texts]
        at = np.cumsum([0, *(len(d[0]) for d in done)])
        data = np.frombuffer(b"".join(d[0] for d in done), np.uint8)
        starts, ends, first = self._cut(data, at)
        flat, start, count = self.table.lookup(data, starts, ends) if len(starts) else (np.empty(0, np.int32), starts, starts)
        both = ragged(flat, start, count).reshape(-1, 2)
        pieces = np.concatenate([[0], np.cumsum(count // 2)])[first]
        out = []
        for i, (text, (norm, begin, end)) in enumerate(zip(texts, done, strict=True)):
            ids, width = both[pieces[i] : pieces[i + 1]].T
            e = np.cumsum(width, dtype=np.int64)
            b = e - width
            if begin is None:  # moved by the dummy prefix alone
                lead = len(norm) - len(text)
                b, e = np.maximum(b - lead, 0), np.maximum(e - lead, 0)
            elif len(ids):
                b, e = begin[np.minimum(b, len(begin) - 1)], end[np.maximum(e - 1, 0)]
            out.append(Encoded(ids, b, e))
        return out

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        if len(data) and self.cut_spaces:
            space = data == 0x20
            cut[1:-1] |= space[1:] & ~(space | _signs(data))[:-1]
        if len(data) and self.cut_lines:
            line = data == 0x0A
            cut[1:-1] |= line[1:] | line[:-1]
        places = np.flatnonzero(cut)
        starts = places[:-1] if len(data) else np.empty(0, np.int64)
        return starts, places[1:] if len(data) else starts, np.searchsorted(starts, at)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a sequence of ids, in UTF-8; broken byte sequences become U+FFFD as in the library."""
        if not len(ids):
            return b""
        if (self.width[ids] < 0).any():
            parts = [self.unknown_surface if self.raw[i] is None else self.raw[i] for i in ids.tolist()]
            out = b"".join(parts)
        else:
            out = ragged(self.joined, self.at[ids], self.width[ids]).tobytes()
        if self.is_byte[ids].any():
            out = self._checked(ids, out)
        first = self.raw[int(ids[0])]
        if self.dummy and first is not None and first[:1] == b" ":
            out = out[1:]
        return out

    def _checked(self, ids: np.ndarray, out: bytes) -> bytes:
        """Runs of byte pieces are decoded each by itself; every byte that fits nowhere becomes U+FFFD."""
        try:
            out.decode("utf-8")
        except UnicodeDecodeError:
            pass
        else:
            run = self.is_byte[ids]
            if not (run[:-1] != run[1:]).any() or self._runs_whole(ids):
                return out
        parts, run = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                run += self.raw[i]
                continue
            while run:
                n = next((n for n in range(1, 5) if _valid(run[:n])), 0)
                parts.append(bytes(run[:n]) if n else "�".encode())
                del run[: n or 1]
            if i >= 0:
                parts.append(self.unknown_surface if self.raw[i] is None else self.raw[i])
        return b"".join(parts)

    def _runs_whole(self, ids: np.ndarray) -> bool:
        """No run of byte pieces begins or ends inside a character."""
        run = self.is_byte[ids]
        begin = run & ~np.concatenate([[False], run[:-1]])
        first = self.joined[self.at[ids[begin]]]
        return not ((first & 0xC0) == 0x80).any()


def _signs(data: np.ndarray) -> np.ndarray:
    """Where the last byte of a literal escape sign stands."""
    out = data == _SIGN[2]
    out[:2] = False
    out[2:] &= (data[1:-1] == _SIGN[1]) & (data[:-2] == _SIGN[0])
    return out


def _valid(x: bytearray) -> bool:
    try:
        return len(x.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


@functools.lru_cache(4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    for lo, hi, data, at in slices(batch.column(1)):
        raw = data.tobytes()
        yield lo, hi, [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, begins array<int>, ends array<int>: pieces and their byte spans in the text.

    Null and empty texts have empty arrays; rows with one id are encoded each by itself;
    other columns are left out; an empty table gives an empty result.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in it:
            for lo, hi, texts in _texts(batch):
                done = own.encode_all(texts)
                cols = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(d.ids) for d in done)]), pa.int32()), pa.array(np.concatenate([getattr(d, k) for d in done]), pa.int32())) for k in ("ids", "begins", "ends")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], ["doc_id", "ids", "begins", "ends"])

    return _input(docs, id_col, text_col).mapInArrow(batches, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the text of each row's ids (null ids: empty text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in it:
            out = [own.decode(np.array(x or [], np.int64)).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(batches, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, spans_sha256 and decoded_sha256 of every row.

    Encodes and decodes as encode() and decode() do, with the same results for null, empty,
    repeated and very long texts, and returns digests in place of the arrays. spans_sha256
    is over the begin and end of each piece in source bytes, as pairs of little-endian int64.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in it:
            for lo, hi, texts in _texts(batch):
                n, ids, spans, back = [], [], [], []
                for d in own.encode_all(texts):
                    n.append(len(d.ids))
                    ids.append(sha(",".join(map(str, d.ids.tolist())).encode()))
                    spans.append(sha(np.column_stack([d.begins, d.ends]).astype("<i8").tobytes()))
                    back.append(sha(own.decode(d.ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (ids, spans, back))], ["doc_id", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"])

    return _input(docs, id_col, text_col).mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, spans_sha256 string, decoded_sha256 string")


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
