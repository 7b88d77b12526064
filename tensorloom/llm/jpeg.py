"""Baseline JPEG: a reader of luminance DC thumbnails, and a lossless store of bytes.

The reader parses the markers, drops stuffed bytes, splits scans at restart markers and
Huffman-decodes all restart intervals of all images of a batch side by side in numpy; AC
coefficients are read over. The DC coefficients of the luminance component, dequantised,
are the thumbnail: one sample for each 8x8 block.

The store keeps one byte in the DC coefficient of each block (quantiser 8, so the block is
flat and decodes to that very sample), 64 blocks a row, a restart interval a row. Payloads
of more than ROWS rows continue in further images behind the first one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import slices

UNIT, ROWS = 64, 8128
#: Symbols by code length, 1 to 16: size categories of DC differences; one AC symbol, end of block.
DC_CODES = ((), (7,), (3, 4, 5), (0, 1, 2, 6), (8,), *[()] * 11)
AC_CODES = ((0,), *[()] * 15)


def canonical(by_length: tuple) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical code given as symbols by length."""
    out, code = {}, 0
    for n, symbols in enumerate(by_length, 1):
        for s in symbols:
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, by_length: tuple) -> bytes:
    return bytes([kind, *map(len, by_length), *(s for row in by_length for s in row)])


def header(rows: int) -> bytes:
    """All that stands before the scan of an image of rows times UNIT blocks."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, bytes([0, 8, *[1] * 63])),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * UNIT, 1, 1, 0x11, 0)),
        _segment(0xC4, _huffman(0x00, DC_CODES)),
        _segment(0xC4, _huffman(0x10, AC_CODES)),
        _segment(0xDD, struct.pack(">H", UNIT)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of a block by its DC difference + 255: category, extra bits, end of block."""
    dc, (eob, n_eob) = canonical(DC_CODES), canonical(AC_CODES)[0]
    codes, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = dc[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        codes[diff + 255], bits[diff + 255] = (((code << size) | extra) << n_eob) | eob, n + size + n_eob
    return codes, bits


_CODES, _BITS = _block_codes()


def encode_rows(samples: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row with the marker behind it: (bytes of all rows, their lengths).

    samples: rows of UNIT bytes. last: whether the image ends with the row. number: of the
    row in its image.
    """
    n = len(samples)
    diff = np.empty(samples.shape, np.int16)
    diff[:, 0] = samples[:, 0].astype(np.int16) + (255 - 128)
    np.subtract(samples[:, 1:], samples[:, :-1], out=diff[:, 1:], dtype=np.int16)
    diff[:, 1:] += 255
    code, bits = _CODES[diff], _BITS[diff]
    end = np.cumsum(bits, axis=1)
    total = end[:, -1]
    pad = -total % 8  # ones up to a whole byte
    code = np.column_stack([code, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)])  # no bits: code 0
    bits = np.column_stack([bits, pad])
    at = np.column_stack([end - bits[:, :-1], total])
    words = (UNIT * 14 + 7) // 32 + 2
    place = (np.arange(n)[:, None] * words + (at >> 5)).ravel()
    wide = (code << (np.uint64(64) - (at & 31).astype(np.uint64) - np.maximum(bits, 1).astype(np.uint64))).ravel()
    out = np.bincount(place, (wide >> np.uint64(32)).astype(float), minlength=n * words)
    out += np.bincount(place + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), minlength=n * words)[: n * words]
    raw = out.astype(np.uint64).astype(">u4").view(np.uint8).reshape(n, 4 * words)
    length = (total + pad) // 8
    flat = raw[np.arange(4 * words) < length[:, None]]
    stuffed = flat == 0xFF
    row = np.repeat(np.arange(n), length)
    extra_bytes = np.bincount(row[stuffed], minlength=n)
    size_out = length + extra_bytes + 2
    ends = np.cumsum(size_out)
    result = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    before = np.cumsum(stuffed) - stuffed
    result[np.arange(len(flat)) + before + 2 * row] = flat
    result[ends - 2] = 0xFF
    result[ends - 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return result, size_out


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as one JPEG, or several one after the other."""
    rows = np.array([len(p) // UNIT for p in payloads], np.int64)
    own = np.repeat(np.arange(len(rows)), rows)
    k = np.arange(len(own)) - np.repeat(np.cumsum(rows) - rows, rows)
    last = (k % ROWS == ROWS - 1) | (k == rows[own] - 1)
    data, size = encode_rows(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT), last, k % ROWS)
    ends, raw, out, row = np.concatenate([[0], np.cumsum(size)]), data.tobytes(), [], 0
    for n in rows.tolist():
        parts = []
        for a in range(0, n, ROWS):
            m = min(ROWS, n - a)
            parts += [header(m), raw[ends[row + a] : ends[row + a + m]]]
        out.append(b"".join(parts))
        row += n
    return out


@dataclass
class Image:
    """What the markers of one image say, and where its scan lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, tuple[int, ...]] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)
    scan: tuple[tuple[int, int, int], ...] = ()  # component, DC table, AC table
    interval: int = 0
    begin: int = 0
    end: int = 0


def parse(raw: bytes, at: int = 0) -> Image:
    """The image that begins at a place; ValueError if it isn't a baseline JPEG."""
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    im, at = Image(), at + 2
    while True:
        while raw[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                im.quantisers[body[0] & 15] = struct.unpack(">64" + "BH"[wide], body[1 : 1 + n])
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                values, k, rows = body[17 : 17 + sum(counts)], 0, []
                for c in counts:
                    rows.append(tuple(values[k : k + c]))
                    k += c
                im.tables[body[0]] = tuple(rows)
                body = body[17 + k :]
        elif marker == 0xC0:
            depth, im.height, im.width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not im.width or not im.height:
                raise ValueError("not an 8-bit image of known size")
            im.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            im.interval = int.from_bytes(body, "big")
        elif marker == 0xD9:
            raise ValueError("no scan")
        elif marker == 0xDA:
            ids = [c[0] for c in im.components]
            im.scan = tuple((ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            im.begin = at
            return im


def _lut(by_length: tuple) -> np.ndarray:
    """For each 16 bits: symbol and code length, as symbol * 32 + length; 0: no code."""
    out = np.zeros(1 << 16, np.int64)
    for s, (code, n) in canonical(by_length).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = s * 32 + n
    return out


_luts: dict[tuple, np.ndarray] = {}


def _cached(by_length: tuple) -> np.ndarray:
    if by_length not in _luts:
        if len(_luts) > 64:
            _luts.clear()
        _luts[by_length] = _lut(by_length)
    return _luts[by_length]


def _decode(view: np.ndarray, bit: np.ndarray, blocks: np.ndarray, per: list[tuple[int, np.ndarray, np.ndarray]], keep: int) -> np.ndarray:
    """DC levels of component keep: a row for each lane, a column for each of its blocks.

    view: eight bytes from any byte on. bit: where each lane begins. blocks: how many blocks
    it has. per: component, DC and AC lookups of each block of an MCU.
    """
    order = np.argsort(-blocks, kind="stable")  # lanes that end early stand last
    bit, blocks = bit[order].copy(), blocks[order]
    most = int(blocks[0]) if len(blocks) else 0
    out = np.zeros((len(bit), most), np.int16)
    pred = {c: np.zeros(len(bit), np.int64) for c, _, _ in per}
    alive = np.searchsorted(-blocks, -np.arange(most), "left")  # lanes that have a block t
    for t in range(most):
        n = int(alive[t])
        c, dc, ac = per[t % len(per)]
        at = bit[:n]
        window = view[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
        e = dc[(window >> np.uint64(48)).astype(np.int64)]
        length, s = e & 31, e >> 5
        value = ((window << length.astype(np.uint64)) >> np.uint64(32)) >> (np.uint64(32) - s.astype(np.uint64))
        value = value.astype(np.int64)
        value -= np.where((value >> np.maximum(s - 1, 0)) | (s == 0), 0, (1 << s) - 1)
        pred[c][:n] += value
        out[:n, t] = pred[c][:n] if c == keep else 0
        used = length + s
        e = ac[((window << used.astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
        if not length.all() or not (e & 31).all():
            raise ValueError("a code that no table has")
        done = e < 32  # the end of the block follows at once
        at = at + used + np.where(done, e & 31, 0)
        bit[:n] = at
        left = np.flatnonzero(~done)
        k = np.ones(len(left), np.int64)
        while len(left):
            at = bit[left]
            window = view[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
            e = ac[(window >> np.uint64(48)).astype(np.int64)]
            if not (e & 31).all():
                raise ValueError("a code that no table has")
            run, s = e >> 9, (e >> 5) & 15
            bit[left] = at + (e & 31) + s
            k += np.where(e < 32, 64, run + 1)
            left, k = left[k < 64], k[k < 64]
    back = np.empty_like(out)
    back[order] = out
    return back


def thumbnails(files: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """(image, luminance thumbnail as uint8 rows) of each image in each file.

    Images with the same tables and layout are decoded together.
    """
    base = np.cumsum([0, *map(len, files)])
    data = np.frombuffer(b"".join(files) + b"\xff\xd9" + bytes(16), np.uint8)
    raw = data.tobytes()
    ff = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] != 0) & (data[1:] != 0xFF))
    restart = (data[ff + 1] & 0xF8) == 0xD0
    stops = ff[~restart]
    stuffed = np.zeros(len(data), bool)
    stuffed[1:] = (data[:-1] == 0xFF) & (data[1:] == 0)
    images: list[list[Image]] = []
    inside = np.zeros(len(data) + 1, np.int64)
    for i, f in enumerate(files):
        own, at = [], int(base[i])
        while at < base[i + 1]:
            im = parse(raw, at)
            im.end = int(stops[np.searchsorted(stops, im.begin)])
            inside[im.begin] += 1
            inside[im.end] -= 1
            own.append(im)
            at = im.end + 2 if raw[im.end + 1] == 0xD9 else len(raw)
        if not own:
            raise ValueError("an empty file")
        images.append(own)
    keep = ~(stuffed & (np.cumsum(inside)[:-1] > 0))
    place = np.cumsum(keep) - keep
    clean = np.concatenate([data[keep], np.zeros(8, np.uint8)])
    view = np.ndarray(len(clean) - 7, ">u8", clean, strides=(1,))
    marks = ff[restart]
    groups: dict[tuple, list[Image]] = {}
    for own in images:
        for im in own:
            key = (im.scan, tuple(im.components), tuple(sorted(im.tables.items())))
            groups.setdefault(key, []).append(im)
    found: dict[int, np.ndarray] = {}
    for (scan, components, tables), own in groups.items():
        table = dict(tables)
        alone = len(scan) == 1
        per = [(c, _cached(table[d]), _cached(table[16 + a])) for c, d, a in scan for _ in range(1 if alone else components[c][1] * components[c][2])]
        keep_c = 0
        if keep_c not in [c for c, _, _ in scan]:
            raise ValueError("the first scan has no luminance")
        high, wide = max(c[2] for c in components), max(c[1] for c in components)
        bits, blocks, count = [], [], []
        for im in own:
            c = components[scan[0][0]]
            span = (8 * wide // c[1], 8 * high // c[2]) if alone else (8 * wide, 8 * high)
            mcus = -(-im.width // span[0]) * -(-im.height // span[1])
            inner = marks[np.searchsorted(marks, im.begin) : np.searchsorted(marks, im.end)]
            starts = place[np.concatenate([[im.begin], inner + 2])]
            step = im.interval or mcus
            if len(starts) != -(-mcus // step):
                raise ValueError("restart markers do not match the interval")
            bits.append(starts * 8)
            blocks.append(np.minimum(step, mcus - np.arange(len(starts)) * step) * len(per))
            count.append(len(starts))
        levels = _decode(view, np.concatenate(bits), np.concatenate(blocks), per, keep_c)
        all_blocks, row = np.concatenate(blocks), 0
        for im, n in zip(own, count, strict=True):
            lanes = levels[row : row + n]
            flat = lanes.ravel() if (all_blocks[row : row + n] == lanes.shape[1]).all() else np.concatenate([x[:m] for x, m in zip(lanes, all_blocks[row : row + n], strict=True)])
            found[id(im)] = _arranged(im, flat, alone, high, wide, len(per))
            row += n
    return [[(im, found[id(im)]) for im in own] for own in images]


def _arranged(im: Image, flat: np.ndarray, alone: bool, high: int, wide: int, per: int) -> np.ndarray:
    """Levels in scan order as samples in rows, without the blocks that only fill MCUs."""
    _, h, v, q = im.components[0]
    columns, rows = -(-im.width * h // (8 * wide)), -(-im.height * v // (8 * high))
    if alone:
        grid = flat.reshape(rows, columns)
    else:
        first = sum(im.components[c][1] * im.components[c][2] for c, _, _ in im.scan[: [c for c, _, _ in im.scan].index(0)])
        across = -(-im.width // (8 * wide))
        own = flat.reshape(-1, across, per)[:, :, first : first + h * v].reshape(-1, across, v, h)
        grid = own.transpose(0, 2, 1, 3).reshape(-1, across * h)[:rows, :columns]
    return np.clip(np.floor(grid.astype(np.int64) * im.quantisers[q][0] / 8 + 128.5), 0, 255).astype(np.uint8)


def thumbnail_hash(x: np.ndarray) -> str:
    """16 hex digits: whether each cell of an 8x8 average of the thumbnail lies above their mean."""
    rows, columns = (np.minimum(np.arange(8) * n // 8, n - 1) for n in x.shape)
    sums = np.add.reduceat(np.add.reduceat(x.astype(np.int64), rows, 0), columns, 1)
    area = np.maximum(np.diff(np.append(rows, x.shape[0])), 1)[:, None] * np.maximum(np.diff(np.append(columns, x.shape[1])), 1)
    mean = sums / area
    return np.packbits(mean > mean.mean()).tobytes().hex()


def feature_of(images: list[tuple[Image, np.ndarray]]) -> str:
    """widthxheight:hash of each image, joined by semicolons."""
    return ";".join(f"{im.width}x{im.height}:{thumbnail_hash(x)}" for im, x in images)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled with zeros up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    for lo, hi, data, at in slices(batch.column(1), 1 << 20):
        raw = data.tobytes()
        yield lo, hi, [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary JPEG) of every row.

    Null and empty texts store one row of zeros. Rows with one id are stored each by itself;
    equal texts have equal files; other columns are left out; an empty table gives an empty
    result.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(map(len, texts)), pa.int64()), pa.array(store([payload_of(t) for t in texts]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, "doc_id long, n_bytes long, media binary")


def read_media(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, width, height, thumbnail (binary, row by row) and thumbnail_hash of the first image,
    samples (thumbnails of all images, one after the other), feature and error.

    A file that isn't a baseline JPEG, null among them, has nulls and a reason in error.
    """
    schema = "doc_id long, width int, height int, thumbnail binary, thumbnail_hash string, samples binary, feature string, error string"

    def one(raw: bytes | None) -> tuple:
        try:
            images = thumbnails([raw or b""])[0]
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (None,) * 6 + (str(e) or type(e).__name__,)
        im, x = images[0]
        return im.width, im.height, x.tobytes(), thumbnail_hash(x), b"".join(t.tobytes() for _, t in images), feature_of(images), None

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.string(), pa.string()]
        for batch in it:
            rows = [one(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(7))], names)

    return files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(batches, schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as store_texts() does, reads the stored bytes back and returns digests.

    doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of what was read back),
    media_bytes, media_sha256, feature. Cases as in store_texts().
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in it:
            for lo, hi, texts in _texts(batch):
                files, rows = store([payload_of(t) for t in texts]), []
                for text, file, images in zip(texts, files, thumbnails(files), strict=True):
                    back = b"".join(x.tobytes() for _, x in images)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(images)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(7))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(batches, schema)
