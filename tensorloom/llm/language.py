"""Language identification by a byte convolutional network trained in numpy.

Texts are cut into windows of fixed length that together cover the whole text. Byte
embeddings pass filters of several widths; the maximum of each filter over the window feeds
a softmax. A text's distribution is the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import fold_of
from .textbuf import slices

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 10, 6


class ByteNet:
    """Embedding, filters of WIDTHS, max pooling, softmax; float32."""

    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        k = len(classes)
        self.classes = classes
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)  # 256: past the end
        self.embed[256] = 0
        self.filters = rng.normal(0, 0.3, (max(WIDTHS) * EMBED, FILTERS * len(WIDTHS))).astype(np.float32)
        #: One bank as wide as the widest filter; narrower ones are zero beyond their width.
        self.mask = np.concatenate([np.repeat((np.arange(max(WIDTHS)) < w)[:, None], EMBED, 1).reshape(-1, 1) * np.ones((1, FILTERS)) for w in WIDTHS], 1).astype(np.float32)
        self.filters *= self.mask
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)).astype(np.float32)
        self.out_bias = np.zeros(k, np.float32)

    def _responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.embed[windows].reshape(len(windows), -1)
        wide, step = max(WIDTHS) * EMBED, EMBED
        view = np.lib.stride_tricks.as_strided(e, (len(windows), windows.shape[1] - max(WIDTHS) + 1, wide), (e.strides[0], step * 4, 4))
        flat = np.ascontiguousarray(view).reshape(-1, wide)
        return flat, (flat @ self.filters).reshape(len(windows), -1, self.filters.shape[1])

    def probabilities(self, windows: np.ndarray, block: int = 64) -> np.ndarray:
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for i in range(0, len(windows), block):
            _, r = self._responses(windows[i : i + block])
            out[i : i + block] = self._softmax(np.maximum(r.max(1) + self.bias, 0))
        return out

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on cross entropy; classes weigh the same however many windows they have."""
        rng = np.random.default_rng(seed)
        weight = (len(labels) / (len(self.classes) * np.maximum(np.bincount(labels, minlength=len(self.classes)), 1))).astype(np.float32)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m, v, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        places = windows.shape[1] - max(WIDTHS) + 1
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                x, y = windows[order[i : i + batch]], labels[order[i : i + batch]]
                flat, r = self._responses(x)
                best = r.argmax(1)
                pooled = np.maximum(np.take_along_axis(r, best[:, None], 1)[:, 0] + self.bias, 0)
                p = self._softmax(pooled)
                p[np.arange(len(y)), y] -= 1
                p *= weight[y][:, None] / len(y)
                back = (p @ self.out.T) * (pooled > 0)
                rows = np.arange(len(y))[:, None] * places + best
                grad_filters, grad_embed = np.empty_like(self.filters), np.zeros_like(self.embed)
                for c in range(self.filters.shape[1]):
                    taken = flat[rows[:, c]]
                    grad_filters[:, c] = taken.T @ back[:, c]
                    to = (back[:, c : c + 1] * self.filters[:, c]).reshape(-1, max(WIDTHS), EMBED)
                    at = x[np.arange(len(y))[:, None], best[:, c : c + 1] + np.arange(max(WIDTHS))]
                    np.add.at(grad_embed, at, to)
                grad_embed[256] = 0
                grads = {"embed": grad_embed, "filters": grad_filters * self.mask, "bias": back.sum(0), "out": pooled.T @ p, "out_bias": p.sum(0)}
                t += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * grads[n]
                    v[n] = 0.999 * v[n] + 0.001 * grads[n] ** 2
                    setattr(self, n, (getattr(self, n) - rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32))


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each): consecutive, the last of a text filled with 256."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    own = np.repeat(np.arange(len(size)), count)
    start = at[own] + (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, at[own + 1] - start)
    place = start[:, None] + np.arange(WINDOW)
    full = np.minimum(place, max(len(data) - 1, 0))
    out = data[full].astype(np.int16) if len(data) else np.empty((0, WINDOW), np.int16)
    out[np.arange(WINDOW) >= length[:, None]] = 256
    return out, own, length


def train_network(docs: DataFrame, max_documents: int = 3000, max_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network of all languages, from whole texts of a bounded sample of labelled rows.

    The sample has at most max_documents rows and max_bytes of text, but one row a language
    whatever its size. Both bounds are dealt to the languages, rare ones first, so each has
    rows in the sample; of a language the rows with the smallest hash of the id are taken.
    The bounds keep what reaches the driver at a fixed size; of each text all windows are
    used. None: no labelled text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and length(text) > 0")
    counts, slots, left, bounds = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}, 1 << 40, max_documents, []
    if not counts:
        return None
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        most = min(counts[lang], max(1, left // (len(counts) - k)))
        left -= most
        # about 1.5 times the bound pass, whatever the input, so the sort by language stays small as well
        bounds.append((lang, most, min(slots, math.ceil(slots * min(1.0, 1.5 * (most + 100) / counts[lang])))))
    near = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(slots))).join(F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, most long, few long")), "lang").filter("h < few")
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    near = near.withColumn("place", F.row_number().over(order)).withColumn("bytes", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = near.filter((F.col("place") <= F.col("most")) & ((F.col("place") == 1) | (F.col("bytes") <= max_bytes // len(counts)))).orderBy("lang", "place").select("lang", "text").collect()
    classes = sorted(counts)
    net = ByteNet(classes)
    raw = [r.text.encode() for r in got]
    x, own, _ = windows_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    net.train(x, np.array([classes.index(r.lang) for r in got])[own])
    return net


def _predicted(net: ByteNet | None) -> Callable:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, at in slices(batch.column(1), 1 << 20):
                raw, n = data.tobytes(), hi - lo
                letters = [_has_letter(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                if net is None:
                    lang, score = [None] * n, np.zeros(n)
                else:
                    x, own, length = windows_of(data, at)
                    p = net.probabilities(x) * length[:, None]
                    total = np.column_stack([np.bincount(own, p[:, c], minlength=n) for c in range(len(net.classes))])
                    total /= np.maximum(np.diff(at), 1)[:, None]
                    score = np.clip(total.max(1), 0, 1)
                    lang = [net.classes[c] for c in total.argmax(1)]
                ok = [a and b is not None for a, b in zip(letters, lang, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array([x if k else "und" for x, k in zip(lang, ok, strict=True)]), pa.array(np.where(ok, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return batches


def _has_letter(raw: bytes) -> bool:
    if any(map(bytes.isalpha, (raw[:64], raw[:1]))):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Learns from rows whose crc32(id) modulo folds is not held_out, with a language and a
    text; nothing but the text enters a prediction. lang_pred is `und` with score 0 where
    the text is null or has no letter, or where nothing could be learned. Every byte of a
    text is in a window. Rows with one id are predicted each by itself; ties go to the
    language that sorts first; other columns are left out; an empty table gives an empty result.
    """
    key = F.col(id_col).cast("long")
    net = train_network(docs.filter(fold_of(key, folds) != held_out), id_col=id_col, text_col=text_col, lang_col=lang_col, **sample)
    out = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predicted(net), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
