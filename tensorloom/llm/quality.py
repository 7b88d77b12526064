"""Quality scores: ridge on random Fourier features of document statistics, calibrated.

Document statistics are counted over whole texts and written once. Random Fourier features
of the standardised statistics approximate a Gaussian kernel. Each partition of labelled
rows adds up its part of the normal equations for two folds; the parts are added in a tree,
so that the driver gets a fixed number of them whatever the input. It solves the ridge
system for each fold and for both, scores every fold with the other one's weights, and fits
an isotonic curve to a fixed grid of those scores. All labelled rows take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textbuf import IN_WORD, release, run_hash, runs, slices, table_of

NAMES = ("log_bytes", "log_words", "word_length", "word_spread", "letters", "capitals", "digits", "marks", "symbols", "shouts", "lines", "other_bytes", "entropy", "distinct", "doubled", "repeated_trigrams", "repeated_lines")


def _class(chars: bytes) -> np.ndarray:
    return ~table_of(chars)


_CLASSES = {
    "letters": _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))),
    "capitals": _class(bytes(range(65, 91))),
    "digits": _class(b"0123456789"),
    "marks": _class(b".,;:?'\"()-"),
    "symbols": _class(b"#*$%&|<>"),
    "shouts": _class(b"!"),
    "lines": _class(b"\n"),
    "other_bytes": _class(bytes(range(128, 256))),
}


def _repeats(own: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys of each text, number of keys of each text)."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    both = np.sort((own.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))  # a slice has under 2**24 texts
    new = np.concatenate([[True], both[1:] != both[:-1]])
    return np.bincount((both[new] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float), np.bincount(own, minlength=n).astype(float)


def statistics_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text of a slice; an empty text has zeros."""
    n, size = len(at) - 1, np.diff(at).astype(float)
    histogram = np.bincount(np.repeat(np.arange(n), np.diff(at)) * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    share = histogram / np.maximum(size, 1)[:, None]
    starts, ends, first = runs(data, at, IN_WORD)
    words = np.diff(first).astype(float)
    own = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    mean = np.bincount(own, length, minlength=n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(own, length**2, minlength=n) / np.maximum(words, 1) - mean**2, 0))
    h = run_hash(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    distinct, _ = _repeats(own, h, n)
    same = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1])) if len(h) else np.empty(0, np.int64)
    doubled = np.bincount(own[same], minlength=n)
    tri = (h[:-2] * np.uint64(0xD1342543DE82EF95) + h[1:-1]) * np.uint64(0xD1342543DE82EF95) + h[2:]
    whole = own[2:] == own[:-2]
    tri_distinct, tri_all = _repeats(own[:-2][whole], tri[whole], n)
    l_starts, l_ends, l_first = runs(data, at, table_of(b"\n"))
    lines, all_lines = _repeats(np.repeat(np.arange(n), np.diff(l_first)), run_hash(data, l_starts, l_ends) if len(l_starts) else np.empty(0, np.uint64), n)
    ratio = lambda x, y: x / np.maximum(y, 1)
    columns = [np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread)]
    columns += [share[:, _CLASSES[k]].sum(1) for k in NAMES[4:12]]
    columns += [-(share * np.log(np.where(share > 0, share, 1))).sum(1), ratio(distinct, words), ratio(doubled, words), ratio(tri_all - tri_distinct, tri_all), ratio(all_lines - lines, all_lines)]
    return np.column_stack(columns)


def _batch_statistics(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo, hi, data, at in slices(batch.column(1)):
            x = statistics_of(data, at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in x.T)], ["doc_id", *NAMES])
    release()


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and NAMES (doubles) of every row; null texts count as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_batch_statistics, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


class Model:
    """Fixed-size parameters: scaling, random directions, ridge weights, calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.directions = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.phases = rng.uniform(0, 2 * np.pi, features)
        self.weights = {}
        self.curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(x))])

    def raw(self, x: np.ndarray, fold: int = -1) -> np.ndarray:
        return self.lift(x) @ self.weights[fold]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.curve), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending x; (centre, share) of each pool."""
    pools: list[list[float]] = []
    for a, n, p in zip(x, total, positive, strict=True):
        pools.append([a * n, n, p])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    return np.array([a / n for a, n, _ in pools]), np.array([p / n for _, n, p in pools])


def _matrix(columns: list) -> np.ndarray:
    return np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns])


def _equations(model: Model) -> Callable:
    """Sums of a partition for each fold that has rows in it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sums = len(model.phases) + 1, {}
        for batch in it:
            part, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
            z = model.lift(_matrix(batch.columns[2:]))
            for f in np.unique(part).tolist():
                own = z[part == f]
                sums[f] = sums.get(f, np.zeros((size, size + 1))) + own.T @ np.column_stack([own, y[part == f]])
        place = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([place] * len(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "place", "sums"])

    return batches


def _added(width: int) -> Callable:
    """One row of a group of sums, added in the order of their places so that a rerun gives the same bits."""

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        return pa.table({"part": table.column("part")[:1], "place": pa.array([table.column("place")[0].as_py() % width], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    return group


def tree_sums(sums: DataFrame, widths: tuple[int, ...] = (1024, 16)) -> DataFrame:
    """(part, place, sums) added up to at most the last width of rows for each part, level by level."""
    for width in widths:
        sums = sums.groupBy("part", F.pmod("place", F.lit(width)).alias("slot")).applyInArrow(_added(width), "part int, place long, sums binary")
    return sums


def _graded(model: Model, bins: int) -> Callable:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            part, x = batch.column(0).to_numpy(), _matrix(batch.columns[2:])
            raw = np.where(part == 0, model.raw(x, 1), model.raw(x, 0))
            place = np.clip(np.floor((raw + 1) / 3 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], ["bin", "label"])

    return batches


def fit(train: DataFrame, features: int = 192, ridge: float = 1e-3, bins: int = 2048, seed: int = 7) -> Model:
    """A model from rows of doc_id, label (0 or 1) and NAMES. No rows: every score is 0.5."""
    moments = train.agg(F.count("*"), *[F.avg(n) for n in NAMES], *[F.stddev_pop(n) for n in NAMES]).first()
    if not moments[0]:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), features, seed)
    k = len(NAMES)
    model = Model(np.array(moments[1 : k + 1], float), np.array(moments[k + 1 :], float), features, seed)
    rows = train.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("part"), F.col("label").cast("int").alias("label"), *NAMES)
    size = features + 1
    sums = np.zeros((2, size, size + 1))
    for r in tree_sums(rows.mapInArrow(_equations(model), "part int, place long, sums binary")).orderBy("part", "place").collect():
        sums[r.part] += np.frombuffer(bytes(r.sums)).reshape(size, size + 1)
    for f, s in ((0, sums[0]), (1, sums[1]), (-1, sums[0] + sums[1])):
        n = max(s[-1, size - 1], 1.0)
        model.weights[f] = np.linalg.solve(s[:, :size] + ridge * n * np.diag([*[1.0] * features, 1e-9 + (s[-1, size - 1] == 0)]), s[:, size])
    grid = rows.mapInArrow(_graded(model, bins), "bin int, label int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("p")).orderBy("bin").collect()
    x = (np.array([r.bin for r in grid]) + 0.5) / bins * 3 - 1
    model.curve = isotonic(x, np.array([r.n for r in grid], float), np.array([r.p for r in grid], float))
    return model


def _scored(model: Model, threshold: float) -> Callable:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            score = model.score(_matrix(batch.columns[2:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return batches


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit_options: float) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= threshold) of every row.

    Labels of rows whose crc32(id) modulo folds is held_out are never read; null labels and
    labels without a document are left out, a document's several labels count each. Null
    and empty texts are scored by the statistics of an empty text. Rows with one id are
    scored each by itself. Other columns are left out; an empty table gives an empty result,
    no labels at all a score of 0.5.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics")
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null and doc_id is not null")
    train = materialize(stats.join(marked.filter(fold_of(F.col("doc_id"), folds) != held_out), "doc_id"), "train")
    model = fit(train, **fit_options)
    return stats.select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), *NAMES).mapInArrow(_scored(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
