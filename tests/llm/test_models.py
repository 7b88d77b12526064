"""Learned operators: held-out accuracy, leaks, degenerate inputs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from tensorloom.llm import language, quality, rules, textbuf

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_quality_held_out(big):
    docs, labels = big
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [(truth[r.doc_id], r.predicted, r.score) for r in out if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b, _ in own) / len(own) >= 0.93
    low, high = [s for a, _, s in own if not a], [s for a, _, s in own if a]
    assert sum(x < y for x in low for y in high) / (len(low) * len(high)) >= 0.95


def test_quality_ignores_held_out_labels(big):
    """Turning every held-out label around changes no score."""
    docs, labels = big
    docs = docs.limit(300)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_quality_odd(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.score_quality(empty, none).count() == 0
    one = spark.createDataFrame([(5, 1), (5, 1), (None, 0), (99, 0), (6, None)], "doc_id long, quality int")
    assert quality.score_quality(odd, one).count() == odd.count()


def test_statistics_slices():
    """Statistics do not depend on how texts are sliced."""
    texts = ["a b a b a b", "", "ABC def! def!\nx\nx\n", "é à | % 12"]
    whole = quality.statistics_of(*textbuf.buffers(pa.array(texts)))
    alone = np.vstack([quality.statistics_of(*textbuf.buffers(pa.array([t]))) for t in texts])
    assert np.allclose(whole, alone)
    assert not whole[1].any()


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_rules(big):
    docs, labels = big
    out = rules.apply_rules(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
    assert not any(r.base_failed and r.kept for r in out)
    judged = [(truth[r.doc_id], r.kept) for r in out if r.doc_id in truth and not r.base_failed]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.2
    assert {r.rule for r in out if not r.kept and not r.base_failed} <= set(range(1, 9))


def test_rules_plain(big, spark):
    """The verdict of every document against a plain learner over rows."""
    docs, labels = big
    text = {r.doc_id: r.text for r in docs.collect()}
    prunes = {r.doc_id: r.p for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("p")).collect()}
    failed = {d: n < 10 or 100 * k > 20 * n for d, (n, *_, k) in ((d, brute.counts(t)) for d, t in text.items())}
    stats = {d: brute.rule_stats(t) for d, t in text.items()}
    rows = [(stats[r.doc_id], r.quality, prunes[r.doc_id]) for r in labels.collect() if r.doc_id in text and r.quality is not None and not failed[r.doc_id]]
    learned = brute.decision_list(rows)
    assert learned
    want = {d: not failed[d] and not any(all((x[s] > c) == over for s, over, c in rule) for rule in learned) for d, x in stats.items()}
    assert {r.doc_id: r.kept for r in rules.apply_rules(docs, labels).collect()} == want


def test_rules_odd(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rules.apply_rules(odd, none).collect()
    assert all(r.kept != r.base_failed for r in got) and len(got) == odd.count()
    assert rules.apply_rules(empty, none).count() == 0


def test_language_held_out(big):
    docs, _ = big
    out = language.identify(docs).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert len(out) == len(truth) and all(r.held_out == (brute.crc(r.doc_id) % 3 == 1) for r in out)
    own = [(truth[r.doc_id][0], r.lang_pred) for r in out if r.held_out and truth[r.doc_id][0]]
    assert sum(a == b for a, b in own) / len(own) >= 0.97


def test_language_odd(odd, empty):
    got = {(r.doc_id, r.lang_pred == "und", r.score) for r in language.identify(odd).collect()}
    und = {d for d, u, _ in got if u}
    assert und == {1, 2, 3, 20} and all(s == 0 for d, u, s in got if u)
    assert all(0 < s <= 1 for d, u, s in got if not u)
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_rare(spark):
    """A language with few rows is learned however small the sample is."""
    rows = [(i, "the cat sat on the mat", "en" if i % 2 else "fr") for i in range(2000)] + [(5000 + i, "ж" * 40, "ru") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train_network(frame, max_documents=12).classes == ["en", "fr", "ru"]
    assert language.train_network(frame, max_documents=2).classes == ["en", "fr", "ru"]


def test_windows_cover():
    data, at = textbuf.buffers(pa.array(["x" * 500, "", "yz"]))
    x, own, n = language.windows_of(data, at)
    assert own.tolist() == [0, 0, 0, 2] and n.tolist() == [192, 192, 116, 2]
    assert (x[3, 2:] == 256).all() and (x[2, 116:] == 256).all()


def test_gradient():
    """Training lowers the loss of a separable toy problem to nearly nothing."""
    rng = np.random.default_rng(0)
    x = rng.integers(97, 110, (200, language.WINDOW)).astype(np.int16)
    y = np.arange(200) % 2
    x[y == 1, 50:53] = [122, 120, 122]
    net = language.ByteNet(["a", "b"])
    net.train(x, y, epochs=30)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.95


def test_quality_plain(big):
    """Scores against plain ridge regression on dense features of all labelled rows, with plain isotonic calibration."""
    docs, labels = big
    docs = docs.limit(400)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    stats = {r.doc_id: np.array(r[1:]) for r in quality.document_statistics(docs).collect()}
    train = [(stats[r.doc_id], r.quality, r.doc_id) for r in labels.collect() if r.doc_id in stats and brute.crc(r.doc_id) % 4 != 2]
    x, y = np.array([t[0] for t in train]), np.array([t[1] for t in train], float)
    model = quality.Model(x.mean(0), x.std(0), 192, 7)
    spark = docs.sparkSession
    half = {r.id: r.part for r in spark.createDataFrame([(t[2],) for t in train], "id long").select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("part")).collect()}
    part = np.array([half[t[2]] for t in train])

    def weights(rows):
        z = model.lift(x[rows])
        penalty = np.full(z.shape[1], 1e-3 * len(z))
        penalty[-1] = 1e-12 * len(z)
        return np.linalg.lstsq(np.vstack([z, np.diag(np.sqrt(penalty))]), np.append(y[rows], np.zeros(z.shape[1])), rcond=None)[0]

    z = model.lift(x)
    raw = np.where(part == 0, z @ weights(part == 1), z @ weights(part == 0))
    grid = np.clip(np.floor((raw + 1) / 3 * 2048), 0, 2047)
    points = sorted({g: (y[grid == g].sum(), (grid == g).sum()) for g in grid}.items())
    centre, share, count = [(g + 0.5) / 2048 * 3 - 1 for g, _ in points], [p / n for _, (p, n) in points], [n for _, (_, n) in points]
    # the largest mean over beginnings of the smallest mean over ends: isotonic regression by its definition
    mean = lambda a, b: sum(s * n for s, n in zip(share[a:b], count[a:b], strict=True)) / sum(count[a:b])
    fitted = [max(min(mean(a, b) for b in range(i + 1, len(share) + 1)) for a in range(i + 1)) for i in range(len(share))]
    pools = sorted({round(f, 12) for f in fitted})
    place = [np.average([c for c, f in zip(centre, fitted, strict=True) if round(f, 12) == p], weights=[n for n, f in zip(count, fitted, strict=True) if round(f, 12) == p]) for p in pools]
    for d, s in stats.items():
        want = np.interp((model.lift(s[None]) @ weights(np.ones(len(x), bool)))[0], place, pools)
        assert abs(got[d] - want) < 1e-6


def test_tree_sums(spark):
    """Sums over many places, level by level, equal the plain sum."""
    rows = [(p % 2, p, np.full(3, float(p)).tobytes()) for p in range(500)]
    got = quality.tree_sums(spark.createDataFrame(rows, "part int, place long, sums binary"), (20, 3)).collect()
    assert len(got) == 6
    for part in (0, 1):
        assert sum(np.frombuffer(bytes(r.sums)) for r in got if r.part == part).tolist() == [float(sum(range(part, 500, 2)))] * 3


def test_network_plain():
    """The forward pass against loops over windows, places, filters and bytes."""
    net = language.ByteNet(["a", "b", "c"], seed=3)
    net.bias += np.linspace(-0.5, 0.5, len(net.bias)).astype(np.float32)
    data, at = textbuf.buffers(pa.array(["hello world " * 20, "", "ab"]))
    x, _, _ = language.windows_of(data, at)
    got = net.probabilities(x, block=1)
    for w, p in zip(x, got, strict=True):
        pooled = []
        for f in range(net.filters.shape[1]):
            width = language.WIDTHS[f // language.FILTERS]
            best = max(sum(float(net.embed[w[i + k]] @ net.filters[k * language.EMBED : (k + 1) * language.EMBED, f]) for k in range(width)) for i in range(len(w) - max(language.WIDTHS) + 1))
            pooled.append(max(best + float(net.bias[f]), 0.0))
        z = np.array(pooled) @ net.out + net.out_bias
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-5)


def test_language_ties():
    """Equal scores go to the language that sorts first; rows keep their order."""
    net = language.ByteNet(["b", "a"][::-1])
    net.out[:] = 0
    batch = pa.RecordBatch.from_arrays([pa.array([4, 3]), pa.array(["text one", None])], ["doc_id", "text"])
    got = pa.Table.from_batches(list(language._predicted(net)(iter([batch])))).to_pylist()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(4, "a"), (3, "und")] and abs(got[0]["score"] - 0.5) < 1e-6


def test_language_whole_texts(spark):
    """What tells a language may stand anywhere in a text: all windows of the sample teach."""
    rng = np.random.default_rng(1)
    noise = lambda: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 6, 5)) for _ in range(120))
    rows = [(i, noise() + (" zyxw zyxw" * 8 if i % 2 else " qrst qrst" * 8) + noise(), "one" if i % 2 else "two") for i in range(120)]
    net = language.train_network(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    data, at = textbuf.buffers(pa.array(["zyxw zyxw " * 19, "qrst qrst " * 19]))
    assert [net.classes[k] for k in net.probabilities(language.windows_of(data, at)[0]).argmax(1)] == ["one", "two"]
