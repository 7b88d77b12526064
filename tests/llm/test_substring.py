"""Exact repeats: hot passages, repeated ids, equal hashes of different words."""

import brute
import numpy as np
import pyarrow as pa

from tensorloom.llm import substring
from tensorloom.llm.storage import materialize

PASSAGE = " ".join(f"line{i}" for i in range(14))


def table(rows):
    return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})


def test_hot_passage(spark):
    """A passage that every document has, in 10,000 documents: right rows, an entry a home in the buckets."""
    rows = [(i, f"own{i} " * 3 + PASSAGE + "".join(f" tail{i}x{k}" for k in range(i % 5))) for i in range(10_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(frame).collect()}
    assert got == {d: (n, k, t) for d, n, k, t in brute.kept_words(rows)}
    home = substring.Home(table(rows), substring.WINDOW)
    sent = substring._probes(substring.WINDOW, 0)(table(rows).append_column("home", pa.array([3] * len(rows))))
    entries = int(np.frombuffer(sent.column("blob")[0].as_py(), np.uint32, 1)[0])
    assert entries < len(home.words) - 7 * len(rows) + len(rows)  # the passage's own blocks stand once for all rows


def test_every_bucket_and_home(spark):
    """Documents without an id, one id with most of the rows, and a text of two thousand words twice."""
    long = " ".join(f"v{i}" for i in range(2000))
    rows = [(7, f"{PASSAGE} n{i}") for i in range(300)] + [(None, f"{PASSAGE} m{i}") for i in range(300)] + [(9, long), (8, "x " + long), (1, ""), (2, None), (3, PASSAGE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(frame).collect()), key=repr)
    known = brute.kept_words([r for r in rows if r[0] is not None])
    want = [(d, n, k) for d, n, k, _ in known] + [(None, len(brute.words(t)), 0) for d, t in rows if d is None]
    assert got == sorted(want, key=repr)


def test_words_decide(monkeypatch):
    """Where hashes of different words are equal, words that differ stay."""
    monkeypatch.setattr(substring, "rolling", lambda words, k: np.zeros(max(len(words) - k + 1, 0), np.uint64))
    rows = [(1, " ".join(f"a{i}" for i in range(13))), (2, " ".join(f"b{i}" for i in range(20))), (3, " ".join(f"a{i}" for i in range(13)))]
    home = substring.Home(table(rows), 13)
    assert substring._repeated(home, [], 13).tolist() == [33]  # the last text alone, at its first word
    assert substring._repeated(home, [" ".join(f"c{i}" for i in range(30)).encode()], 13).tolist() == [33]


def test_columns(spark):
    """Columns with odd names come back as they were."""
    frame = spark.createDataFrame([(1, PASSAGE, 5, 6), (2, PASSAGE, 7, 8)], "doc_id long, text string, `a.b` int, home int")
    out = substring.remove_repeats(frame, keep_text=True, carry=["doc_id", "a.b", "home"]).select("doc_id", "n_removed", "row.*")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 1, 5, 6), (2, 14, 2, 7, 8)]
    assert out.columns == ["doc_id", "n_removed", "doc_id", "a.b", "home"]
    assert materialize(frame, "odd names").count() == 2
