"""Each stage against a plain version on its own input, and the whole run."""

import corpus_pipeline as cp
import pytest
from conftest import ODD, PASSAGE
from pyspark.sql import functions as F

import brute
from tensorloom.llm import components, simhash
from tensorloom.llm.storage import materialize


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def mask(text):
    out, at = [], 0
    for _, a, b in brute.secret_spans(text):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def check_stages(spark, docs, sf_dir):
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        given, got = rows(docs), rows(out)
        if name == "quality rules":
            assert set(got) <= set(given)
            for r in got:
                n, *_, repeated = brute.counts(r[1])
                assert n >= 10 and 100 * repeated <= 20 * n
        elif name == "SimHash near-dedup":
            # one row of each component: the smallest (id, text hash), repeated rows by their smallest other columns
            component = brute.components([(i, brute.fingerprint(r[1])) for i, r in enumerate(given)])
            hashes = [r.h for r in spark.createDataFrame([(i, r[1]) for i, r in enumerate(given)], "i long, t string").select("i", F.xxhash64("t").alias("h")).orderBy("i").collect()]
            best = {}
            for i, (r, c) in enumerate(zip(given, component, strict=True)):
                order = (r[0] is None, r[0] or 0, hashes[i], [(v is not None, v or 0) for v in r[2:]])
                best[c] = min(best.get(c, (order, r)), (order, r), key=lambda x: x[0])
            assert got == sorted((r for _, r in best.values()), key=repr)
        elif name == "substring dedup":
            cut = brute.kept_words([r[:2] for r in given])
            want = [(r[0], t := (r[1] if not k[2] else k[3]), *r[2:4], None if t is None else len(t)) for r, k in zip(given, cut, strict=True)]
            assert got == sorted(want, key=repr)
        else:
            want = [(r[0], t := (None if r[1] is None else mask(r[1])), *r[2:4], None if t is None else len(t)) for r in given]
            assert got == sorted(want, key=repr)
        docs = spark.createDataFrame([tuple(r) for r in got], docs.schema)
    packed = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages(spark, small, documents):
    check_stages(spark, documents, small)


def test_stages_odd(spark, small):
    frame = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in ODD] + [(0, ODD[0][1], None, "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    check_stages(spark, frame, small)


def test_near_duplicates_by_row(spark, small):
    """Of each component one row stays, where ids repeat or are missing too."""
    text = lambda k: " ".join(f"w{k * 100 + i}" for i in range(30))
    given = [(1, text(1)), (5, text(1)), (5, text(2)), (5, text(3)), (None, text(3)), (None, text(4)), (None, text(4)), (None, text(5)), (7, text(6)), (7, text(6)), (8, text(7)), (9, text(2))]
    frame = spark.createDataFrame([(d, t, None, "s", len(t)) for d, t in given], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = [(1, text(1)), (5, text(2)), (5, text(3)), (None, text(4)), (None, text(5)), (7, text(6)), (8, text(7))]
    assert len({c for c in brute.components([(i, brute.fingerprint(t)) for i, (_, t) in enumerate(want)])}) == len(want)
    out = cp.near_duplicates(spark, frame, small)
    assert out.columns == frame.columns
    assert rows(out.select("doc_id", "text")) == sorted(want, key=repr)


def test_near_duplicates_without_driver(spark, small, documents, monkeypatch):
    """No table of index entries or links is written by a plan that broadcasts them."""
    plans = []

    def spied(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    for module in (simhash, components):
        monkeypatch.setattr(module, "materialize", spied)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        cp.near_duplicates(spark, documents, small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {"hot", "components"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_verdicts_without_driver(spark, small, documents):
    """Rows with components, and documents with their verdicts, are joined by shuffle, in the plan as it ran too."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        frames = {"clusters": simhash.clusters(cp._own(documents), carry=("text_hash",)), "near": cp.near_duplicates(spark, documents, small), "rules": cp.quality_rules(spark, documents, small)}
        plans = {}
        for name, frame in frames.items():
            assert frame.collect(), name
            plans[name] = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [name for name, plan in plans.items() if "Broadcast" in plan]
    assert {name for name, plan in plans.items() if "SortMergeJoin" in plan} == set(plans)


def test_run(spark, small, documents):
    out = cp.run(spark, small)
    assert 0 < out.select("doc_id").distinct().count() < documents.count()


#: Names that the stages use inside, and one that needs quoting.
CLASHING = ["gone_id", "first_id", "verdict_id", "text_hash", "row", "a.b", "key", "home", "root", "n", "t", "kept"]


def test_clashing_columns(spark, small):
    """Stages carry columns of any name along."""
    rows = [(i, f"{PASSAGE} tells the tale of number {i} and password = abcdefgh{i:04d}", *range(i, i + len(CLASHING))) for i in range(4)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, *range(len(CLASHING)))], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        got = {r[0]: r[2:] for r in out.collect()}
        assert got.items() <= {r[0]: r[2:] for r in docs.collect()}.items(), name
        assert name == "SimHash near-dedup" or 0 in got
    assert cp.packed(spark, docs, small).select("doc_id").distinct().count() == 5


@pytest.mark.parametrize("columns", ["doc_id long, text string", "doc_id long, text string, lang string, source string, n_chars long"])
def test_empty_tables(spark, small, columns):
    docs = spark.createDataFrame([], columns)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, small)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns


def test_run_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
