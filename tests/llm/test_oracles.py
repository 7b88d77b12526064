"""The DuckDB SQL of the queries against the operators, on real documents and on odd ones."""

import duckdb
import pyarrow as pa
import pytest
from conftest import ODD

from tensorloom.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
@pytest.mark.parametrize("kind", ["documents", "odd", "empty"])
def test_oracle(spark, small, tmp_path, name, kind):
    folder = small
    if kind != "documents":
        rows = ODD + [(None, "no id " + ODD[0][1]), (None, None)] if kind == "odd" else []
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        frame.write.parquet(f"{tmp_path}/documents.parquet")
        folder = str(tmp_path)
        documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})  # noqa: F841: DuckDB reads it
        con = duckdb.connect()
    else:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    out = queries.queries()[name](spark, folder)
    assert sorted(out.columns) == sorted(columns)
    got = [tuple(r) for r in out.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
