"""Names of documents against the SQL, documents in several rows and letters beyond ASCII too; no sort of all names of all documents."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from ripple import catalogue


def test_grounded_names(spark, tmp_path):
    rows = [(1, "Alpha beta_1 12gamma"), (1, "alpha zeta Kelvin"), (2, None), (2, "the_end"), (None, "Beta İx"), (3, ""), (4, "9 - !"), (5, "zz yy xx alphabet")]
    ids, texts = zip(*rows, strict=True)
    for name, table in {"documents": {"doc_id": pa.array(ids, pa.int64()), "text": texts}, "part": {"p_name": ["alpha", "Beta", None]}, "benchmark": {"text": ["end of it", None]}}.items():
        pq.write_table(pa.table(table), tmp_path / f"{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = catalogue.queries()["grounded_names"](spark, str(tmp_path))
    want = duckdb.sql(catalogue.oracle_sql()["grounded_names"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
