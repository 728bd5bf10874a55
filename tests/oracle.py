"""A query's rows held against its SQL, as the driver does it."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def _normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else repr(v) if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def same(spark, run, sql: str, folder: str = SMALL) -> None:
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got, want = _normal(run(spark, folder).toPandas()), _normal(db.execute(sql).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)
