"""Rows of a query and of its SQL, compared whatever their order."""

import os

import duckdb
import numpy as np


def by_sql(sql, data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con.execute(sql).df()


def same(got, want):
    got, want = (f[sorted(f.columns)] for f in (got, want))
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    keys = list(got.columns)
    got, want = (f.sort_values(keys, key=lambda c: c.astype(str) if c.dtype == object else c).reset_index(drop=True) for f in (got, want))
    for c in keys:
        if got[c].dtype.kind in "fi" and want[c].dtype.kind in "fi":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6, err_msg=c)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c
