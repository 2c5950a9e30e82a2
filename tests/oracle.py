"""Compares registered queries with their SQL on one set of tables."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def same(frame, connection, sql):
    """Column names and rows, floats to 9 digits."""
    names = sorted(frame.columns)
    key = lambda row: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)
    ours = sorted(key(r) for r in frame.select(*names).collect())
    got = connection.execute(sql)
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names, (theirs_names, names)
    order = [theirs_names.index(n) for n in names]
    theirs = sorted(key([r[i] for i in order]) for r in got.fetchall())
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, (len(bad), bad[:2])
    return len(ours)
