"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from tilewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    got = [tuple(map(plain, r)) for r in df.collect()]
    sql = registry.ORACLE_SQL.get(name)
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_predictor_undo_of_odd_rows(spark, tmp_path):
    """Samples whose product is a whole number in single precision only, missing ones, rows of several widths."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = np.random.default_rng(5).uniform(-1, 1, 4_000_000).astype(np.float32)
    edge = v[np.floor(v * np.float32(255)) != np.floor(v.astype(float) * 255)].tolist()
    assert len(edge) > 3
    rows = [edge, [0.5, None, 0.25], [None, None, 0.1, -0.3], [], None, [None], [0.2, 0.3, 0.4]]
    table = pa.table({"vec_id": pa.array([1, 2, 3, 4, 5, 6, None]), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    df = registry.QUERIES["r_predictor_undo"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    want = c.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL['r_predictor_undo']})").fetchall()
    assert len(want) == len(edge) + 11
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_view_tiles_sends_no_grid_through_the_driver(spark, sf):
    plan = registry.QUERIES["r_view_tiles"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
