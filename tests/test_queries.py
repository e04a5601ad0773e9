"""Every query with SQL gives the rows of that SQL at the smallest scale; planning and control rules."""

import os

import pytest

from tidewright.functions.types import ContractError, Kind, enum_change, spark_type, typmod
from tidewright.plans import catalog_queries, control  # noqa: F401
from tidewright.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    out = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    theirs = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert sorted(names) == columns
    assert ours == theirs


def test_types():
    assert enum_change(("new", "done"), ("queued", "new", "running", "done")) == "add"
    assert enum_change(("new", "done"), ("ready", "closed")) == "rename"
    for new in (("done", "new"), ("new",)):
        with pytest.raises(ContractError):
            enum_change(("new", "done"), new)
    assert typmod("varchar", 14) == (10, None)
    assert typmod("numeric", 4 + (12 << 16) + 2) == (12, 2)
    assert typmod("bit", 8) == (8, None)
    with pytest.raises(ContractError):
        spark_type(Kind("money"))


def test_control():
    c = control.Control()
    c.upsert("p", {}, 1, 1)
    with pytest.raises(ContractError):
        c.upsert("p", {}, 2, 1)
    assert c.request_rebuild("p") == 2 and c.complete_rebuilds("p", 1) == 0 and c.complete_rebuilds("p", 2) == 1 and c.complete_rebuilds("p", 2) == 0
    assert c.acquire("p", "a", 30, 0) == 1 and c.acquire("p", "b", 30, 10) is None and c.acquire("p", "b", 30, 31) == 2
    assert not c.renew("p", "a", 1, 30, 32) and c.renew("p", "b", 2, 30, 32)
    assert [control.backoff(n) for n in (0, 3, 9)] == [1, 8, 60]
    with pytest.raises(ContractError):
        control.advance("stopped", "streaming")
    assert control.shorten("a" * 64) == "a" * 38 + "_ffe054fe7ae0cb6dc65c3af9"
    assert 'pipeline="a\\"b"' in control.metrics_text({'a"b': {"lag": 1}})
