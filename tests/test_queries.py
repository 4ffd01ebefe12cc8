"""Every registered query of the engine against its SQL, on small data."""

import decimal

import pytest

from corpusq import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 4)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in SQL:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    rows = want.project(",".join(f'"{c}"' for c in columns)).fetchall()
    assert got == sorted((plain(r) for r in rows), key=str)


def test_corpus_invariants_makes_every_check(spark, duck):
    want = ["bibliography", "books", "folio", "junk", "short"]
    assert sorted(r["check"] for r in registry.queries()["corpus_invariants"](spark, DATA).collect()) == want
    assert sorted(r[0] for r in duck.sql(SQL["corpus_invariants"]).fetchall()) == want
