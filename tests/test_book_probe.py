"""Coverage of books against SQL, at shares that lie between two rounded values."""

from corpusq.operators import clean

SQL = "SELECT book, round(k / n, 3) AS coverage, CASE WHEN round(k / n, 3) < 0.6 THEN concat('text coverage ', printf('%.2f', round(k / n, 3)), ' is too low') ELSE concat('text coverage ', printf('%.2f', round(k / n, 3))) END AS reason FROM books"


def test_coverage_is_rounded_as_in_sql(spark):
    import duckdb

    books = [(f"{n}/{k}", n, k) for n, k in ((8, 1), (8, 7), (400, 201), (200, 169), (16, 1), (1, 1), (3, 0))]
    rows = [(b, p, "x" * 51 if p < k else None, "c", False) for b, n, k in books for p in range(n)]
    got = clean.probed(spark.createDataFrame(rows, "book string, page int, text string, chapter string, has_figure boolean"))
    c = duckdb.connect()
    c.execute("create table books (book varchar, n bigint, k bigint)")
    c.executemany("insert into books values (?, ?, ?)", books)
    want = sorted(c.sql(SQL).fetchall())
    assert sorted(tuple(r) for r in got.select("book", "coverage", "reason").collect()) == want
    assert ("8/1", 0.125, "text coverage 0.12 is too low") in want and ("400/201", 0.502, "text coverage 0.50 is too low") in want
