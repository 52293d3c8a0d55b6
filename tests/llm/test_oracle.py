"""The registered queries against their SQL: on the small tables, and on a fixture of nulls, ties and repeated rows."""

import random

import duckdb
import pytest

from cohortloom.llm import oracle, queries

from .helpers import frame

TABLES = ("documents", "pages", "benchmark")


def same(spark, name, folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{'/*.parquet' if 'sf' not in folder else ''}'")
    cur = con.execute(oracle.SQL[name])
    names = [c[0] for c in cur.description]
    found = queries.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(names)
    tuples = lambda rows: sorted(map(repr, rows))
    got, want = tuples(tuple(r[c] for c in names) for r in found.collect()), tuples(cur.fetchall())
    assert got == want and got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of odd rows."""
    r = random.Random(5)
    mess = lambda n, cs="abcdefé": " ".join("".join(r.choice(cs) for _ in range(r.randrange(1, 6))) for _ in range(n))
    item, passage, base = mess(14), mess(60), mess(80).split()
    texts = [None, "", " \t\n ", "a b", "A  B", "a b c", mess(3000), mess(30) + " " + passage, passage + " " + mess(20), mess(10) + " " + item.upper() + " " + mess(9), "x" * 900, "yé" * 500, "one two"]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:40], "x", *base[40:]]).upper()]
    texts += ["Token = 'abcdef123' password:abc API_KEY==longenough9", "AKIA" + "A1" * 9 + " AKIAAKIAB", "é" * 5 + "0123456789abcdef" * 2 + "g" + "a" * 24]
    texts += ["kſecret=abcdefgh secret=abcdefgh toKen=abcdefgh", "ghp_" + "a" * 31 + " x ghp_" + "b" * 30 + "-ghp_" + "c" * 40 + " _ghp_" + "d" * 40]
    texts += ["-----BEGIN RSA PRIVATE KEY----- eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9 + " xeyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9]
    folder = str(tmp_path_factory.mktemp("odd"))
    frame(spark, texts).repartition(3).write.parquet(f"{folder}/documents.parquet")
    html = [None, "", "a", "é", "a", mess(50), "é", "a"]
    spark.createDataFrame([(i, f"http://h/{i}", x) for i, x in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    items = [item, item + " " + mess(2), "ONE two", None, "", "--", mess(12), "x"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_tables(spark, sf, name):
    same(spark, name, sf)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_odd_rows(spark, odd, name):
    same(spark, name, odd)
