from collections import Counter

import duckdb
import pandas as pd
import pytest

from kinweave.llm import lines

SCHEMA = "page_id long, url string, html string, marks string, host string, n long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "m", "h", 1) for r in rows], SCHEMA)


def site():
    rows = [(i, f"https://www.Site.example/{i}?x=1", f"<html><head><title>t</title></head><body><nav>Home</nav><p>page {i}</p><p>Often {i % 5}</p><footer>&copy; all &amp; sundry</footer></body></html>") for i in range(20)]
    rows += [(100 + i, f"http://other.example:80/{i}", f"<p>Home<p>Home</p> unique {i}<br>tail &lt;b&gt;") for i in range(3)]
    rows += [(200, "not a url", "<p>Home</p>"), (201, None, "<p>Home</p>"), (202, "https://site.example/", None), (203, "https://site.example/", ""), (None, "https://site.example/", "Home"), (204, "https://one.example/", "<p>only</p>"), (205, "https://site.example/x", "<script>var a='<p>x</p>'</script><!-- <p>no --> seen " + "long " * 50_000)]
    return rows


def test_equals_the_oracle(spark):
    got = lines.dedup_lines(pages(spark, site())).toPandas()
    con = duckdb.connect()
    con.register("source", spark.createDataFrame(site(), "page_id long, url string, html string").toPandas().astype({"page_id": "Int64"}))
    con.execute("CREATE VIEW pages AS SELECT * FROM source")
    want = con.execute(lines.oracle()).df()
    names = ["page_id", "host", "n_lines", "n_dropped", "text"]
    plain = lambda v: "" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[names].itertuples(index=False))
    assert rows(got) == rows(want)


def test_what_goes_and_stays(spark):
    got = {r.page_id: r for r in lines.dedup_lines(pages(spark, site())).collect()}
    assert got[3].host == "site.example"
    assert got[3].text == "page 3\nOften 3"
    assert got[100].text == "unique 0"  # its other lines stand on all three pages
    assert got[200].text == got[201].text == "Home"
    assert got[204].text == "only"
    assert got[202].n_lines == got[203].n_lines == 0
    assert got[205].n_lines == 1


def test_share_counts_pages_not_lines(spark):
    rows = [(i, "http://h.example/", "Menu\n" * (5 if i == 0 else 0) + f"<p>x{i}") for i in range(10)]
    assert all(r.n_dropped == 0 for r in lines.dedup_lines(pages(spark, rows)).collect())


@pytest.mark.parametrize("rows", [[], [(1, "http://h.example/", "a")] * 4])
def test_empty_and_repeated(spark, rows):
    got = lines.dedup_lines(pages(spark, rows)).collect()
    assert Counter(r.n_dropped for r in got) == (Counter({1: 4}) if rows else Counter())
