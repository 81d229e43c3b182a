"""URL filters: rules against SQL on the whole table, the classifier on hosts that it never saw."""

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.llm import url_filter as uf

RULES_SQL = r"""
WITH u AS (SELECT page_id, contains(url, '://') AS ok, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
h AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u)
SELECT page_id, host, path, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h
"""


def test_rules_equal_sql(spark):
    pages = "/root/testdata/sf0.1/pages.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{pages}'")
    want = {r[0]: r[1:] for r in con.execute(RULES_SQL).fetchall()}
    rows = uf.url_filter(spark.read.parquet(pages)).collect()
    assert {r["page_id"]: tuple(r)[1:4] for r in rows} == want and len(rows) == len(want)
    says = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert all(r["verdict"] == says[r["rule"]] for r in rows if r["rule"]) and {r["rule"] for r in rows} == {None, *says}
    # hosts that were never learned from: those with unwanted words are told, ordinary ones are left alone
    free = [r for r in rows if r["rule"] is None]
    learned = {r["url"].split("/")[2] for r in uf.labelled_urls(spark).collect()}
    assert not learned & {r["host"] for r in rows}
    bad = [r for r in free if any(w in r["host"] for w in ("casino-win", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track"))]
    good = [r for r in free if r not in bad]
    assert sum(r["verdict"] == "block" for r in bad) >= 0.9 * len(bad) > 0
    assert sum(r["verdict"] == "allow" for r in good) >= 0.99 * len(good) > 0


def test_hosts_that_are_held_out(spark):
    held = F.crc32(uf.host_of(F.col("url")).cast("binary")) % 4 == 2
    table = uf.labelled_urls(spark)
    tried = table.where(held).withColumn("page_id", F.monotonically_increasing_id())
    got = uf.url_filter(tried, (), table.where(~held)).join(tried, "page_id")
    right, n = got.agg(F.avg(((F.col("verdict") == "block") == F.col("blocked")).cast("int")), F.count("*")).first()
    assert n > 30 and right >= 0.9


def test_cases(spark):
    urls = [
        "https://WWW.Example.NET/en/1?x",
        "https://a.example.com/de/",
        "http://badexample.com/de/",
        "x.org/fr/1",
        None,
        "http://q.org/fr/a#b",
        "http://x.net",
        "https://blog.discount-pills.example.com/en/4",
        "https://www.theatre.example.com/en/4",
        "http://net/a",
        "",
        "http://a.org?x://y/z",
    ]
    urls += ["http://a.com/" + "x" * 100000, "http://\U0001f600.com/\U0001f600"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(None, None, None)], "page_id long, url string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in uf.url_filter(df).collect()}
    assert got[0] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("example.com/de/", "block")
    assert got[2][2] is None and got[3][:3] == ("", "", None) and got[4][:2] == ("", "") and got[5] == ("q.org", "/fr/a", "org/fr/", "allow")
    assert got[6][:3] == (
        "x.net",
        "",
        None,
    ) and got[7][3] == "block" and got[8][3] == "allow" and got[9][2:] == ("net/", "block") and got[11][:2] == ("a.org", "")
    assert len(got[12][1]) == 100001 and got[13][:2] == ("\U0001f600.com", "/\U0001f600")
    assert uf.url_filter(df.limit(0)).count() == 0
    tie = (("block", "a.com", "/x"), ("allow", "a.com", "/x"))
    assert len({r["verdict"] for r in uf.url_filter(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string"), tie).collect()}) == 1


def test_rules_beyond_the_bound_are_refused(spark):
    with pytest.raises(ValueError, match="rules"):
        uf.rule_columns((("block", "x", "/"),) * 501)
