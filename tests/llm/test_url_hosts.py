"""Hosts of op7: names, addresses and unlabelled hosts, and its SQL on a fixture that has them."""

import duckdb
from pyspark.sql import functions as F

from ledgermill.llm import url_filter
from ledgermill.llm.oracles import ORACLES

HOSTS = {"a.b.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:8080": ("x.com", "com"), "me:pw@www.x.com.": ("x.com", "com"),
         "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "host": ("host", "host"), "": ("", "")}


def test_domains_and_suffixes(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host string").select(
        "host", url_filter.domain_of(F.col("host")).alias("d"), url_filter.suffix_of(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == HOSTS


def test_sql_agrees_on_unlabelled_hosts(spark):
    hosts = [*HOSTS, "bad.org", "new.bad.org", "bad.org:81", "other.org", "good.uk", "x.good.uk", "nowhere.xyz", "10.0.0.2", "u@10.0.0.1"]
    pages = [(i, f"http://{h}/p{i}") for i, h in enumerate(hosts)] + [(90, None), (91, "no url"), (92, "http://bad.org/p9"), (92, "http://bad.org/p9")]
    bad, good = hosts.index("bad.org"), hosts.index("good.uk")
    labels = [(bad, 0, 1)] * 900 + [(good, 1, 0)] * 300 + [(hosts.index("10.0.0.1"), None, 1)] * 60 + [(92, None, None), (None, 0, 1), (500, 0, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    expected = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLES['op7_url_filter']})").fetchall()
    found = [tuple(r) for r in url_filter.verdicts(p, t).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    verdicts = {r[1]: r[4] for r in found}
    assert [verdicts[h] for h in ("bad.org", "new.bad.org", "bad.org:81", "other.org", "10.0.0.1:80", "x.good.uk", "")] == [
        "block", "block", "block", "block", "block", "allow", "allow"]
