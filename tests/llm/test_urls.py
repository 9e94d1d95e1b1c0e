import random

from pyspark.sql import functions as F

from rallyframe.llm import queries, urls

RULES = "host string, path string, verdict string"


def brute(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(-len(h + p), -len(h), h + p, v != "block", v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best[2] if best else None, best[4] if best else default


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "RANGE_ROWS", 60)
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "net", "a.b.net", "b.net", "xcom", "example.comx", "spam-farm.example.org", "é.org", "EXAMPLE.com"]
    paths = ["", "/", "/en/", "/en/7", "/en/77.html", "/de", "/EN/"]
    data = [(i, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/b#c', '#x?y'])}") for i in range(500)]
    data += [(600, None), (601, ""), (602, "example.com/en/7"), (603, "http://"), (604, "a://b://c/d"), (605, "http://x.com/" + "p" * 100_000), (0, data[0][1]), (None, "http://example.com/en/7"), (606, "http://a\nb.com/x\ny")]
    data += [(1000 + i, "http://hot.example.com/en/") for i in range(300)]
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/", "block"), ("b.net", "", "allow"), ("b.net", "", "block"), ("example.com", "", "block"), ("é.org", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("com", "/en/", "block")]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = urls.filter_urls(df, spark.createDataFrame(rules, RULES)).collect()
    want = [(i, *brute(u, rules, "allow")) for i, u in data]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], RULES)
    page = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in urls.filter_urls(page, none, "block").collect()] == [(1, "a.b", "/c", None, "block")]
    assert urls.filter_urls(page.limit(0), none).count() == 0


def test_rules_of_the_query(spark, tmp_path):
    """The query's rules as its contract lists them: a page for each, a longer and a foreign one beside them."""
    urls_of = ["http://a.com/en/1", "http://example.com/en/7", "http://b.net/de/8", "http://example.net/de/7", "http://www.example.net/de/81", "http://c.org/es/", "http://c.org/en/"]
    spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op8_url_filter(spark, str(tmp_path)).orderBy("page_id").select("rule", "verdict").collect()
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]
    assert list(map(tuple, got)) == want
