import random
from itertools import combinations

from pyspark.sql import functions as F

from trialframe.llm import url_rules as U

URLS = [
    None, "", "no scheme", "http://", "HTTPS://A.Net/x?y#z", "http://example.net/en/1", "http://www.example.net/en", "http://example.NET/en/?q=1",
    "http://xexample.net/en/1", "http://m.example.com/de/x/y.html", "ftp://org/fr/", "http://a.org/fr/1#t", "http://a.org/FR/1", "http://net", "http://net?x/",
    "http://e.com/a://b/c", "https://free-bets.example.com/en/55?utm=1&ref=2", "http://a.net:80/", "http://ÀÉ.net/ü", "x://y\n/z\nw?q", "http://net/" + "p/" * 3000,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def rule(host, path):
    fits = []
    for r, v in U.RULES:
        h, p = r[: r.index("/")], r[r.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(r), r, v))
    return max(fits, default=(0, None, None))[1:]


def pages(spark, urls, start=0):
    rows = spark.createDataFrame([(k + start, u) for k, u in enumerate(urls)], "page_id long, url string")
    return rows.select("*", *(F.lit("other").alias(c) for c in ("id", "host", "path", "rule", "tokens", "parts", "html")))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_hosts_paths_and_fixed_rules(spark):
    urls = URLS + URLS[4:8]  # repeated rows
    got = {r["id"]: r for r in U.judge_urls(pages(spark, urls), labels(spark, [])).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path = split(url)
        name, verdict = rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, name, verdict or "allow"), url


def test_empty_pages(spark):
    assert U.judge_urls(pages(spark, []).limit(0), labels(spark, [(1, 0, 0)])).collect() == []


def test_mined_rules_against_all_token_sets(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        tokens = sorted(rng.sample("abcdefg", rng.randint(1, 5)))
        bad = ("a" in tokens and "c" in tokens and rng.random() < 0.9) or rng.random() < 0.1
        rows.append((tokens, bad))
    got = {tuple(r["parts"]): r["confidence"] for r in U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_support=0.02).collect()}
    n, poor = len(rows), sum(b for _, b in rows)
    support = max(0.02, U.MIN_COUNT / n)
    strong = {}
    for size in range(1, 6):
        for parts in combinations("abcdefg", size):
            seen = [b for t, b in rows if set(parts) <= set(t)]
            if seen and sum(seen) >= support * n - 1e-9 and sum(seen) / len(seen) >= max(U.MIN_CONFIDENCE, U.MIN_LIFT * poor / n):
                strong[parts] = sum(seen) / len(seen)
    expected = {p: c for p, c in strong.items() if not any(strong.get(tuple(x for x in p if x != drop), -1) >= c for drop in p)}
    assert got == expected and ("a", "c") in got


def test_mined_rules_block_hosts_that_labels_call_bad(spark):
    urls = [f"http://{'spam-shop' if k % 4 == 0 else 'good%d' % (k % 7)}.example.info/{k}" for k in range(400)]
    said = [(k, 0 if k % 4 == 0 else 1, 0) for k in range(200)] + [(5, None, None), (None, 0, 1)]
    got = U.judge_urls(pages(spark, urls), labels(spark, said)).collect()
    assert all((r["verdict"] == "block") == ("spam-shop" in r["host"]) for r in got)
    assert all(r["confidence"] > 0.9 for r in got if r["verdict"] == "block")


def test_matches_need_every_token(spark):
    rules = spark.createDataFrame([(["a", "b"],), (["c"],)], "parts array<string>")
    urls = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b", "x"]), ("3", ["c", "a"]), ("4", [])], "url string, tokens array<string>")
    assert {(r["url"], tuple(r["parts"])) for r in U.matches(rules, urls).collect()} == {("2", ("a", "b")), ("3", ("c",))}
