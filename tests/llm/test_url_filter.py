import re

from lodestone.llm import url_filter
from lodestone.llm.queries import URL_RULES, op8_url_filter
from lodestone.llm.registry import oracle_sql
from tests.oracle import SMALL, ask, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def by_rules(host, path, rules):
    fits = []
    for verdict, rule in rules:
        own, slash, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def mined_rules(baskets):
    """Every combination by counting subsets, as mine() defines rules."""
    from itertools import combinations

    n, both, alone = len(baskets), {}, {}
    for tokens, verdict in baskets:
        for size in range(1, len(tokens) + 1):
            for s in combinations(sorted(tokens), size):
                alone[s] = alone.get(s, 0) + 1
                both[s, verdict] = both.get((s, verdict), 0) + 1
    least = max(url_filter.MIN_SUPPORT * n, url_filter.MIN_COUNT)
    found = {(s, v): (k / alone[s], k) for (s, v), k in both.items() if k >= least and k / alone[s] >= url_filter.MIN_CONFIDENCE}
    return {(s, v): x for (s, v), x in found.items() if not any(v == w and y[0] >= x[0] and set(t) < set(s) for (t, w), y in found.items())}


def expected(pages, rules):
    parts = {i: split(u) for i, u in pages}
    told = {i: by_rules(*x, rules) for i, x in parts.items()}

    def tokens(host, path):
        return {f"host:{x}" for x in re.split(r"[.\-]", host) if x} | {f"path:{x}" for x in re.split(r"[/.\-_]", path.translate(LOWER)) if x and not x.isdigit()}

    baskets = [(tokens(*parts[i]), told[i][1]) for i, _ in pages if told[i][0]]
    mined = mined_rules(baskets) if baskets else {}
    out = {}
    for i, (host, path) in parts.items():
        rule, verdict = told[i]
        if not rule:
            hits = [(conf, k, len(s), v) for (s, v), (conf, k) in mined.items() if set(s) <= tokens(host, path)]
            verdict = max(hits)[-1] if hits else "allow"
        out[i] = host, path, rule, verdict
    return out


def rows(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = rows(op8_url_filter(spark, "/root/testdata/sf0.01"))
    assert got == expected(pages, URL_RULES)
    assert {v[3] for v in got.values()} == {"allow", "block"}


def test_cases(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/1", "http://example.com/EN/", "http://notexample.com/en/1",
        "http://x.net/es/1", "http://net/fr/", "http://net.org/fr/", "ftp://h.com?x=/en/", "http://h.com#/p", "http://ünï.com/ä/b", "http://a\nb.net/es/\n1", "http://x.net/es", "http://u@h:80/p://q",
    ]
    pages = list(enumerate(urls))
    frame = spark.createDataFrame(pages, "page_id bigint, url string").selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS rule", "'c' AS verdict", "'c' AS tokens")
    assert rows(url_filter.url_filter(frame, URL_RULES)) == expected(pages, URL_RULES)


def test_rules_by_confidence_and_support(spark):
    good = [(i, f"http://site{i % 9}.org/news/{i}") for i in range(200)]
    bad = [(1000 + i, f"http://win-cash{i % 9}.biz/casino/{i}") for i in range(200)]
    unknown = [(5000, "http://other.info/casino/1"), (5001, "http://other.info/news/1"), (5002, "http://plain.info/")]
    frame = spark.createDataFrame(good + bad + unknown, "page_id bigint, url string")
    rules = [("allow", "org/"), ("block", "biz/")]
    got = rows(url_filter.url_filter(frame, rules))
    assert [got[i][3] for i in (5000, 5001, 5002)] == ["block", "allow", "allow"]
    assert got == expected(good + bad + unknown, rules)


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.url_filter(frame, URL_RULES).count() == 0


def test_query_equals_sql(spark):
    same(op8_url_filter(spark, SMALL).toPandas(), ask(oracle_sql()["op8_url_filter"]))


def test_random_baskets(spark, monkeypatch):
    """Few words in many orders: classes, sure tokens and mixed combinations against counted subsets."""
    import random

    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    for seed in range(3):
        rng = random.Random(seed)
        pages = []
        for i in range(600):
            tld = rng.choice(["org", "biz", "info"])
            words = [w for w in "abcdef" if rng.random() < 0.4] + (["pair-one", "pair-two"] if rng.random() < 0.3 else [])
            words.append("x" if rng.random() < {"biz": 0.95, "org": 0.05, "info": 0.5}[tld] else "y")
            pages.append((i, f"http://h{rng.randrange(3)}.{tld}/{'/'.join(words)}"))
        frame = spark.createDataFrame(pages, "page_id bigint, url string")
        rules = [("allow", "org/"), ("block", "biz/")]
        got = rows(url_filter.url_filter(frame, rules))
        assert got == expected(pages, rules)
        assert len({v[3] for i, v in got.items() if v[2] is None}) == 2


def test_long_urls_repeated(spark):
    """Forty tokens in 10,000 copies, half of the tokens shared with the other verdict's long URL."""
    import time

    slug = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    pages = spark.range(10_000).selectExpr("id AS page_id", f"concat('http://a.', if(id % 2 = 0, 'org/{'-'.join(slug)}', 'biz/{'-'.join(slug[:20])}')) AS url")
    began = time.time()
    other = spark.createDataFrame([(-1, f"http://b.info/{slug[39]}/{slug[0]}"), (-2, f"http://b.info/{slug[3]}/{slug[0]}")], pages.schema)
    got = url_filter.url_filter(pages.unionByName(other), [("allow", "org/"), ("block", "biz/")]).filter("page_id < 0").collect()
    assert {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in got} == {-1: ("allow", "host:org"), -2: ("allow", None)}  # a class is shown by its least token
    assert time.time() - began < 60
