"""Rules by hand and mined rules against plain searches."""

import itertools
import random
import re

from pyspark.sql import functions as F

from gridmill.llm import url_filters as uf
from gridmill.llm.queries import URL_RULES, labelled_pages, op3

URLS = [
    None, "", "no scheme/x", "http://", "HTTP://WWW.Example.ORG", "http://example.org/en/1", "http://a.example.org/en/12?x=1#y", "x://example.org/es/", "http://EXAMPLE.org?q",
    "http://notexample.org/es/", "http://a.com/fr/1", "http://a.com/de/1", "http://com/de/", "http://a.net/de/", "http://é.Ünï.org/p", "http://a.org#f/x", "ftp://a://b.org/x",
]


def by_hand(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i int, url string")
    rule, said = uf.by_hand(uf.host_of(F.col("url")), uf.path_of(F.col("url")), URL_RULES)
    got = {r.i: tuple(r)[1:] for r in df.select("i", uf.host_of(F.col("url")), uf.path_of(F.col("url")), rule, said).collect()}
    assert got == {i: by_hand(u) for i, u in enumerate(URLS)}


def rules_by_hand(rows, min_rows, confidence):
    """All rules with enough support and confidence that no shorter rule does as well."""
    sets = [(set(t), y) for t, y in rows]
    tokens = sorted(set().union(*(t for t, _ in sets)))
    found = {}
    for n in range(1, 4):
        for combo in itertools.combinations(tokens, n):
            have = [y for t, y in sets if set(combo) <= t]
            for y in set(have):
                hits = have.count(y)
                if hits >= min_rows and hits / len(have) >= confidence:
                    found[combo, y] = hits / len(have)
    return {(c, y) for (c, y), v in found.items() if not any(set(d) < set(c) and z == y and w >= v for (d, z), w in found.items())}


def test_mining_and_matching(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        host, lang, q = rnd.choice(["shop", "news", "blog"]), rnd.choice(["en", "de"]), rnd.choice(["", "?ad=1"])
        bad = (host == "shop" and q) or (lang == "de" and rnd.random() < 0.85)
        rows.append((f"http://{host}.net/{lang}{q}", "block" if bad else "allow"))
    df = spark.createDataFrame([*rows, (None, "block"), ("http://x.y/z", None)], "url string, label string").repartition(4)
    rules = uf.mine(df, min_confidence=0.8).cache()
    listed = {r.url: r.t for r in df.select("url", uf.tokens_of(F.col("url")).alias("t")).filter("url IS NOT NULL").distinct().collect()}
    want = {x for x in rules_by_hand([(listed[u], y) for u, y in rows], uf.MIN_ROWS, 0.8)}
    got = {(tuple(r.tokens), r.label): r for r in rules.collect()}
    assert want <= set(got) and all(len(k[0]) > 3 for k in set(got) - want)
    urls = spark.createDataFrame([(u,) for u in {u for u, _ in rows}] + [(None,), ("nothing",)], "url string")
    for r in uf.match(urls, rules).collect():
        fits = [(g.confidence, g.support, len(t), y) for (t, y), g in got.items() if set(t) <= set(listed.get(r.url, []))]
        assert (r.found is None) == (not fits) and (not fits or (r.found.confidence, r.found.support, r.found.length, r.found.label) == max(fits))


def test_edges(spark):
    urls = spark.createDataFrame([(1, "http://a.net/x", "h", "v"), (1, "http://a.net/x", "h", "v"), (None, None, None, None)], "page_id long, url string, host string, _tokens string")
    labelled = spark.createDataFrame([], "url string, label string")
    out = uf.judge(urls, labelled, URL_RULES)
    assert out.columns == ["page_id", "url", "_tokens", "host", "path", "rule", "verdict", "mined", "confidence"]
    assert [(r.host, r.verdict, r.rule) for r in out.orderBy("page_id").collect()] == [("", "allow", None), ("a.net", "allow", None), ("a.net", "allow", None)]
    assert uf.judge(urls.limit(0), labelled, URL_RULES).count() == 0


def verdict_by_hand(tokens, rules):
    """The label of the best of ``rules`` (tokens, label -> confidence, rows) that fit, else None."""
    fits = [(c, n, len(t), y) for (t, y), (c, n) in rules.items() if set(t) <= tokens]
    return max(fits)[3] if fits else None


def mined_by_hand(rows, min_rows=20, confidence=0.8):
    """Rules over all token sets of labelled rows (tokens, label), without those that a shorter one beats."""
    found, by_set = {}, {}
    for tokens, label in rows:
        for n in range(1, len(tokens) + 1):
            for combo in itertools.combinations(sorted(tokens), n):
                by_set.setdefault(combo, []).append(label)
    for combo, have in by_set.items():
        for y in set(have):
            if have.count(y) >= min_rows and have.count(y) / len(have) >= confidence:
                found[combo, y] = (have.count(y) / len(have), have.count(y))
    return {(c, y): v for (c, y), v in found.items() if not any(set(d) < set(c) and z == y and w[0] >= v[0] for (d, z), w in found.items())}


def test_rules_that_hold_decide(spark):
    """Labels follow the host and the query here, so verdicts are those of rules mined by hand, also for a rare host."""
    rnd = random.Random(12)
    rows = [(f"http://{rnd.choice(['a', 'b', 'c'])}.net/{rnd.choice(['x', 'y'])}/{rnd.randint(1, 9)}{rnd.choice(['', '?ad=1'])}",) for _ in range(20_000)]
    rows = [(u, "block" if "?ad" in u and "a.net" in u else "allow") for (u,) in rows]
    rows += [(f"http://rare.biz/x/{i}", "block") for i in range(25)]  # 0.1 % of the rows
    rows += [(f"http://w.org/{i}", "block") for i in range(500)]  # a rule by hand decides these, so nothing is learned from them
    labelled = spark.createDataFrame(rows, "url string, label string").repartition(4)
    urls = sorted({u for u, _ in rows}) + ["http://rare.biz/new", "http://w.net/3", "http://a.net/z?ad=2", "http://new.net/", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    tokens = {r.url: set(r.t) for r in df.select("url", uf.tokens_of(F.col("url")).alias("t")).collect()}
    rules = mined_by_hand([(tokens[u], y) for u, y in rows if ".org" not in u])
    got = {r.url: r for r in uf.judge(df, labelled, URL_RULES).collect()}
    for u in urls:
        assert got[u].verdict == (by_hand(u)[3] or verdict_by_hand(tokens[u], rules) or "allow"), u
    assert got["http://rare.biz/new"].verdict == got["http://a.net/z?ad=2"].verdict == "block"
    assert got["http://w.net/3"].verdict == got["http://new.net/"].verdict == "allow"


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    urls = {r.page_id: r.url for r in pages.collect()}
    tokens = {r.url: set(r.t) for r in pages.select("url", uf.tokens_of(F.col("url")).alias("t")).collect()}
    taught = [(tokens[r.url], r.label) for r in labelled_pages(pages, spark.read.parquet(f"{sf}/labels.parquet")).collect() if by_hand(r.url)[2] is None]
    rules = mined_by_hand([x for x in taught if x[1]])
    rows = op3(spark, sf).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, said = by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (said or verdict_by_hand(tokens[urls[r.page_id]], rules) or "allow")
