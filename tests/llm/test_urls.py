import random
import re
import time
from itertools import combinations

from postmill.llm import urls


def by_hand(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[2].translate({i: i + 32 for i in range(65, 91)}), m[3]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


URLS = [
    "http://A.Example.ORG/es/1?x=/en/1", "https://example.org/en/12#y", "http://example.org", "http://org/", "http://xorg/", "http://x.com/fr/", "http://x.com/de/q://z", "http://x.com?u=http://y.org/", None, "", "no scheme", "://h/p", "http://É.org/a",
    "HTTP://notexample.org/es/", "http://example.org/en/", "http://a.example.org/es",
]


def test_hosts_paths_and_listed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)], "page_id long, url string, host string, key int")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    for r in urls.judge(pages, labels).collect():
        host, path, (rule, verdict) = by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == (verdict or "allow")


def test_mined_rules_find_what_labels_show(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'win' if bad else 'news'}.example.net/{'casino' if bad else 'story'}/{i}"))
        if i < 300:
            labels.append((i, bad))
    rows.append((400, "http://win.example.net/other/5"))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*labels, (0, None), (0, True)], "page_id long, block boolean"))
    verdicts = {r.page_id: r.verdict for r in got.collect()}
    assert all(verdicts[i] == ("block" if i % 4 == 0 else "allow") for i in range(400)) and verdicts[400] == "block"
    assert {r.taught for r in got.collect()} == {"labels", None}


def test_matching_is_containment(spark):
    sets = [["a", "b", "c"], ["a"], ["b", "c"], [], ["c", "d", "e"]]
    rules = [(1, ["a", "b"], 0.6), (2, ["c"], 0.7), (3, ["a", "d"], 0.9)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "key long, tokens array<string>")
    got = {r.key: r.confidence for r in urls.match(df, spark.createDataFrame([(r, s, s[-1], c, "list") for r, s, c in rules], "rule long, items array<string>, rare string, confidence double, taught string")).collect()}
    want = {i: max(c for _, r, c in rules if set(r) <= set(s)) for i, s in enumerate(sets) if any(set(r) <= set(s) for _, r, _ in rules)}
    assert got == want


def token_set(url):
    host, path, _ = by_hand(url)
    labels = host.split(".")
    found = {"scheme=" + url.split("://")[0], *("host=" + ".".join(labels[i:]) for i in range(len(labels)))}
    found |= {"path=" + re.sub("[0-9]+", "0", s) for s in path.split("/")} | {"key=" + k for k in re.findall(r"[?&]([^=&#]*)", url)}
    return {t for t in found if not t.endswith("=")}


def mined_by_hand(rows, count, confidence, z):
    """Every set of tokens tried, for small vocabularies: the blocked share of the URLs that a URL's rules promise."""
    sets = [(token_set(u), b) for u, b in rows]
    base = sum(b for _, b in rows) / len(rows)
    tokens = sorted({t for s, _ in sets for t in s if sum(t in x for x, _ in sets) >= count})
    rules = {}
    for size in range(1, len(tokens) + 1):
        for body in combinations(tokens, size):
            if sum(t.startswith("host=") for t in body) > 1:
                continue
            hit = [b for s, b in sets if set(body) <= s]
            if sum(hit) >= count and sum(hit) / len(hit) >= confidence and sum(hit) / len(hit) - base >= z * (base * (1 - base) / len(hit)) ** 0.5:
                rules[frozenset(body)] = sum(hit) / len(hit)
    return rules


def test_mined_rules_judge_like_all_rules(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        deep = rng.random() < 0.4
        host = ("a.b.c.d.e.f.g.h.example.net" if deep else rng.choice(["x.example.net", "y.example.com"]))
        path = rng.choice(["casino", "story"]) + rng.choice(["", "/win"])
        url = f"http{'s' * (i % 2)}://{host}/{path}/{i}" + rng.choice(["", "?ref=1"])
        rows.append((url, rng.random() < (0.9 if "casino/win" in url and deep else 0.7 if "ref" in url and "casino" in url else 0.1)))
    limits = {"count": 12, "confidence": 0.5, "z": 3.0}
    df = spark.createDataFrame([(sorted(token_set(u)), b) for u, b in rows], "tokens array<string>, block boolean")
    got = {frozenset(r.names): r.confidence for r in urls.mine(df, support=0.0, **limits).collect()}
    want = mined_by_hand(rows, **limits)
    assert got and all(abs(want[r] - c) < 1e-9 for r, c in got.items())

    def best(rules, s):
        return round(max((c for r, c in rules.items() if r <= s), default=0), 9)

    assert all(best(got, token_set(u)) == best(want, token_set(u)) for u, _ in rows)


def test_rules_of_tokens_that_tell_little_by_themselves_among_many(spark):
    """40 keys in a chain tell more than u and v, which tell only together: no token of a URL is left out, though the chain's keys make 2^40 sets."""
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        depth, u, v = rng.randint(0, 40), rng.random() < 0.3, rng.random() < 0.3
        keys = [f"t{j}" for j in range(depth)] + ["u"] * u + ["v"] * v
        rows.append((token_set("http://x.net/p?" + "&".join(keys)), rng.random() < (0.95 if u and v else 0.15 + 0.02 * depth)))
    limits = {"count": 20, "confidence": 0.6, "z": 3.0}
    got = {frozenset(r.names): r.confidence for r in urls.mine(spark.createDataFrame([(sorted(s), b) for s, b in rows], "tokens array<string>, block boolean"), support=0.0, **limits).collect()}
    base, want = sum(b for _, b in rows) / len(rows), {}
    for last in [None, *range(40)]:
        for pair in ((), ("key=u",), ("key=v",), ("key=u", "key=v")):
            body = frozenset(pair if last is None else (*pair, f"key=t{last}"))
            hit = [b for s, b in rows if body <= s]
            if sum(hit) >= limits["count"] and sum(hit) / len(hit) >= limits["confidence"] and sum(hit) / len(hit) - base >= limits["z"] * (base * (1 - base) / len(hit)) ** 0.5:
                want[body] = sum(hit) / len(hit)
    assert frozenset(("key=u", "key=v")) in got and any(len(r) == 3 for r in got)
    for s, _ in rows:
        assert max((c for r, c in got.items() if r <= s), default=0) == max((c for r, c in want.items() if r <= s), default=0)


def test_many_tokens_that_stand_apart_mine_like_all_sets(spark):
    """13 keys that stand independently in the URLs: all sets of them, tried one by one."""
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        keys = [f"k{j}" for j in range(13) if rng.random() < 0.75]
        rows.append(("http://x.net/?" + "&".join(keys), rng.random() < (0.9 if {"k1", "k2", "k3"} <= set(keys) else 0.2)))
    limits = {"count": 20, "confidence": 0.6, "z": 2.0}
    df = spark.createDataFrame([(sorted(token_set(u)), b) for u, b in rows], "tokens array<string>, block boolean")
    got = {frozenset(r.names): r.confidence for r in urls.mine(df, support=0.0, **limits).collect()}
    sets, tokens, want = [(token_set(u), b) for u, b in rows], [f"key=k{j}" for j in range(13)], {}
    base = sum(b for _, b in sets) / len(sets)
    for size in range(1, 14):
        for body in map(frozenset, combinations(tokens, size)):
            hit = [b for s, b in sets if body <= s]
            if sum(hit) >= limits["count"] and sum(hit) / len(hit) >= limits["confidence"] and sum(hit) / len(hit) - base >= limits["z"] * (base * (1 - base) / len(hit)) ** 0.5:
                want[body] = sum(hit) / len(hit)
    improving = {r: c for r, c in want.items() if not any(q < r and d >= c for q, d in want.items())}
    assert len(want) > 20 and got == improving


def test_deep_hosts_paths_and_long_urls_mine_quickly(spark):
    host, path = ".".join(f"l{i}" for i in range(30)), "/".join(f"p{i}x" for i in range(30))
    rows = [(i, f"http://{host}.net/{path}/{i}?" + "&".join(f"k{j}=1" for j in range(i % 25))) for i in range(100)] + [(i, f"http://other{i}.net/q") for i in range(100, 200)]
    rows += [(200, "http://" + "a." * 50_000 + "net/" + "s/t/" * 50_000), (201, "http://x.net/?" + "&".join(f"k{j}" for j in range(30_000)))]
    labels = [(i, i < 100) for i in range(200)]
    began = time.perf_counter()
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, block boolean")).collect()}
    assert all(got[i] == ("block" if i < 100 else "allow") for i in range(200)) and len(got) == 202
    assert time.perf_counter() - began < 120


def test_the_list_teaches_the_rules(spark):
    rows = [(i, f"http://h{i}.example.{'org' if i % 2 else 'net'}/{'es' if i % 3 else 'xx'}/{i}") for i in range(240)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([], "page_id long, block boolean")).collect()}
    for i, r in got.items():
        assert r.verdict == ("block" if i % 3 else "allow") and (r.confidence is not None) == (i % 2 == 0 and i % 3 > 0)
        assert r.taught == ("list" if r.confidence is not None else None)


def test_labels_and_list_teach_each_by_itself(spark):
    """A few labels teach what they show though the list judges many more pages otherwise; where both fit, labels are named."""
    rows = [(i, f"http://h{i}.example.org/fr/{i}") for i in range(2000)] + [(i, f"http://h{i}.bad.net/fr/{'x' if i % 2 else 'y'}/{i}") for i in range(2000, 2100)]
    labels = [(i, i >= 2000) for i in range(1900, 2060)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, block boolean")).collect()}
    assert all((got[i].verdict, got[i].taught) == (("block", "labels") if i >= 2000 else ("allow", None)) for i in got)


def test_query(spark, sf_dir):
    found = {r.page_id: r for r in urls.op4_url_filters(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        host, path, (rule, verdict) = by_hand(p.url)
        r = found[p.page_id]
        assert (r.taught is None) == (r.confidence is None) and (r.verdict == "block" or r.taught is None)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (rule is None or r.verdict == verdict)
