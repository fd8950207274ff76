import re

from synthscope.llm import urls

PAGES = [
    (1, "https://A.Example.NET/en/1?x#y", '<a href="https://bad.net/x">x</a>'), (2, "http://a.example.net/de/1", None), (3, "http://example.com/de/1", ""), (4, "http://x.example.com/en/", '<a class=q href="//BLOG.site.com/p">'),
    (5, "http://shop.org/fr/", '<a href="http://liked.com/">a</a><a href=http://liked.com/2>'), (6, "http://linker.com/", '<p><a href="http://bad.net/">b</a>'), (7, "http://liked.com/z", ""), (8, None, "x"), (9, "no host", "x"), (10, "", None),
    (11, "x://", None), (12, "http://net", None), (13, "http://net/", None), (14, "http://notnet/", None), (15, "http://liked.com?x=/a", None), (15, "http://liked.com?x=/a", None), (None, "ftp://user@h.org:80/fr/a#b", None), (16, "http://a\nb.net/c\nd", None), (17, "http://bad.net/", None),
]


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def slow_rank(links, seeds, damping, rounds):
    score = dict(seeds)
    for _ in range(rounds):
        new = {h: (1 - damping) * s for h, s in seeds.items()}
        for h, s in score.items():
            out = [b for a, b in links if a == h]
            for b in out:
                new[b] = new.get(b, 0) + damping * s / len(out)
        score = new
    return score


def test_matches_brute_force(spark):
    frame = spark.createDataFrame([(*p, "r") for p in PAGES], "page_id long, url string, html string, rule string").repartition(3)
    got = sorted((tuple(r) for r in urls.judge_urls(frame).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()), key=str)
    parts = [(i, *slow_parts(u), h) for i, u, h in PAGES]
    ruled = []
    for i, host, path, html in parts:
        fits = [r for r in urls.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        ruled.append((i, host, path, best and best[1] + best[2], best and best[0], html))
    links = {(h, x.lower()) for _, h, _, _, _, html in ruled if h for x in re.findall(r"""href=["']?(?:https?:)?//([^/"'\s>?#]+)""", html or "") if x.lower() != h}
    score = {}
    for kind, edges in (("allow", links), ("block", {(b, a) for a, b in links})):
        of = [h for _, h, _, _, v, _ in ruled if v == kind and h]
        score[kind] = slow_rank(edges, {h: of.count(h) / len(of) for h in set(of)}, urls.DAMPING, urls.ROUNDS)
    want = []
    for i, h, p, r, v, _ in ruled:
        good, bad = score["allow"].get(h, 0.0), score["block"].get(h, 0.0)
        want.append((i, h, p, r, v or ("block" if bad > good else "allow"), round(good, 9), round(bad, 9)))
    assert [(*g[:5], round(g[5], 9), round(g[6], 9)) for g in got] == sorted(want, key=str)
    verdict = {g[0]: g[4] for g in got}
    assert verdict[6] == "block" and verdict[7] == "allow"  # links to the blocked; is linked by the trusted


def test_without_links_and_empty(spark):
    frame = spark.createDataFrame([(1, "http://a.net/", None), (2, "http://b.com/", "<p>")], "page_id long, url string, html string")
    assert sorted(tuple(r)[:5] for r in urls.judge_urls(frame).collect()) == [(1, "a.net", "/", "net/", "block"), (2, "b.com", "/", None, "allow")]
    assert urls.judge_urls(frame.limit(0)).collect() == []
