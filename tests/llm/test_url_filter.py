import random
import re

from sluice.llm import url_filter
from sluice.llm.components import components


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule(host, path):
    fit = [(len(h + p), a == "allow", h + p) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=None)


def address(url):
    host, _ = parts(url)
    return host + re.match(r"[^/?#]*([^#]*)", url.split("://", 1)[1], re.S)[1] if host else None


def brute(rows, edges):
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for a, b in edges:
        group[find(a)] = find(b)
    decided = {}
    for x in list(group):
        if r := rule(*parts("x://" + x)):
            decided.setdefault(find(x), set()).add(r[1])
    out = []
    for i, url in rows:
        host, path = parts(url)
        r, key = rule(host, path), address(url) if url and "://" in url else None
        said = decided.get(find(key)) if key in group else None
        allow = r[1] if r else (True in said if said else True)
        out.append((i, host, path, r[2] if r else None, "allow" if allow else "block", r is None and bool(said)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    r = random.Random(5)
    hosts = ["a.example.com", "Example.COM", "b.net", "example.net", "x.example.net", "y.org", "z.other", "example.net:80"]
    paths = ["/en/71", "/en/8", "/de/8", "/de/9", "/es/1", "/", "", "/q?x=1", "?a/b", "#top", "/en/7?x=/de/", "/EN/7"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(150)]
    pages, rows, edges = [], [], []
    for i, url in enumerate(urls):
        to = r.choice(urls)
        html = r.choice(["<p>x</p>", f'<LINK href="{to}" rel="Canonical">', f"<meta http-equiv='refresh' content='0; URL={to}'>", f"<link rel=canonical href={to}>", f'<link rel="next" href="{to}">', None])
        if html and ("anonical" in html or "refresh" in html) and address(url) != address(to):
            edges.append((address(url), address(to)))
        pages.append((i, url, html, "extra"))
        rows.append((i, url))
    for i, url in ((900, None), (901, "no scheme"), (901, "no scheme"), (902, ""), (None, "http://b.net/de/8"), (903, "a://b://c")):
        pages.append((i, url, None, "extra"))
        rows.append((i, url))
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")).collect()
    assert sorted([tuple(x) for x in found], key=str) == brute(rows, edges)


def test_relative_references(spark):
    base = "http://h.org/a/b?x#y"
    for to, want in (("/c", "h.org/c"), ("c", "h.org/a/c"), ("//g.net/z#f", "g.net/z"), ("?q=1", "h.org/a/b?q=1"), ("https://h.org/a/b?x", None)):
        page = spark.createDataFrame([(1, base, f'<link rel="canonical" href="{to}"/>')], "page_id long, url string, html string")
        assert [x.b for x in url_filter.alias_edges(page).collect()] == ([want] if want else [])


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (1, 0), (None, 3)]
    group = {}
    find = lambda x: x if group.setdefault(x, x) == x else find(group[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in group}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
