import random

from riskloom.llm import url_filters as uf

SCHEMA = "page_id bigint, url string, html string, component string, rule string"
URLS = {
    1: "http://Example.ORG/es/x?y#z", 2: "https://a.example.org/en/12", 3: "https://example.org/en/2", 4: "http://notexample.org/es/",
    5: "ftp://x.com/fr/a", 6: "x.com/de/a", 7: "http://x.com/de/a", 8: "http://x.com", 9: None, 10: "", 11: "http://x.org?/es/", 12: "a://b://com/de/",
    13: "http://org/", 14: "http://ÄX.com/fr/", 15: "http://com/fr/#" + "q" * 100_000,
}
WANT = {
    1: ("example.org", "/es/x", "example.org/es/", "block"), 2: ("a.example.org", "/en/12", "example.org/en/1", "block"),
    3: ("example.org", "/en/2", "org/", "allow"), 4: ("notexample.org", "/es/", "org/", "allow"), 5: ("x.com", "/fr/a", "com/fr/", "allow"),
    6: ("", "", None, "allow"), 7: ("x.com", "/de/a", "com/de/", "block"), 8: ("x.com", "", None, "allow"), 9: ("", "", None, "allow"),
    10: ("", "", None, "allow"), 11: ("x.org", "", None, "allow"), 12: ("b:", "//com/de/", None, "allow"), 13: ("org", "/", "org/", "allow"),
    14: ("Äx.com", "/fr/", "com/fr/", "allow"), 15: ("com", "/fr/", "com/fr/", "allow"),
}


def judged(spark, rows):
    pages = spark.createDataFrame([(i, u, h, None, "clash") for i, u, h in rows], SCHEMA)
    return uf.judge(pages, uf.alias_edges(pages)).collect()


def test_rules_by_longest_fit(spark):
    rows = [(i, u, None) for i, u in URLS.items()]
    got = judged(spark, rows + rows[:1])
    assert len(got) == len(URLS) + 1
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == WANT
    assert judged(spark, []) == []


def test_decisions_reach_aliases(spark):
    canonical = lambda to: f'<html><LINK href="{to}" rel="canonical"></html>'
    refresh = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [
        (1, "http://x.com/de/a", None),  # blocked
        (2, "http://alias.net/1", canonical("http://x.com/de/a#top")),
        (3, "http://alias.net/2", refresh("/1")),
        (4, "http://other.net/1", canonical("http://example.org/es/b")),  # to a blocked address that is no page
        (5, "http://other.net/2", refresh("http://other.net/1")),
        (6, "http://mixed.net/1", canonical("http://x.com/de/c")),
        (7, "http://mixed.net/2", canonical("http://mixed.net/1")),
        (8, "http://x.org/fine", refresh("http://mixed.net/2")),  # allowed, and so are its aliases without a rule
        (9, "http://x.com/de/c", None),
        (10, "http://alone.net/", canonical("http://alone.net/")),
        (11, "http://alias.net/2#part", None),
    ]
    got = {r.page_id: (r.verdict, r.via) for r in judged(spark, rows)}
    assert got == {
        1: ("block", "rule"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("block", "alias"), 5: ("block", "alias"), 6: ("allow", "alias"),
        7: ("allow", "alias"), 8: ("allow", "rule"), 9: ("block", "rule"), 10: ("allow", "default"), 11: ("block", "alias"),
    }


def test_links_are_resolved_against_the_page(spark):
    links = {"//h.com/p": "http://h.com/p", "/p?a=1&amp;b=2": "http://d.net/p?a=1&b=2", "q": "http://d.net/a/q", "https://e.com/#x": "https://e.com/"}
    rows = [(i, f"http://d.net/a/{i}", f"<link rel='canonical' href='{to}'>", None, None) for i, to in enumerate(links)]
    got = {(r.a, r.b) for r in uf.alias_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(f"http://d.net/a/{i}", to) for i, to in enumerate(links.values())}


def test_addresses_are_folded_and_resolved(spark):
    want = {
        "HTTP://A.Net/B/../c/./d#x": "http://a.net/c/d", "http://a.net/../..": "http://a.net/", "http://a.net/x/.": "http://a.net/x/", "http://a.net/a/b/..": "http://a.net/a/",
        "http://a.net/a/../../b?q=/../x": "http://a.net/b?q=/../x", "http://a.net": "http://a.net", "/../no/./origin": "/../no/./origin", "http://A.net?Q=A/../B": "http://a.net?Q=A/../B",
        "http://a.net/.hidden/..x/": "http://a.net/.hidden/..x/", "": "", None: None, "http://a.net//x//../y": "http://a.net//x/y",
    }
    frame = spark.createDataFrame([(u,) for u in want], "url string")
    assert {r.url: r.node for r in frame.select("url", uf.address(frame.url).alias("node")).collect()} == want


def test_all_links_of_a_page_and_lists_of_rel(spark):
    html = """<link rel="alternate canonical" href="/one"><link rel='nofollow  canonical x' href='two/../three'><link rel=canonical href=//H.com/FOUR>
        <link rel="noncanonicals" href="/no"><meta http-equiv=refresh content="1; url=../five"><link rel="alternate" href="/canonical">"""
    pages = spark.createDataFrame([(1, "http://d.net/a/b", html, None, None)], SCHEMA)
    assert {r.b for r in uf.alias_edges(pages).collect()} == {"http://d.net/one", "http://d.net/a/three", "http://h.com/FOUR", "http://d.net/five"}


def test_components_and_precedence_equal_brute_force(spark):
    """Random pages with links, some to addresses that are no page; every page against all addresses that it reaches."""
    rng = random.Random(5)
    hosts = ["x.com", "a.example.org", "example.org", "other.net", "more.net", "y.org"]
    paths = ["/de/1", "/fr/2", "/es/3", "/en/1", "/en/2", "/", "/p/q"]
    nodes = [f"http://{h}{p}" for h in hosts for p in paths]
    rows, edges = [], []
    for i in range(90):
        url = rng.choice(nodes)
        to = [rng.choice(nodes) for _ in range(rng.choice([0, 0, 0, 1, 1, 2]))]
        html = "".join(f'<link rel="canonical" href="{x}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={x}">' for x in to)
        rows.append((i, url, html or None))
        edges += [(url, x) for x in to]
    part = {n: n for n in nodes}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in edges:
        part[root(a)] = root(b)

    def rule(url):
        host, path = url.split("://")[1].split("/", 1)
        fits = [(len(r), v) for v, r in uf.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and f"/{path}".startswith("/" + r.split("/", 1)[1])]
        return max(fits)[1] if fits else None

    linked = {n for e in edges for n in e}

    def verdict(url):
        own = rule(url)
        if own:
            return own, "rule"
        found = {rule(n) for n in linked if root(n) == root(url)} if url in linked else set()
        return ("allow", "alias") if "allow" in found else ("block", "alias") if "block" in found else ("allow", "default")

    got = {r.page_id: (r.verdict, r.via) for r in judged(spark, rows)}
    assert got == {i: verdict(u) for i, u, _ in rows}
    assert len({v for v in got.values()}) >= 4
