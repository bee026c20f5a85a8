"""URL rules and their way along redirects."""

from __future__ import annotations

from conftest import TESTDATA
from helpers import Groups

from wardbook.llm import url_rules


def judged(spark, rows, **more):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    return {r.page_id: r for r in url_rules.judge(frame, **more).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.NET/en/x?y#z",
        "https://example.com/de/1",
        "https://notexample.com/de/1",
        "ftp://fr.org/fr/",
        "http://x.net",
        "http://x.net/",
        "http://x.net?/q",
        "no scheme.net/",
        "a://b.org://c.net/d",
        "http://ÄB.org/fr/é#/",
        None,
        "",
        "http://x.net:80/",
    ]
    got = judged(spark, [(i, u, None, "x") for i, u in enumerate(urls)])
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("example.com", "/de/1", "example.com/de/", "block"),
        ("notexample.com", "/de/1", None, "allow"),
        ("fr.org", "/fr/", "org/fr/", "allow"),
        ("x.net", "", None, "allow"),
        ("x.net", "/", "net/", "block"),
        ("x.net", "", None, "allow"),
        ("", "", None, "allow"),
        ("b.org:", "//c.net/d", None, "allow"),
        ("Äb.org", "/fr/é", "org/fr/", "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("x.net:80", "/", None, "allow"),
    ]


def link(target):
    return f'<html><link href="{target}" rel="canonical"></html>'


def test_blocks_travel_along_links(spark):
    rows = [
        (1, "http://a.com/1", '<link rel="canonical" href="http://a.com/2">', ""),
        (2, "http://a.com/2", '<META http-equiv=refresh content="0; url=http://bad.net/x">', ""),
        (3, "http://a.com/3", link("http://a.com/1"), ""),
        (4, "http://a.org/fr/1", link("http://bad.net/y"), ""),
        (5, "http://a.com/5", link("http://bad.net/y"), ""),
        (6, "http://a.com/6", link("/7"), ""),
        (7, "http://a.com/7", None, ""),
        (8, "http://a.com/8", "canonical refresh", ""),
        (9, "http://a.com/9", None, ""),
        (9, "http://a.com/9", None, ""),
    ]
    got = judged(spark, rows)
    # 1, 2 and 3 lead to a blocked url; 4 is allowed by its rule, and so is its alias 5.
    assert [got[i].verdict for i in range(1, 10)] == ["block"] * 3 + ["allow"] * 6
    assert got[3].component == got[1].component == "http://a.com/1"
    redirects = spark.createDataFrame(
        [("http://a.com/9", "http://z.net/")], "url string, target string"
    )
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    both = url_rules.judge(frame, redirects=redirects).where("page_id = 9").collect()
    assert [r.verdict for r in both] == ["block", "block"]


def test_blocks_reach_aliases_however_links_are_written(spark):
    bad = "http://bad.net/x"
    rows = [
        (1, "http://a.com/d/1", link("2.html"), ""),
        (2, "http://a.com/d/2.html", link(bad), ""),
        (3, "http://a.com/d/e/3", link("../2.html#top"), ""),
        (4, "http://a.com/d/4?id=1", link("?id=2"), ""),
        (5, "http://a.com/d/4?id=2", link("./2.html"), ""),
        (6, "http://a.com/6", link("/7?a=1&amp;b=2&copy=3"), ""),
        (7, "http://a.com/7?a=1&b=2&copy=3", link(bad), ""),
        (8, "http://A.com/8#part", None, ""),
        (9, "http://a.com/9", link("HTTP://a.COM/8") + link(bad), ""),
        (10, "http://a.com/10", '<meta http-equiv="refresh" content="9">'
         '<meta http-equiv="refresh" content="0; url=d/2.html">', ""),
        (11, "http://a.com/11", link("mailto:x@bad.net") + link("#x") + link("login?to=http://bad.net/x"), ""),
        (12, "no scheme", link("2.html"), ""),
    ]
    got = judged(spark, rows)
    assert [got[i].verdict for i in range(1, 13)] == ["block"] * 10 + ["allow"] * 2
    assert got[8].component == got[9].component == "http://a.com/10"
    assert got[8].url == "http://A.com/8#part"


def test_targets_are_resolved():
    page = "http://h.com/a/b/c?q#f"
    known = {
        "d": "http://h.com/a/b/d", "./d": "http://h.com/a/b/d", "../d?x#y": "http://h.com/a/d?x#y",
        "..": "http://h.com/a/", "../../../d": "http://h.com/d", "?y": "http://h.com/a/b/c?y",
        "/x/../d": "http://h.com/d", "//g.org/d": "http://g.org/d", "https://g.org": "https://g.org",
        "#z": None, "": None, "javascript:go()": None, "d&#47;e&#x2F;f": "http://h.com/a/b/d/e/f",
    }
    assert {t: url_rules.resolved(page, t) for t in known} == known
    assert url_rules.resolved("http://h.com", "d") == "http://h.com/d"
    assert url_rules.resolved("no scheme", "d") is None


def test_no_pages(spark):
    assert judged(spark, []) == {}


def test_addresses_and_tags_as_browsers_read_them(spark):
    """Each page leads to a blocked one in another way of writing; the odd ones lead nowhere."""
    blocked = "http://bad.net/x"
    pages = {
        "http://a.com": '<link rel=canonical href="http://bad.net/x">',
        "http://b.com:80/": link(blocked),
        "http://c.com/1": f'<link data-href="/no" href="{blocked}" rel="canonical">',
        "http://d.com/1": '<base href="http://bad.net/"><link rel="canonical" href="x">',
        "http://e.com/1": f'<link rel="alternate canonical" href="{blocked}">',
        "http://f.com/1": f'<link title="a > b" rel="canonical" href="{blocked}">',
        "http://g.com/1": f'<meta http-equiv="refresh" content="0;{blocked}">',
        "http://h.com/1": f"<meta content=\"5; URL='{blocked}'\" http-equiv=refresh>",
        "http://i.com/1": '<META HTTP-EQUIV = "Refresh" CONTENT = "0;url=http://BAD.net:80/x#part">',
        "http://j.com/1": link("HTTP://BAD.NET/x"),
    }
    aliases = {"http://a.com/": "http://a.com", "http://b.com": "http://b.com:80/"}
    nowhere = {
        "http://k.com/1": f'<!-- <link rel="canonical" href="{blocked}"> -->',
        "http://l.com/1": f'<script>var x = \'<link rel="canonical" href="{blocked}">\'</script>',
        "http://m.com/1": f'<linkx rel="canonical" href="{blocked}">',
        "http://n.com/1": f'<link rel="canonicals" href="{blocked}">',
        "http://o.com/1": '<meta http-equiv="refresh" content="30">',
        "http://p.com/1": f'<link rel="canonical" data-href="{blocked}">',
        "http://q.com/1": f'<link rel="canonical" href="{blocked}',
        "http://r.com:8080/": link("http://r.com/"),
    }
    urls = [*pages, *aliases, *nowhere]
    html = {**pages, **nowhere}
    got = judged(spark, [(i, u, html.get(u), "") for i, u in enumerate(urls)])
    verdicts = {u: got[i].verdict for i, u in enumerate(urls)}
    assert {u for u, v in verdicts.items() if v == "block"} == {*pages, *aliases}


def test_very_long_pages(spark):
    filler = "<p class='x'>text & more</p>" * 40_000
    rows = [
        (1, "http://a.com/1", filler + link("http://bad.net/x") + filler, ""),
        (2, "http://a.com/2", "<!--" + filler + link("http://bad.net/x"), ""),
        (3, "http://a.com/3", "<link " * 2000 + link("http://bad.net/x"), ""),
    ]
    got = judged(spark, rows)
    assert [got[i].verdict for i in (1, 2)] == ["block", "allow"]


def test_links_over_all_pages_against_plain_components(spark):
    """Chains, cycles and rings of redirects derived from the given pages."""
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()]
    urls = sorted({u for _, u in rows if u})
    edges = []
    for i, url in enumerate(urls):
        if i % 3 and i % 17:
            edges.append((url, urls[i - 1]))  # chains
        if i % 29 == 0:
            edges.append((url, urls[(i * 7) % len(urls)] + "#x"))
        if i % 41 == 0:
            edges += [(url, f"http://ring.example/{i}"), (f"http://ring.example/{i}", url)]
    plain = Groups([])
    own = {}

    def key(url):
        url = url.split("#")[0]
        scheme, _, rest = url.partition("://")
        host, slash, path = rest.partition("/")
        host, mark, query = (host.partition("?") if "?" in host else (host, "", ""))
        return f"{scheme}://{host}".lower() + ("/" + path if slash else "/" + mark + query)

    def rule(url):
        host = url.partition("://")[2]
        host, path = (host.split("/", 1) + [None])[:2]
        path = "/" + path.split("?")[0].split("#")[0] if path is not None else ""
        host = host.split("?")[0].lower()
        fits = [
            r for r in url_rules.RULES
            if ("." + host).endswith("." + r.host) and path.startswith(r.path)
        ]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    for a, b in edges:
        for u in (a, b):
            plain.parent.setdefault(key(u), key(u))
            own[key(u)] = rule(key(u))
        plain.join(key(a), key(b))
    members = {}
    for node in plain.parent:
        members.setdefault(plain.find(node), set()).add(own[node])
    expected = {}
    for page_id, url in rows:
        verdict = rule(url) if url and "://" in url else None
        if verdict is None and url and key(url) in plain.parent:
            seen = members[plain.find(key(url))]
            verdict = "block" if "block" in seen and "allow" not in seen else None
        expected[page_id] = verdict or "allow"
    redirects = spark.createDataFrame(edges, "url string, target string")
    found = {r.page_id: r.verdict for r in url_rules.judge(pages, redirects=redirects).collect()}
    without = {r.page_id: r.verdict for r in url_rules.judge(pages).collect()}
    assert found == expected and found != without
