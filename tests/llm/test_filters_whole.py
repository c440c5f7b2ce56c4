"""Decontamination and URL filters: cases that a short cut would lose."""

import random
import re
from collections import Counter
from urllib.parse import urljoin

from pyspark.sql import functions as F

from isoline.llm import contamination, licenses, urls


def test_small_items_are_never_missed(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(2 + k % 10))) for k in range(400)]
    docs = [(k, " ".join([*(word() for _ in range(r.randrange(60))), text, *(word() for _ in range(60))])) for k, text in items]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((x.doc_id, x.item_id) for x in contamination.find_items(df, it).collect()) == [(k, k) for k, _ in items]
    assert contamination.drop_contaminated(df, it).count() == 0
    assert contamination.drop_contaminated(df, it.where("item_id % 10 = 0")).count() == sum(k % 10 != 0 for k, _ in items)


def test_every_link_of_a_page_counts(spark):
    pages = [
        (1, "http://one.info/a", '<link rel="canonical" href="http://free.info/1"><link rel="canonical" href="http://c.net/de/5">'),
        (2, "http://two.info/a", """<meta http-equiv="refresh" content="0; url='http://c.net/de/6'">"""),
        (3, "http://three.info/a", '<meta http-equiv=refresh content="0;url=http://free.info/2"><p><meta http-equiv=refresh content="5;url=http://one.info/a">'),
        (4, "http://four.info/a", '<link rel=canonical href="http://hub.info/q?x=1&amp;y=2">'),
        (5, "http://hub.info/q?x=1&y=2", '<link rel=canonical href="http://c.net/de/7">'),
        (6, "http://free.info/1", None),
        (7, "http://free.info/2", None),
        (8, "http://free.info/3", '<link rel=canonical href="http://free.info/4"><link rel=canonical href="http://free.info/5">'),
        (9, "http://five.info/a", '<meta content="0; URL=&quot;x" http-equiv="other"><meta content=\'0; url="http://c.net/de/8"\' http-equiv="Refresh">'),
    ]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: "allow" if k == 8 else "block" for k in range(1, 10)}


def simple_judge(pages):
    """Rules and aliases in plain Python: links as urljoin has them, classes by search."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def parts(url):
        if not url or "://" not in url:
            return None, "", ""
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        query = rest[len(host) + len(path) :].split("#")[0]
        walk = []
        for x in path.split("/")[1:]:
            if x == "..":
                walk = walk[:-1]
            elif x != ".":
                walk.append(x)
        plain = "".join("/" + x for x in walk) + ("/" if path.split("/")[-1] in (".", "..") else "") if "/." in path else path
        return low(host) + plain + query, low(host), path

    def rule(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    near = {}
    for _, url, html in pages:
        key = parts(url)[0]
        for href in re.findall(r'rel="canonical" href="([^"]*)"', html or "") + re.findall(r"url=([^\"]*)\"", html or ""):
            other = parts(urljoin(url, href.replace("&amp;", "&")))[0] if key else None
            if other and not href.startswith(("#", "mailto:")):
                near.setdefault(key, set()).add(other)
                near.setdefault(other, set()).add(key)
    out = Counter()
    for k, url, _ in pages:
        key, host, path = parts(url)
        name, verdict = rule(host, path)
        seen, todo = {key}, [key]
        while todo:
            for n in near.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        blocked = key in near and any(rule(*parts("x://" + n)[1:])[1] == "block" for n in seen)
        out[k, host, path, name, verdict or ("block" if blocked else "allow")] += 1
    return out


def test_urls_against_brute_force(spark):
    """Chains, several links a page, relative targets, clashing columns, null ids, a very long url."""
    r = random.Random(12)
    hosts = ["free.info", "A.Example.com", "b.example.net", "x.org", "deep.x.org", *(f"Site{k}.info" for k in range(60))]
    paths = ["/", "/en/7", "/en/8", "/de/8", "/de/9", "/es/1", "/a/b/c", "/a/", "/p?x=1&y=2", "/q", "/r", "/s", "/t#top", ""]
    links = [*paths, "c", "../c", "./d", "../../en/8", "?x=1", "#top", "mailto:a@b.org", "//x.org/es/1", *(f"https://site{k}.info/{c}?u=http://x.org/es/2" for k in range(5) for c in "qr"), *(f"http://SITE{k}.info/{c}" for k in range(5, 15) for c in "qr")]
    pages = []
    for k in range(300):
        url = f"http://{r.choice(hosts)}{r.choice(paths)}"
        html = "".join(r.choice(['<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">']) % r.choice(links).replace("&", "&amp;") for _ in range(r.choice([0, 0, 0, 1, 1, 2])))
        pages.append((k if k % 50 else None, url, html))
    pages += [(900, "http://free.info/" + "long/" * 30_000, '<link rel="canonical" href="/es/1">'), (901, None, '<link rel="canonical" href="/es/1">'), (902, "none", None), (903, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "key", "node", "component", "alias", "hit")})
    got = Counter(tuple(x) for x in urls.judge(df.repartition(3)).collect())
    want = simple_judge(pages)
    assert got == want
    assert sum(v == "block" and n is None for _, _, _, n, v in want) > 20 and sum(v == "allow" for *_, v in want) > 20


def test_neighbouring_and_reworded_licenses(spark):
    t = licenses.TEMPLATES
    mit = "Released under the MIT License".split()
    rows = [
        (1, "BSD-2-Clause", t["BSD-3-Clause"].replace(licenses._BSD_THIRD, "")),
        (2, "GPL-2.0-header", t["GPL-3.0-header"].replace("version 3", "version 2")),
        (3, "BSD-3-Clause", t["BSD-3-Clause"]),
        (4, "LGPL-3.0-header", t["GPL-3.0-header"].replace("GNU General", "GNU Lesser General")),
        *((5 + k, "MIT", " ".join([*("pre" * k for k in range(1, 9)), *mit[:k], "other", *mit[k + 1 :], "post"])) for k in range(5)),
    ]
    got = licenses.scan(spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(k, n) for k, n, _ in rows]
    assert all(r.matched_text.endswith("such damage") for r in got if r.license.startswith("BSD"))
