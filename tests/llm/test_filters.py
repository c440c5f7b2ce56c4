"""Toxicity, decontamination, license scans and URL filters."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.llm import contamination, licenses, toxicity, urls
from isoline.llm.words import normal

from .conftest import TEXTS


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    model = toxicity.fit(docs, train)
    assert (np.diff(model.thresholds) >= 0).all()
    got = toxicity.score(docs, model).join(test.withColumnRenamed("toxic", "truth"), "doc_id").collect()
    right = sum(r.toxic == bool(r.truth) for r in got)
    assert right >= 0.97 * len(got)
    graded = [r for r in got if r.truth]
    assert len({r.severity for r in graded}) >= 2 and all(0 <= r.expected_severity <= toxicity.GRADES for r in got)


def test_likelihood_against_brute_force(spark):
    """The fitted weights and thresholds are where the penalised likelihood, written out, has no slope."""
    r = np.random.default_rng(3)
    n, rows = 6, 300
    x = r.random((rows, n)) < 0.3
    latent = x @ np.array([2.0, 1.0, 0.5, -1.0, 0.0, 1.5]) + r.logistic(size=rows)
    grade = (latent[:, None] > np.array([1.5, 2.5, 3.5])[None, :]).sum(1)
    row, index = np.nonzero(x)
    w, theta = toxicity._ordinal(n, index, row, grade, rows, 1e-2, 3_000)

    def loss(w, theta):
        hot = grade > 0
        weight = np.where(hot, np.sqrt((~hot).sum() / hot.sum()), 1.0)
        out = 0.0
        for i in range(rows):
            for k in range(toxicity.GRADES):
                p = 1 / (1 + np.exp(-(theta[k] - x[i] @ w)))
                out -= weight[i] * np.log(p if grade[i] <= k else 1 - p) / rows
        return out + 1e-2 * (w @ w) / 2

    for k in range(n):
        d = np.eye(n)[k] * 1e-4
        assert abs(loss(w + d, theta) - loss(w - d, theta)) / 2e-4 < 1e-3
    for k in range(toxicity.GRADES):
        d = np.eye(toxicity.GRADES)[k] * 1e-4
        assert abs(loss(w, theta + d) - loss(w, theta - d)) / 2e-4 < 1e-3


def test_scores_against_brute_force(spark, awkward):
    model = toxicity.Model({"cat": 0, "ca*": 9, "text*": 1, "word": 2}, np.array([1.5, 0.25, -3.0]), np.array([0.0, 1.0, 2.5]))
    got = Counter(tuple(x) for x in toxicity.score(awkward, model).collect())
    want = Counter()
    for k, t in TEXTS:
        s = sum(model.weights[model.features[f]] for f in toxicity.features_of(t) if f in ("cat", "text*", "word"))
        below = [0.0, *(1 / (1 + np.exp(-(c - s))) for c in model.thresholds), 1.0]
        p = np.diff(below)
        want[k, int(p.argmax()), round(sum(g * q for g, q in enumerate(p)), 9), round(1 - p[0], 9), bool(p[0] < 0.5)] += 1
    assert Counter((a, b, round(c, 9), round(d, 9), e) for a, b, c, d, e in got.elements()) == want
    kept = toxicity.drop_toxic(awkward, model)
    assert Counter(x.doc_id for x in kept.collect()) == Counter(a for a, *_, e in got.elements() if not e) and kept.columns == awkward.columns


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    twice = docs.unionByName(docs.withColumn("text", F.lit("some other text of the same id")))
    a, b = (toxicity.fit(x, labels) for x in (twice.repartition(5), twice.repartition(2)))
    assert a.features == b.features and np.allclose(a.weights, b.weights) and np.allclose(a.thresholds, b.thresholds)


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels)
    assert toxicity.score(awkward, model).count() == len(TEXTS)
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    none = toxicity.fit(awkward, labels.where("false"))
    assert toxicity.drop_toxic(awkward, none).count() == len(TEXTS) and toxicity.drop_toxic(awkward, none).columns == awkward.columns
    assert not any(r.toxic for r in toxicity.score(awkward, toxicity.fit(awkward, labels.where("toxic = 0"))).collect())


def held(text, item):
    run = min(5, len(normal(item).split()))
    s, q = (contamination.shingle_set(normal(x).split(), run) for x in (text, item))
    return len(q & s) / len(q) if run else 0


@pytest.mark.parametrize("block", [20_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7)))
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 14, 18, 40, 70, 200])))) for k in range(30)]
    docs = []
    for k in range(120):
        words = [word() for _ in range(r.choice([0, 10, 300, 4_000]))]
        if k % 2:
            item = r.choice(items)[1].split()
            for _ in range(r.randrange(3)):
                item[r.randrange(len(item))] = word()
            if k % 3 == 0:
                half = len(item) // 2
                words = item[:half] + words + item[half - 4 :] if half > 4 else words + item
            else:
                at = r.randrange(len(words) + 1)
                words[at:at] = item
        docs.append((k, " ".join(words).title() if k % 5 else ", ".join(words)))
    docs += [(500, None), (501, ""), (502, items[5][1]), (502, items[5][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    want = Counter((d, i) for d, t in docs for i, q in items if held(t, q) >= 0.8)
    got = contamination.find_items(df, it, block_items=block).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == want and len(want) > 20
    clean = contamination.drop_contaminated(df, it, block_items=block)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in docs if d not in {d for d, _ in want})
    assert contamination.find_items(df, it.where("false")).count() == 0


def test_decontamination_awkward(spark, awkward, empty):
    it = spark.createDataFrame([(1, "cat sat on the mat and the dog")], "item_id long, text string")
    assert {r.doc_id for r in contamination.find_items(awkward, it).collect()} == {1, 2, 15}
    assert contamination.drop_contaminated(awkward, it).columns == awkward.columns
    assert contamination.find_items(empty, it).count() == 0


def test_licenses(spark, awkward, empty):
    t = licenses.TEMPLATES
    noisy = t["BSD-3-Clause"].replace("binary", "any", 1).replace("notice, this list", "this list")
    rows = [(1, "a b c " + t["MIT"] + " d"), (2, t["Apache-2.0-header"]), (3, "x\n" + noisy.upper() + "\n" + t["MIT"] + "\n" + t["MIT"]), (4, "released under no license"), (5, t["CC-BY-NC-4.0"]), (6, " ".join(t["ISC"].split()[:15]))]
    got = [(r.doc_id, r.license, r.word_start) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter((d, n) for d, n, _ in got) == Counter({(1, "MIT"): 1, (2, "Apache-2.0-header"): 1, (3, "BSD-3-Clause"): 1, (3, "MIT"): 2, (5, "CC-BY-NC-4.0"): 1})
    assert (1, "MIT", 3) in got
    assert licenses.scan(awkward).count() == 0 and licenses.scan(empty).count() == 0


def test_license_found_wherever_it_stands(spark):
    """Winnowing must not lose a notice because of the words around it."""
    r = random.Random(6)
    rows = [(k, " ".join(r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(r.randrange(40))) + " Released under the MIT License. " + r.choice("xyz") * 3) for k in range(300)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == set(range(300)) and len(got) == 300


def full_table(a, b):
    """Score and matches of the best local alignment by the whole table."""
    best, table = (0, 0), [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            (s, m), (u, v), (g, h) = table[i - 1][j - 1], table[i - 1][j], table[i][j - 1]
            c = max((s + 2, m + 1) if x == y else (s - 1, m), (u - 1, v), (g - 1, h))
            table[i][j] = c if c[0] > 0 else (0, 0)
            best = max(best, table[i][j], key=lambda t: t[0])
    return best


def test_alignment_matches_full_table():
    r = random.Random(8)
    for _ in range(300):
        a = [bytes([r.randrange(97, 103)]) for _ in range(r.randrange(2, 16))]
        b = [bytes([r.randrange(97, 103)]) for _ in range(r.randrange(12))]
        for x in a:
            b += r.choice([[x], [x], [x], [], [b"z", x], [b"q"]])
        n, ts, te, ws, we = licenses.align(a, b, r.randrange(-3, 6), len(a) + len(b) + 8)
        score, matched = full_table(a, b)
        assert n == matched and n <= min(te - ts, we - ws)
        assert full_table(a[ts:te], b[ws:we]) == (score, matched)


def test_alignment_in_a_band():
    """Outside the band nothing is matched; inside it the whole table's answer is."""
    r = random.Random(9)
    for _ in range(100):
        a = [b"%d" % k for k in range(30)]
        b = [b"x"] * r.randrange(9) + a
        at = len(b) - 30
        del b[r.randrange(at, len(b))]
        got = licenses.align(a, b, at, 3)
        assert got[0] == 29 and got[3:] == (at, at + 29) or got[0] >= 28
        assert licenses.align(a, b, at + 9, 3)[0] == 0


PAGES = [
    (1, "http://a.example.com/en/100", '<link rel="canonical" href="http://x.com/en/1">'),
    (2, "https://b.org/es/1?x=/y", None),
    (3, "http://C.NET/de/5", "<p>"),
    (4, "http://m.other.info/p", '<meta http-equiv="refresh" content="0; url=http://c.net/de/5">'),
    (5, "http://www.example.com/en/7", '<link href="http://c.net/de/5" rel=canonical>'),
    (6, None, None),
    (7, "no url", ""),
    (8, "http://third.info/q#frag", '<link rel="canonical" href="//m.other.info/p">'),
    (9, "http://free.info", '<link rel="canonical" href="/home">'),
    (10, "http://free.info/home", ""),
    (11, "http://sub.example.net/de/812", ""),
    (11, "http://notexample.com.evil/en/", ""),
    (12, "HTTP://EXAMPLE.COM?/en/7", ""),
]


def test_url_rules_and_aliases(spark):
    got = Counter((r.page_id, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)).collect())
    want = [(1, "com/en/", "block"), (2, "org/es/", "block"), (3, "net/de/", "block"), (4, None, "block"), (5, "example.com/en/7", "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "block"), (9, None, "allow"), (10, None, "allow"), (11, "example.net/de/8", "block"), (11, None, "allow"), (12, None, "allow")]
    assert got == Counter(want)


def test_url_links_of_a_crawler_and_empty(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    links = spark.createDataFrame([("http://free.info/home", "https://hop.info/1"), ("https://hop.info/1", "http://b.org/es/9"), (None, "http://x.org")], "src string, dst string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, links=links).collect()}
    assert got[9] == got[10] == "block"
    assert urls.judge(pages.where("false")).count() == 0
    r = urls.judge(pages).where("page_id = 12").first()
    assert (r.host, r.path) == ("example.com", "")
