"""Line, exact and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from isoline.llm import exact, lines, queries, simhash

from .conftest import TEXTS


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def edited(r, line):
    line = list(line)
    for _ in range(r.randrange(4)):
        k = r.randrange(len(line) + 1)
        kind = r.randrange(3)
        if kind == 0:
            line.insert(k, r.choice("abé "))
        elif k < len(line):
            line[k : k + 1] = [] if kind == 1 else [r.choice("xyß")]
    return "".join(line)


@pytest.mark.parametrize("seed", range(2))
def test_line_links(spark, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdé ") for _ in range(r.choice([4, 9, 10, 12, 19, 20, 33, 61]))) for _ in range(12)]
    texts = [(k, "\n".join(edited(r, r.choice(base)) for _ in range(6))) for k in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sorted({x for _, t in texts for x in t.split("\n") if x})
    want = Counter()
    for i, a in enumerate(found):
        for b in found[:i]:
            most = min(2, max(len(a), len(b)) // 10)
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                want[distance(a, b)] += 1
    assert Counter(x.distance for x in lines.line_links(df).collect()) == want and sum(want.values()) > 20


def test_edit_distance(spark):
    r = random.Random(9)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("abé") for _ in range(r.randrange(1, 25)))
        rows.append((a, edited(r, a)))
    rows += [("a", ""), ("", ""), ("abc", "abc"), ("x" * 5000, "x" * 2500 + "y" + "x" * 2500)]
    got = lines.edit_distance(spark.createDataFrame(rows, "a string, b string")).collect()
    assert all(x.distance == min(3, distance(x.a, x.b)) for x in got if len(x.a) < 100)
    assert [x.distance for x in got if len(x.a) > 100] == [1]


def test_line_summary(spark, awkward, empty):
    got = lines.line_summary(awkward).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got}
    assert (by[3].n_lines, by[4].n_lines, by[9].n_lines, by[5].n_lines) == (0, 0, 0, 2)
    assert by[13].n_lines == 3 and by[13].n_dropped == 0  # a repeated row is its twin
    assert by[1].n_kept == 1 and by[15].n_links > 0 and by[15].n_dropped == 1
    assert lines.line_summary(empty).count() == 0
    many = spark.createDataFrame([(k, "a very common line of text\nown line number %d" % k) for k in range(300)], "doc_id long, text string")
    assert sum(r.n_kept for r in lines.line_summary(many).collect()) >= 2


def exact_want(rows, key=lower):
    groups = defaultdict(list)
    for k, x in rows:
        groups[key(x)].append(k)
    out, said = Counter(), set()
    for k, x in rows:
        ids = groups[key(x)]
        keep = max((i for i in ids if i is not None), default=None)
        stays = k == keep and key(x) not in said  # one row, also of those that repeat text and id
        said |= {key(x)} if stays else set()
        out[k, keep, len(ids), stays, hashlib.sha256(key(x).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("digest", [exact.sha256, lambda data: hashlib.sha256(data).digest()[:1][:1] and bytes([len(data) % 3])])
def test_exact_groups_also_with_a_digest_that_collides(awkward, digest):
    got = exact.exact_groups(awkward, digest=digest, files_per_batch=1).drop("locator").collect()
    assert Counter(tuple(r) for r in got) == exact_want(TEXTS)


def test_exact_many_copies_and_empty(spark, empty):
    rows = [(k, "Same TEXT" if k % 2 else f"text {k % 7}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert Counter(tuple(r) for r in exact.exact_groups(df, files_per_batch=2).drop("locator").collect()) == exact_want(rows)
    assert exact.exact_groups(empty).count() == 0
    kept = exact.drop_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for _, k, _, _, _ in exact_want(rows)}) and kept.columns == df.columns


REPEATED = [(5, "A text that stays as it is"), (13, "a TEXT that stays as it is"), (13, "quite unlike the others, of the same id"), (13, "a text that stays as it is"), (None, "A text that stays as it is"), (None, "no id one"), (None, "no id two"), (None, "no id one"), (2, None), (2, ""), (2, None)]


def test_drops_take_rows_and_not_ids(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, lower(r.text)) for r in exact.drop_copies(df).collect())
    assert got == Counter([(13, "a text that stays as it is"), (13, "quite unlike the others, of the same id"), (None, "no id one"), (None, "no id two"), (2, "")])
    near = [*REPEATED, (1, "Quite unlike the others, of the SAME id"), (13, "quite unlike the others, of the same id")]
    df = spark.createDataFrame(near, "doc_id long, text string").withColumn("_file", F.lit(1)).repartition(3)
    fps = np.array([fingerprint(x) for _, x in near], np.uint64)
    least = near_want([(i, None) for i in range(len(near))], fps)  # which rows are linked
    want = Counter()
    for c in set(least):
        ids = [k for (k, _), x in zip(near, least, strict=True) if x == c and k is not None]
        want[min(ids, default=None)] += 1
    out = simhash.drop_near_copies(df)
    assert Counter(r.doc_id for r in out.collect()) == want and out.columns == df.columns
    assert simhash.drop_near_copies(df.where("false")).count() == 0


def test_exact_goes_on_from_a_state(spark, tmp_path):
    """Later documents meet earlier ones, whose bytes are fetched by their locators."""
    first = [(k, f"text {k % 11}") for k in range(40)]
    then = [(k, f"TEXT {k % 17}") for k in range(100, 150)]
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (first, then))
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    state = f"file://{tmp_path}/state"
    got = exact.exact_groups(spark.read.parquet(f"{tmp_path}/a"), state=state).drop("locator").collect()
    assert Counter(tuple(r) for r in got) == exact_want(first)
    got = exact.exact_groups(spark.read.parquet(f"{tmp_path}/b"), state=state).drop("locator").collect()
    both = exact_want(first + then)
    assert Counter(tuple(r) for r in got) == Counter({x: n for x, n in both.items() if x[0] >= 100})
    assert exact.group_digests(spark, f"{state}/log/*", state=state).count() == len({lower(t) for _, t in first + then})
    assert exact._contents(spark, spark.createDataFrame([], "_f string, _r long"), "text").count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_want(rows, fps, radius=2):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= radius).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)].append(k)
    return [min(least[root(i)], default=None) for i in range(len(rows))]


def test_simhash_awkward(awkward, empty):
    fps = np.array([fingerprint(x) for _, x in TEXTS], np.uint64)
    want = Counter((k, f"{int(f):016x}", c) for (k, _), f, c in zip(TEXTS, fps, near_want(TEXTS, fps), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(awkward).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dense", [simhash.DENSE, 3])
def test_simhash_dense_group(spark, dense):
    """A group whose fingerprints are all within a few bits, and chains that only links join."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre}
    for _ in range(600):
        x = r.choice(sorted(fps)[-50:]) if r.random() < 0.3 else centre
        for _ in range(r.randrange(4)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(400)}
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    parts = {x.fp: x.component for x in simhash._components(df, 2, dense).collect()}
    got = defaultdict(set)
    for x in fps.view(np.int64).tolist():
        got[parts[x]].add(x)
    rows_ = [(k, None) for k in range(len(fps))]
    want = defaultdict(set)
    for c, x in zip(near_want(rows_, fps), fps.view(np.int64).tolist(), strict=True):
        want[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_queries_match_sql(spark, small):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    for name, text in queries.SQL.items():
        got = queries.QUERIES[name](spark, small)
        want = c.sql(text)
        cols = sorted(got.columns)
        assert sorted(want.columns) == cols
        assert Counter(tuple(r[k] for k in cols) for r in got.collect()) == Counter(want.select(*cols).fetchall())
