import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinthread.llm import topk, urls

VECTORS = "vec_id long, embedding array<float>, q string, is_query string, rank int"


def brute(rows, k=5):
    ok = []
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((vec_id, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for at, (q, a) in enumerate(ok):
        if q % 50:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), d) for i, (d, b) in enumerate(ok) if i != at and len(a) == len(b))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k).collect())


def some_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.2 * rng.normal(size=16)]) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # a very common vector: ties
    rows += [(50, rows[7][1]), (100, rows[100][1]), (5000, [1.0, 2.0]), (5001, [0.5, 0.25]), (5050, []), (5051, [])]
    rows += [(None, rows[0][1]), (6000, None), (6050, [None] * 16), (6100, [float("nan")] * 16), (6150, [float("inf")] * 16)]
    return rows


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "SHARD", 256)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    rows = some_vectors()
    assert run(spark, rows) == brute(rows)


def test_topk_of_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0]), (50, [-1.0])]) == brute([(0, [1.0]), (1, [2.0]), (50, [-1.0])])


def test_topk_takes_large_vectors_and_every_copy(spark, monkeypatch):
    assert run(spark, [(0, [1.0]), (1, [600000.0]), (2, [3.0])]) == [(0, 1, 1, 256 * 256 * 600000), (0, 2, 2, 256 * 256 * 3)]
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (0, [-1.0, 5.0]), (50, [0.5, -2.0**20]), (3, [2.0**19, -(2.0**21)])]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "TOGETHER", 1)
    monkeypatch.setattr(topk, "EXTREMES", 2)
    monkeypatch.setattr(topk, "ASKING", 3)
    monkeypatch.setattr(topk, "TIMES", 3)
    rng = random.Random(8)
    rows = [(rng.randrange(0, 200, 10), [float(np.float32(rng.choice([1e-3, 1.0, 1e4, 1e6]) * rng.uniform(-1, 1))) for _ in range(6)]) for _ in range(60)]
    rows += rows[:8] * 4
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(0, [1e12]), (1, [1e12])])
    # a score that doesn't count may be of any size
    assert run(spark, [(0, [1e12]), (1, [-1e12]), (2, [0.0])], k=1) == [(0, 1, 2, 0)]


def test_blocks_are_pruned_and_large_components_stay_exact():
    rng = np.random.default_rng(1)
    centres = 100 * rng.normal(size=(8, 32))
    matrix = np.floor(centres[np.arange(4096) // 512] + 5 * rng.normal(size=(4096, 32))).astype(np.int64)
    shard = topk.Shard(np.arange(4096), matrix)
    best = [[] for _ in range(8)]
    scored = topk.search_shard(shard, matrix[::512].astype(np.float64), 5, best, np.arange(0, 4096, 512))
    assert scored < 8 * len(shard.first) / 2
    for i, b in zip(range(0, 4096, 512), best, strict=True):
        scores = matrix @ matrix[i]
        assert [c[:2] for c in b] == sorted((-int(s), d) for d, s in enumerate(scores.tolist()) if d != i)[:5]
    big = np.array([[2.0**26, 3], [2.0**26 - 1, 5]])
    assert topk.products(big, big).tolist() == [[2**52 + 9, 2**52 - 2**26 + 15], [2**52 - 2**26 + 15, (2**26 - 1) ** 2 + 25]]
    mixed = np.array([[2.0**60, 1], [3, -1], [-(2.0**900), 2.0**40]])
    assert topk.products(mixed, mixed).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in mixed.tolist()] for a in mixed.tolist()]


def slow_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:].split("?", 1)[0].split("#", 1)[0]
    fits = [
        (len(h + p), len(h), h + p, v) for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.org", "www.Example.ORG", "org", "a.b.c.example.org", "xorg", "example.com", "m.com", "com", "localhost", "ex.org.", "user@x.org:80", ""]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12/x", "/en/", "/fr/a/b/c", "/de/", "/de", "//fr/", "/fr//x", "/" + "a/" * 500]
    tails = ["", "?q=1", "#top", "?x#y", "?u=http://other.org/es/"]
    rows = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(600)]
    rows += [None, "", "no scheme", "http:/one.org/", "http://é.org/ü", "http://x.org/\nes/", rows[0], rows[0]]
    more = [*urls.RULES, ("org", "", "block"), ("c.example.org", "/es", "allow"), ("xorg", "/de/", "block"), ("EXAMPLE.com", "/fr/a/b", "block"), ("", "/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i // 2, u, "r", "h") for i, u in enumerate(rows)], "page_id long, url string, rule string, host string")
    for rules in (urls.RULES, more, more[5:6]):
        got = sorted((tuple(r) for r in urls.judge(pages, urls.rule_table(spark, rules)).collect()), key=str)
        clean = [(h.lower(), p, v) for h, p, v in rules if h]
        assert got == sorted(((i // 2, *slow_judge(u, clean)) for i, u in enumerate(rows)), key=str)


def test_url_rules_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty, urls.rule_table(spark)).collect() == []
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = urls.rule_table(spark).where("false")
    assert urls.judge(pages, none, "block").first().verdict == "block"


@pytest.mark.parametrize("url,host,path", [("HTTP://A.B/C?d", "a.b", "/C"), ("x://y", "y", ""), ("a:b", "", ""), ("http://h?x/y", "h", "")])
def test_host_and_path(spark, url, host, path):
    h, p = urls.host_and_path(F.lit(url))
    assert tuple(spark.range(1).select(h, p).first()) == (host, path)
