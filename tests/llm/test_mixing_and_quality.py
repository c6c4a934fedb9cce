import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from kinthread.llm import mixing, quality

DOCS = "doc_id long, text string, source string, target string, taken string"


def slow_sainte_lague(weights, seats, caps):
    given = [0] * len(weights)
    for _ in range(seats):
        free = [i for i in range(len(weights)) if given[i] < caps[i] and weights[i] > 0]
        if not free:
            break
        given[max(free, key=lambda i: (Fraction(weights[i], 2 * given[i] + 1), -i))] += 1
    return given


def test_sainte_lague_equals_the_seat_by_seat_method():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 8)
        weights = [rng.choice([0, 1, 3, 7, 50, 1000, rng.randint(1, 10**6)]) for _ in range(n)]
        caps = [rng.choice([0, 2, 10**6]) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert mixing.sainte_lague(weights, seats, caps).tolist() == slow_sainte_lague(weights, seats, caps)
    big = mixing.sainte_lague([5e12, 2e12, 1e12], 8 * 10**10, [10**15] * 3)
    assert big.tolist() == [5 * 10**10, 2 * 10**10, 10**10]


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100]) == [Fraction(1500, 8), Fraction(600, 8), Fraction(300, 8)]
    capped = mixing.targets([10, 1000, 1000])
    assert capped[0] == 30 and sum(capped) == 2010 and capped[1] == 2 * capped[2]
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


def rows_of(seed=3, n=3000):
    rng = random.Random(seed)
    sources = ["b", "a", None, "z", "é", "hot"]
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 30, 200])
        out.append((i, " ".join(["w"] * k), rng.choices(sources, [1, 1, 1, 0.02, 1, 5])[0], "t", "k"))
    return [*out, (9001, None, "a", "t", "k"), (9002, "x " * 20_000, "b", "t", "k"), (5, "again", "a", "t", "k"), (5, "again", "a", "t", "k"), (None, "no id", None, "t", "k")]


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 300)
    rows = rows_of()
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(mixing.with_sizes(docs)).collect()
    again = mixing.mix(mixing.with_sizes(docs.repartition(7))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    sizes = Counter()
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(float(wanted[s])) for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(float(wanted[s]), rel=0.01, abs=3)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    copies = Counter(r.source for r in whole.collect())
    assert copies[None] > 0 and max(Counter(r.doc_id for r in whole.collect() if r.doc_id != 5).values()) <= 3


def test_taken_equals_a_brute_force_walk(spark, monkeypatch):
    """Every document's words and copies, block by block, from the plans of its shard."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    rows = rows_of(9, 400)
    docs = spark.createDataFrame(rows, DOCS)
    sized = mixing.with_sizes(docs).drop("target", "taken")
    plans = [r.asDict() for r in mixing.planned(mixing._slim(sized, mixing.F.col("size"))).collect()]
    wanted = Counter()
    shards = {}
    for p in plans:
        shards.setdefault((p["m_source"], p["m_cell"], p["m_blocks"], p["m_step"], p["m_shift"]), []).append(p)
    quotas = Counter()
    for (source, cell, blocks, step, shift), parts in shards.items():
        block, rounds, rest = parts[0]["m_block"], parts[0]["m_rounds"], parts[0]["m_rest"]
        assert math.gcd(step, blocks) == 1 or blocks == 1
        words, owners = [], []
        for p in sorted(parts, key=lambda p: (p["m_begin"], p["m_size"])):
            assert len(words) == p["m_begin"]
            for _ in range(p["m_rows"]):
                owners.append((p["m_id"], source, p["m_size"], len(words)))
                words += [len(owners) - 1] * p["m_size"]
        assert len(words) == cell
        again = {b for b in range(blocks) if (b * step + shift) % blocks < rest}
        assert len(again) == rest
        quotas[source] += rounds * blocks + rest
        once = Counter(owner for at, owner in enumerate(words) if at // block in again)
        for n, (doc, src, size, begin) in enumerate(owners):
            copies = rounds + ((begin + size // 2) // block in again) if size else 0
            wanted[doc, src, size, rounds * size + once[n], copies] += 1
    got = Counter((r.doc_id, r.source, r.size, r.taken, r.copies) for r in mixing.mix(mixing.with_sizes(docs)).collect())
    assert got == wanted
    # the sources' quotas are those of the seat-by-seat method
    names = sorted({p["m_source"] for p in plans}, key=lambda s: (s is None, s or ""))
    sizes = [sum(p["m_size"] * p["m_rows"] for p in plans if p["m_source"] == s) for s in names]
    block = plans[0]["m_block"]
    expected = slow_sainte_lague([Fraction(float(t)) for t in mixing.targets(sizes)], round(sum(sizes) / block), [math.ceil(n / block * 3) for n in sizes])
    assert [quotas[s] for s in names] == expected


def source_sizes(docs):
    F = mixing.F
    return mixing.with_sizes(docs).groupBy(F.col("source").alias("m_source")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))


def test_many_sources_and_ties(spark, monkeypatch):
    """Targets and quotas over a table of sources equal those of lists; equal sizes tie everywhere."""
    rng = random.Random(3)
    for sizes in ([10] * 200, [rng.choice([0, 1, 7, 300, 10**5]) for _ in range(300)], [3, 10**9, 1, 0]):
        table = spark.createDataFrame(list(enumerate(sizes)), "number long, size long")
        found, total = mixing.with_targets(table)
        rows = sorted(mixing.with_quotas(found, round(total / 7), 7).collect())
        wanted = mixing.targets(sizes)
        assert [r.target for r in rows] == pytest.approx([float(t) for t in wanted])
        caps = [math.ceil(n / 7 * 3) for n in sizes]
        assert [r.quota for r in rows] == mixing.sainte_lague([r.target for r in rows], round(total / 7), caps).tolist()
    docs = spark.createDataFrame(rows_of(4, 300), DOCS)
    by_list = sorted(map(str, mixing.shares(source_sizes(docs))[0].collect()))
    monkeypatch.setattr(mixing, "CATALOGUE", 0)
    assert sorted(map(str, mixing.shares(source_sizes(docs))[0].collect())) == by_list
    named = mixing.numbered(spark.createDataFrame([(s,) for s in ["b", None, "a", "é", "Z", "zz"]], "s string").repartition(3), "n", mixing.F.col("s").asc_nulls_last())
    assert sorted((r.n, r.s) for r in named.collect()) == [(0, "Z"), (1, "a"), (2, "b"), (3, "zz"), (4, "é"), (5, None)]


def test_mixed_documents_keep_columns_of_any_name(spark):
    names = ["words", "cell_size", "source_no", "source_quota", "plan_source", "shards", "size", "until", "order_key", "order_tie", "shard", "copy", "m_id", "m_row", "k_id"]
    rows = [(i, "w " * (10 + i % 50), "ab"[i % 2], *range(len(names))) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and {tuple(r) for r in got} <= set(rows)
    copies = Counter((r.doc_id, r.source) for r in mixing.mix(mixing.with_sizes(docs.drop("size"))).collect())
    assert len(copies) == 60 and sum(copies.values()) == 65


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(mixing.with_sizes(empty)).collect() == []
    blank = spark.createDataFrame([(1, None, "a", "", ""), (2, " ", None, "", "")], DOCS)
    assert [(r.taken, r.target) for r in mixing.mix(mixing.with_sizes(blank)).collect()] == [(0, 0.0), (0, 0.0)]


def slow_base(text):
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text).split(" ") if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + o for i, w in enumerate(windows) if counts[w] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def slow_quality(rows, limit, distinct_texts=False):
    def norm(line):
        return " ".join("".join(" " if c in " \t\n\r\x0b\x0c" else c for c in line.lower()).split(" ")).strip() if line else line

    def squeeze(line):
        return " ".join(w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in line.lower()).split(" ") if w)

    texts = {}
    for at, (doc_id, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if squeeze(line):
                texts.setdefault((host, squeeze(line)), set()).add(text if distinct_texts else ("row", at) if doc_id is None else doc_id)
    out = []
    for doc_id, text, host in rows:
        base = slow_base(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        removed = sum(len(squeeze(x).split(" ")) for x in (text or "").split("\n") if squeeze(x) and len(texts[host, squeeze(x)]) > limit)
        out.append((doc_id, *base, failed, removed, not failed and 100 * removed <= 50 * base[0]))
    return sorted(out, key=str)


def test_quality_equals_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["a|b", "##", "é", "İx", "Ünï"]
    shared = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(6)]
    rows = []
    for i in range(160):
        lines = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 10]))) for _ in range(rng.choice([1, 6, 20]))]
        lines += rng.choices([*shared, shared[0].upper(), "  " + shared[1] + "\t", "", " "], k=rng.choice([0, 3, 12]))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h2", None])))
    rows += [(900, None, "h1"), (901, "", "h1"), (902, "\n\n \n", None), (903, "one two three " * 40, "h1"), (904, "a b c d", "h1")]
    rows += [(None, "\n".join([*shared[:2], *(f"own {i} {j}" for j in range(30))]), "h1") for i in range(9)]
    rows += [(905, " ".join(str(i) for i in range(30_000)) + " 5 6 7 8", "h2")] + [(77, rows[77][1], rows[77][2])] * 30
    docs = spark.createDataFrame([(i, t, h, "x", 1) for i, t, h in rows], "doc_id long, text string, source string, x string, lines int").repartition(4)
    got = sorted((tuple(r) for r in quality.judge(docs, line_docs=5).collect()), key=str)
    assert got == slow_quality(rows, 5)
    got = sorted((tuple(r) for r in quality.judge(docs, line_docs=5, distinct_texts=True).collect()), key=str)
    assert got == slow_quality(rows, 5, True)
    # the real output: kept documents without the lines that go
    words = {}
    for r in slow_quality(rows, 5):
        if r[-1]:
            words.setdefault(r[0], []).append(r[1] - r[7])
    cleaned = {}
    for r in quality.clean(docs, line_docs=5).collect():
        assert r.x == "x" and r.lines == 1
        cleaned.setdefault(r.doc_id, []).append(slow_base(r.text)[0])
    assert cleaned == words and quality.clean(docs).columns == docs.columns


def test_quality_of_nothing(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_repeat_words_of_many_repeats(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, k, size=n))) for k in (2, 5, 12, 60) for n in (2, 3, 4, 50, 700)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", quality.repeat_words(quality.words_of(df["t"])).alias("n")).collect()}
    assert got == {i: slow_base(t)[4] for i, t in enumerate(texts)}


def test_clean_takes_odd_rows_and_none(spark):
    def body(k):
        return "\n".join(" ".join(f"w{k}x{i}x{j}" for j in range(12)) for i in range(6))

    schema = "doc_id long, text string, source string, n_chars int, row string, held string, gone string, salt string, lines string, kept string"
    extra = ("r", "h", "g", "s", "l", "k")
    rows = [(i, f"{body(i)}\nthe same footer\n\n", None if i % 2 else "s", 1, *extra) for i in range(30)]
    rows += [rows[3], rows[3], (100, None, "s", 1, *extra), (101, "", None, 1, *extra), (None, body(200), "t", 1, *extra), (102, body(201) + "\n" + "long " + "y z q " * 40_000, "u", 1, *extra)]
    docs = spark.createDataFrame(rows, schema)
    got = quality.clean(docs, line_docs=14).collect()
    assert quality.clean(docs).columns == docs.columns and quality.clean(docs.where("false")).collect() == []
    assert {r.doc_id for r in got} <= {*range(30), None} and all(tuple(r)[4:] == extra for r in got)
    judged = {(r.doc_id, r.kept) for r in quality.judge(docs, line_docs=14).collect()}
    assert {r.doc_id for r in got} == {i for i, kept in judged if kept} and (100, False) in judged and (101, False) in judged
    assert len(got) == 33 and {*range(30), None} == {r.doc_id for r in got}  # 102 repeats itself
    for r in got:
        want = body(200) if r.doc_id is None else body(r.doc_id) + "\n\n"
        assert r.text == want and r.n_chars == (1 if r.doc_id is None else len(want))
