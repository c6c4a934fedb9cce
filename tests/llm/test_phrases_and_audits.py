import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinthread.llm import collocation, decontamination, divergence, wordbytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns named as those that the operators make.
DOCS = "doc_id long, text string, lang string, source string, held string, found string, g long, chunk string, n string"
VOCABULARY = ["The", "of", "a", "b", "ab", "é", "x1", "Ñandú", "fin", "zo-zo", "字", "\x00q", "w&w"]


def texts(seed=5, n=150):
    rng = random.Random(seed)
    out = [None, "", " \t\n", ".,;:!?", "one", "a" * 5000, "a b " * 3000, "a\tb  a b\r\na b.a b", "A b\x0bc a\x0cb", " x\x1fy "]
    for _ in range(n):
        out.append("".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", " ", " ", "\t", ". ", ", ", "\n", " \n "]) for _ in range(rng.randint(0, 60))))
    return out


def rows(seed=5, n=150):
    rng = random.Random(seed)
    made = [(i, t, rng.choice(["en", "en", "en", "fr", None, ""]), rng.choice(["hot", "hot", "b", "c", None, "é"]), "h", "f", 1, "c", "n") for i, t in enumerate(texts(seed, n))]
    return made + [made[20], made[20], (None, "The of a b The of a b", "en", "only", "h", "f", 1, "c", "n"), (7000, "", "none", "s1", "h", "f", 1, "c", "n"), (7001, None, "none", "s2", "h", "f", 1, "c", "n")]


def slow_phrases(docs, least, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for r in docs:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (r[1] or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    if small:  # chunks, ranges and parts of texts of a few words
        for name, value in (("CHUNK_WORDS", 50), ("SLICE", 64), ("RANGE_KEYS", 40), ("SAMPLE", 3), ("ROW_KEYS", 16)):
            monkeypatch.setattr(collocation, name, value)
    given = rows()
    got = collocation.mine(spark.createDataFrame(given, DOCS).repartition(5), 5, 30)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = [tuple(r) for r in got.collect()]
    assert set(found) == slow_phrases(given, 5, 30) and len(found) == len(set(found)) > 30


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame(rows()[:6], DOCS)
    assert collocation.mine(docs.where("false")).collect() == [] and collocation.mine(docs.where("doc_id < 2")).collect() == []
    assert collocation.mine(docs.where("doc_id < 6"), least=10**6).collect() == []


def test_radix_order_and_runs_equal_a_sort():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, m, 5000, dtype=np.uint32) for m in (3, 1 << 20, 1 << 32)]
    columns = [np.concatenate([c, c[:700]]) for c in columns]
    assert (np.stack([c[collocation.radix_order(columns)] for c in columns]) == np.array(sorted(zip(*columns, strict=True))).T).all()
    found, counts = collocation.run_lengths(columns, np.full(5700, 2**40))
    assert Counter(dict(zip(zip(*found, strict=True), counts.tolist(), strict=True))) == Counter({k: v * 2**40 for k, v in Counter(zip(*columns, strict=True)).items()})
    packed = collocation._unpack_keys(collocation._pack_keys(*found, counts))
    assert all((a == b).all() for a, b in zip(packed, (*found, counts), strict=True))


def test_keys_are_cut_at_the_bounds():
    keys = sorted({(random.Random(i).randint(1, 4), i % 7, i % 3) for i in range(200)})
    columns = [np.array(c, dtype=np.uint32) for c in zip(*keys, strict=True)]
    bounds = collocation._bounds([np.array(k, dtype=">u4").tobytes() for k in keys[::5]], 6)
    cuts = collocation._cuts(*columns, bounds)
    assert cuts == [sum(k < tuple(b) for k in keys) for b in bounds.tolist()] and len(bounds) == 5


def test_scores_are_exact_past_64_bits(spark):
    big = [(10**13 + 7, 10**13 + 9, 10**13 + 11), (3 * 10**9, 4 * 10**9, 5 * 10**10), (10, 10, 10)]
    got = spark.createDataFrame(big, "a long, l long, r long").select(collocation._score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (le * r) for a, le, r in big]


def test_slices_keep_words_whole():
    data = b"ab  cd\nefg " + b"x" * 100 + b" yz\n\nq " * 9
    for size in (1, 2, 7, 50, 1000):
        parts = list(wordbytes.slices(data, size))
        assert b"".join(parts) == data and sum((p.split() for p in parts), []) == data.split()
    assert list(wordbytes.slices(b"", 5)) == [b""]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def slow_hits(text, bench, window=10):
    words, hit, items = item_words(text), set(), set()
    for item, t in bench:
        mine = item_words(t)
        size = min(window, len(mine))
        wins = {tuple(mine[i : i + size]) for i in range(len(mine) - size + 1)} if mine else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit.update(range(i, i + size))
                items.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(items)


def bench_and_docs():
    rng = random.Random(8)
    passage = " ".join(f"w{i}" for i in range(30))
    bench = [(1, passage), (10, passage.upper()), (2, " ".join(f"w{i}" for i in range(5, 16))), (3, "short é item"), (4, "solo"), (5, None), (6, ""), (7, "..."), (None, "no id has this one at all"), (8, "a a a a a a a a a a a a"), (9, "the of"), (9, "x y z x y z x y z x y z")]
    docs = []
    for i in range(120):
        words = [rng.choice(["the", "of", "a", "w3", "solo", "no", "x", "y", "z", "Short", "É"]) for _ in range(rng.randint(0, 40))]
        at = rng.randint(0, len(words))
        begin, size = rng.randint(0, 25), rng.choice([0, 0, 5, 9, 10, 12, 30])
        words[at:at] = [f"{'W' if rng.random() < 0.2 else 'w'}{j}" for j in range(begin, min(30, begin + size))]
        docs.append((i, rng.choice([" ", "-", "\n", ", "]).join(words), "en", "s", "h", "f", 1, "c", "n"))
    odd = [None, "", "...", "solo", "Solo!solo", "a " * 3000, "short é item", "short é  ITEM", "no id has this one at all", ("q " * 5000 + passage + " ") * 3]
    return bench, docs + [(1000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(odd)] + [docs[3], docs[3], (None, passage, "en", "s", "h", "f", 1, "c", "n")]


@pytest.mark.parametrize("small", [False, True])
def test_decontamination_equals_brute_force(spark, monkeypatch, small):
    if small:  # several passes over the documents
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", 12_000)
    bench, docs = bench_and_docs()
    items = spark.createDataFrame([(i, t, "x", 3) for i, t in bench], "item_id long, text string, window string, item long")
    got = decontamination.scan(spark.createDataFrame(docs, DOCS), items).collect()
    found = Counter((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.end)), tuple(r["items"])) for r in got)
    want = Counter()
    for r in docs:
        n, hit, mine = slow_hits(r[1], bench)
        want[(r[0], n, tuple(hit), tuple(mine))] += 1
    assert found == want
    kept = decontamination.drop_contaminated(spark.createDataFrame(docs, DOCS), items)
    assert kept.columns == spark.createDataFrame(docs[:1], DOCS).columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in docs if not slow_hits(r[1], bench)[1])


def test_long_texts_are_searched_in_slices():
    bench, docs = bench_and_docs()
    rows_ = [(" ".join(w), [str(i)]) for i, t in bench for w in [item_words(t)[k : k + 10] for k in range(max(1, len(item_words(t)) - 9))] if w]
    merged = defaultdict(set)
    for window, items in rows_:
        merged[window].update(items)
    searches = decontamination.tables([(w, sorted(i)) for w, i in merged.items()])
    for r in docs:
        whole = decontamination.occurrences((r[1] or "").encode(), searches)
        assert whole == decontamination.occurrences((r[1] or "").encode(), searches, 20)


def test_search_shifts_past_what_no_window_has():
    search = decontamination.WuManber({tuple(f"w{i}".encode() for i in range(10)): ["1"]})
    looked = []

    class Words(list):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    assert list(search.search(Words([b"z"] * 9000))) == [] and len(looked) <= 1001


def test_decontamination_of_nothing(spark):
    bench, docs = bench_and_docs()
    items = spark.createDataFrame(bench, "item_id long, text string")
    given = spark.createDataFrame(docs, DOCS)
    assert decontamination.scan(given.where("false"), items).collect() == []
    got = decontamination.scan(given, items.where("false")).collect()
    assert len(got) == len(docs) and all(r.spans == [] and r["items"] == [] for r in got)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def slow_audit(docs, least, top):
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in docs:
        lang, source = r[2] or "", r[3] or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))
        counts[(lang, source)].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for la, s in groups if la == lang]
        total = Counter()
        for s in sources:
            total.update({t: counts[(lang, s)][t] for t in kept})

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        shares, q = {s: p(counts[(lang, s)]) for s in sources}, p(total)
        for s in sources:
            pairs = [(sum((shares[s][t] - shares[o][t]) ** 2 // (shares[s][t] + shares[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [((shares[s][t] - q[t]) ** 2 // (shares[s][t] + q[t]), t) for t in kept if counts[(lang, s)][t] and shares[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    if small:  # counts of few sources a row, few entries and pairs at once
        for name, value in (("TILE", 2), ("ENTRIES", 20), ("PAIRS", 7)):
            monkeypatch.setattr(divergence, name, value)
    given = rows(6)
    got = divergence.audit(spark.createDataFrame(given, DOCS).repartition(3), 5, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = slow_audit(given, 5, 4)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 60
    none = divergence.audit(spark.createDataFrame(given, DOCS), 10**6)
    assert Counter(map(tuple, none.collect())) == slow_audit(given, 10**6, 10)
    assert divergence.audit(spark.createDataFrame(given, DOCS).where("false")).collect() == []


def test_shares_are_exact_for_large_counts(spark):
    big = [(10**14, 3 * 10**14, 10**7), (0, 0, 1), (5, 7, 3), (1, 1, 0)]
    got = spark.createDataFrame(big, "c long, t long, v long").select(divergence.share("c", "t", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (t + 2 * v) if v else None for c, t, v in big]
