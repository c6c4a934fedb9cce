"""Source divergence audit: how far the sources of a language are apart in their terms.

Counts of terms become joint count histograms: for a pair of sources, how many
terms have which two counts. Only terms that both have are met; the cells with
a zero follow from the histograms of single sources and the number of kept
terms. The distance is evaluated once for each cell and weighed by its tally.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinthread.llm.common import stored
from kinthread.llm.wordbytes import byte_table, slices, utf8

LEAST_DOCS = 10
TOP_TERMS = 10
#: Entries (lang, source, term) that a task counts before it hands them on.
ENTRIES = 1 << 19
#: Sources of a language, about, whose counts of a term are one row; with more a term has more rows, which meet pair by pair.
TILE = 256
#: Pairs of counts that a task tallies at once.
PAIRS = 1 << 20
_FOLD = byte_table(i for i in range(0x80) if not chr(i).isalpha())
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_CELLS = pa.schema([(c, pa.int64()) for c in ("g1", "g2", "c1", "c2", "m")])


def _term_counter(entries: int):
    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (lang, source, term, n, docs) of runs of (lang, source, text)."""
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows():
            for (lang, source), (n, docs) in counts.items():
                terms = sorted(n)  # neighbours are alike, which packs well
                for low in range(0, len(terms), 10_000):
                    some = terms[low : low + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                        pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64()),
                    ], schema=_COUNTS)

        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), utf8(batch["text"]), strict=True):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in slices(text.translate(_FOLD)):
                    terms = part.split()
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(len(n) for n, _ in counts.values()) > entries:
                yield from rows()
                counts = {}
        yield from rows()

    return count_terms


def _tallier(most_pairs: int):
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells (g1, g2, c1, c2, m), g1 < g2, of rows (gs, ns, other_gs, other_ns): counts of one term.

        Without others, all pairs of a row's own counts; else each with each other.
        """
        for batch in batches:
            g, n, begins, ends = _lists(batch["gs"], batch["ns"])
            own = batch["other_gs"].is_null().to_numpy(zero_copy_only=False)
            og, on, obegins, oends = _lists(batch["other_gs"], batch["other_ns"])
            row = np.repeat(np.arange(len(begins)), ends - begins)
            # the partners of element e of a row: those behind it, or all others
            left = np.arange(len(g))
            first = np.where(own[row], left + 1, obegins[row] + len(g))
            many = np.where(own[row], ends[row] - left - 1, oends[row] - obegins[row])
            g, n = np.concatenate([g, og]), np.concatenate([n, on])
            upto = np.concatenate([[0], np.cumsum(many)])
            low = 0
            while low < len(left):
                high = max(low + 1, int(np.searchsorted(upto, upto[low] + most_pairs, "right")) - 1)
                times = many[low:high]
                a = np.repeat(left[low:high], times)
                b = np.arange(len(a)) - np.repeat(upto[low:high] - upto[low], times) + np.repeat(first[low:high], times)
                low = high
                if not len(a):
                    continue
                turn = g[a] > g[b]
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                columns = [g[a], g[b], n[a], n[b]]
                order = np.lexsort(columns[::-1])
                columns = [c[order] for c in columns]
                new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in columns] + [pa.array(np.diff(np.append(at, len(a))))], schema=_CELLS)

    return tally


def _lists(gs: pa.Array, ns: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = pa.compute.fill_null(pa.compute.list_value_length(gs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    return gs.flatten().to_numpy(), ns.flatten().to_numpy(), ends - lengths, ends


def share(count: str, total: str, terms: str) -> Column:
    """p of a count: 1 + floor(10**9 * (count + 2) / (total + 2 * terms)), exact; null without terms."""
    whole = F.expr(f"cast(1000000000 as decimal(10,0)) * cast({count} + 2 as decimal(20,0))")
    return F.when(F.col(terms) > 0, 1 + F.call_function("div", whole, F.expr(f"cast({total} + 2 * {terms} as decimal(20,0))")))


def distance(p: str, q: str) -> Column:
    """floor((p - q)**2 / (p + q)); p and q are below 2**31, so a long holds the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _group_ids(groups: DataFrame) -> int:
    """A seed by which all (lang, source) have different hashes."""
    for seed in range(42, 142):
        n, distinct = groups.agg(F.count(F.lit(1)), F.count_distinct(F.xxhash64(F.lit(seed), "lang", "source"))).first()
        if n == distinct:
            return seed
    raise ValueError("no seed tells the sources apart")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of every source of every language.

    Part ``pair`` has a row for each other source of the language, part
    ``term`` the ``top_terms`` terms whose share in the source is most above
    that in the language. Terms are runs of letters (and of anything beyond
    ASCII), kept in a language if at least ``least_docs`` of its rows have
    them. Ranks go by value, ties by item in UTF-8 order.

    A null lang, source or text reads as ''; a source without a term has its
    pairs, as has every source of a language without a kept term (value 0). A
    source that is alone has no pair. Repeated rows count each; texts are whole
    however long; only lang, source and text are read, other columns, of any
    names, change nothing. No rows give none.

    Counts are summed where they are read, then by (lang, source, term), and
    only then by term, so no task gets all of a frequent term or source.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = stored(texts.select("lang", "source").distinct(), "groups")
    seed = _group_ids(groups)
    gid = F.xxhash64(F.lit(seed), "lang", "source")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    tiles = -(-most // TILE)

    one_term = Window.partitionBy("lang", "term")
    counted = (
        texts.mapInArrow(_term_counter(ENTRIES), "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        # at most a row for each source of the language
        .select("lang", "source", "term", "n", F.sum("n").over(one_term).alias("all_n"), F.sum("docs").over(one_term).alias("docs"))
        .where(F.col("docs") >= least_docs)
    )
    counts = stored(counted.select("lang", "source", "term", "n", "all_n", gid.alias("g")), "counts")
    langs = counts.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    known = stored(
        groups.withColumn("g", gid).join(sizes, "g", "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "v", "all_total"]), "sources",
    )
    return _pairs(known, counts, tiles).unionByName(_terms(known, counts, top_terms))


def _pairs(known: DataFrame, counts: DataFrame, tiles: int) -> DataFrame:
    a, b = (known.select("lang", "v", *(F.col(c).alias(f"{c}{i}") for c in ("g", "source", "total", "terms"))) for i in (1, 2))
    pairs = stored(a.join(b.drop("v"), "lang").where("g1 < g2"), "pairs")  # what the result has to have a row for, twice

    tiled = counts.withColumn("tile", F.pmod(F.xxhash64("g"), F.lit(max(1, tiles))))
    rows = tiled.groupBy("lang", "term", "tile").agg(F.collect_list(F.struct("g", "n")).alias("x"))
    rows = rows.select("lang", "term", "tile", F.col("x.g").alias("gs"), F.col("x.n").alias("ns"))
    met = rows.select("gs", "ns", F.lit(None).cast("array<bigint>").alias("other_gs"), F.lit(None).cast("array<bigint>").alias("other_ns"))
    if tiles > 1:
        rows = stored(rows, "tiles")
        other = rows.select("lang", "term", F.col("tile").alias("other_tile"), F.col("gs").alias("other_gs"), F.col("ns").alias("other_ns"))
        met = rows.select(*met.columns[:2], *(F.lit(None).cast("array<bigint>").alias(c) for c in met.columns[2:])).unionByName(
            rows.join(other, ["lang", "term"]).where("tile < other_tile").select(*met.columns)
        )
    joint = stored(
        met.mapInArrow(_tallier(PAIRS), "g1 long, g2 long, c1 long, c2 long, m long").groupBy("g1", "g2", "c1", "c2").agg(F.sum("m").alias("m")), "joint",
    )
    alone = counts.groupBy("g", "n").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    # cells with a zero: all terms of a count in the one source, less those that the other has too
    implied = (
        pairs.join(alone.withColumnRenamed("g", "g1"), "g1").select("g1", "g2", F.col("n").alias("c1"), zero.alias("c2"), "m")
        .unionAll(pairs.join(alone.withColumnRenamed("g", "g2"), "g2").select("g1", "g2", zero.alias("c1"), F.col("n").alias("c2"), "m"))
        .unionAll(pairs.select("g1", "g2", zero.alias("c1"), zero.alias("c2"), (F.col("v") - F.col("terms1") - F.col("terms2")).alias("m")))
        .unionAll(joint.groupBy("g1", "g2", "c1").agg((-F.sum("m")).alias("m")).select("g1", "g2", "c1", zero.alias("c2"), "m"))
        .unionAll(joint.groupBy("g1", "g2", "c2").agg((-F.sum("m")).alias("m")).select("g1", "g2", zero.alias("c1"), "c2", "m"))
        .unionAll(joint.groupBy("g1", "g2").agg(F.sum("m").alias("m")).select("g1", "g2", zero.alias("c1"), zero.alias("c2"), "m"))
        .groupBy("g1", "g2", "c1", "c2").agg(F.sum("m").alias("m"))
    )
    cells = joint.unionByName(implied).where("m > 0").join(pairs.select("g1", "g2", "v", "total1", "total2"), ["g1", "g2"])
    cells = cells.withColumns({"p": share("c1", "total1", "v"), "q": share("c2", "total2", "v")})
    values = cells.select("g1", "g2", (F.col("m") * distance("p", "q")).alias("value")).groupBy("g1", "g2").agg(F.sum("value").alias("value"))
    valued = pairs.join(values, ["g1", "g2"], "left").select("lang", "source1", "source2", F.coalesce("value", zero).alias("value"))
    both = valued.select("lang", F.explode(F.array(
        F.struct(F.col("source1").alias("source"), F.col("source2").alias("item")),
        F.struct(F.col("source2").alias("source"), F.col("source1").alias("item")),
    )).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(known: DataFrame, counts: DataFrame, top_terms: int) -> DataFrame:
    cells = counts.groupBy("g", "n", "all_n").agg(F.count(F.lit(1)).alias("m")).join(known, "g")
    cells = cells.withColumns({"p": share("n", "total", "v"), "q": share("all_n", "all_total", "v")}).where("p > q").withColumn("value", distance("p", "q"))
    # a term of the first ranks is in one of the cells of as many first ranks, those of equal value included
    place = F.rank().over(Window.partitionBy("g").orderBy(F.desc("value")))
    best = cells.select("g", "n", "all_n", "value", place.alias("place")).where(F.col("place") <= top_terms).drop("place")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    found = counts.join(best, ["g", "n", "all_n"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return found.withColumn("rank", rank).where(F.col("rank") <= top_terms)
