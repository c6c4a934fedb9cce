"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinthread.llm.common import SALTS, WORD, row_hash, stored

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so often.
MOST_REPEATS = 3
#: Words of a block, unless a thousandth of the smallest target is less.
BLOCK_WORDS = 64
#: Documents that a shard of a source holds about.
SHARD_DOCS = 2000
#: Equal rows that stand together in a shard, at most.
TOGETHER = 500
#: Sources, and bytes of their names, that the driver may read.
CATALOGUE, CATALOGUE_BYTES = 10_000, 1 << 24
#: Divisors tried in one pass over the sources.
PROBES = 64
SEED = 17


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients weight / (2 * seats + 1), none above its cap; ties to the first.

    The quotas below a divisor are found by bisection, so a quota may be any
    integer; the last few seats go one by one.
    """
    weights = np.asarray(weights, dtype=np.float64)
    caps = np.where(weights > 0, np.asarray(caps, dtype=np.int64), 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)

    def quotas(divisor):
        return np.minimum(caps, np.minimum(np.floor(weights / divisor + 0.5), 2.0**62).astype(np.int64))

    low, high = 0.0, 2 * weights.max() + 1  # quotas(high) are all 0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high) or middle == 0:
            break
        if quotas(middle).sum() <= seats:
            high = middle
        else:
            low = middle
    given = quotas(high * (1 + 1e-12))  # equal quotients that differ by rounding stay together
    queue = [(-weights[i] / (2 * given[i] + 1), i) for i in range(len(weights)) if given[i] < caps[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def targets(sizes: list[int], weights=WEIGHTS, most: int = MOST_REPEATS) -> list[Fraction]:
    """Words wanted of each source: all sizes shared by weight, at most ``most`` times a size."""
    total = sum(sizes)
    share = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    free, left = [i for i, n in enumerate(sizes) if n > 0], Fraction(total)
    while free:
        unit = left / sum(share[i] for i in free)
        over = [i for i in free if unit * share[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * share[i]
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def with_sizes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: the words of the text, 0 for null."""
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("size", count)


# ------------------------------------------------------- the table of sources


def numbered(table: DataFrame, name: str, *order) -> DataFrame:
    """``table`` with its place (from 0) in an order without ties; the driver sees a count a partition."""
    parts = stored(table.repartitionByRange(*order).withColumn("of_part", F.spark_partition_id()), "ordered")
    counts = {r.of_part: r.n for r in parts.groupBy("of_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, so_far = [], 0
    for part in sorted(counts):
        offsets.append((part, so_far))
        so_far += counts[part]
    begin = table.sparkSession.createDataFrame(offsets, "of_part int, begin long")
    place = F.row_number().over(Window.partitionBy("of_part").orderBy(*order)) - 1
    return parts.withColumn(name, place.cast("long")).join(begin, "of_part").withColumn(name, F.col(name) + F.col("begin")).drop("of_part", "begin")


def with_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> tuple[DataFrame, int]:
    """(``sources`` (number, size) with target, the sum of sizes), as ``targets`` has it, over a table of any length.

    The words a unit of weight gets rise as sources reach their limit. Each pass
    finds those that do at the unit so far; exact whole numbers decide.
    """
    each = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int")).cast("long")
    sources = sources.withColumn("weight", each)
    some = F.col("size") > 0
    total = sources.agg(F.sum("size").alias("n")).first().n or 0
    unit = Fraction(0)

    def full(unit: Fraction):
        wide = "decimal(38,0)"
        return F.col("weight").cast(wide) * F.lit(str(unit.numerator)).cast(wide) > (
            F.col("size").cast(wide) * F.lit(str(most * unit.denominator)).cast(wide)
        )

    held = -1
    while True:
        at_limit = full(unit) & some
        found = sources.agg(
            F.sum(F.when(at_limit, F.col("size")).otherwise(0)).alias("size"), F.sum(F.when(at_limit, 1).otherwise(0)).alias("n"),
            F.sum(F.when(~at_limit & some, F.col("weight")).otherwise(0)).alias("weight"),
        ).first()
        if found.n == held or not found.weight:
            break
        held, unit = found.n, Fraction(total - most * found["size"], found.weight)
    target = F.when(full(unit) & some, (F.col("size") * most).cast("double")).when(
        some, F.lit(str(unit.numerator)).cast("double") * F.col("weight") / F.lit(str(unit.denominator)).cast("double")
    ).otherwise(0.0)
    return sources.withColumn("target", target), total


def with_quotas(sources: DataFrame, seats: int, block: int) -> DataFrame:
    """``sources`` (number, size, target) with quota: ``seats`` blocks by Sainte-Laguë on the targets.

    As ``sainte_lague`` has it, over a table of any length: a pass tries PROBES
    divisors at once, until no divisor is left between; what seats are left then
    go to the highest quotients in the order of the sources.
    """
    limit = F.ceil(F.col("size") / block * MOST_REPEATS).cast("long")
    top = sources.agg(F.max("target").alias("top"), F.sum(F.when(F.col("target") > 0, limit).otherwise(0)).alias("limit")).first()
    seats = min(seats, top["limit"] or 0)
    if seats <= 0:
        return sources.withColumn("quota", F.lit(0).cast("long"))

    def quota(divisor: float):
        return F.least(limit, F.floor(F.col("target") / F.lit(float(divisor)) + 0.5).cast("long"))

    def sums(divisors: list[float]) -> np.ndarray:
        """Seats given at each divisor."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(divisors), dtype=np.int64)
            for part in batches:
                caps = np.ceil(part["size"].to_numpy() / block * MOST_REPEATS).astype(np.int64)
                for i, d in enumerate(divisors):
                    total[i] += np.minimum(caps, np.minimum(np.floor(part["target"].to_numpy() / d + 0.5), 2.0**62).astype(np.int64)).sum()
            yield pd.DataFrame({"at": np.arange(len(divisors)), "n": total})

        found = sources.select("size", "target").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        return np.array([n for _, n in sorted(map(tuple, found))])

    # seats at ``high`` are too few or just enough, at ``low`` too many; most often the divisor is near the block
    low, high = 0.0, 2 * top["top"] + 1
    tried = [block * 2.0 ** (i / PROBES) for i in range(-PROBES // 2, PROBES // 2)]
    while tried:
        found = sums(tried)
        high = min([high, *(d for d, n in zip(tried, found, strict=True) if n <= seats)])
        low = max([low, *(d for d, n in zip(tried, found, strict=True) if n > seats)])
        # once no source gets two seats between the two, quotients tell the rest
        if seats in found or low and sources.where(quota(low) - quota(high) > 1).isEmpty():
            break
        step = (high - low) / (PROBES + 1)
        tried = sorted({low + i * step for i in range(1, PROBES + 1)} - {low, high, 0.0})
    sources = sources.withColumn("quota", quota(high))
    given = sources.agg(F.sum("quota").alias("n")).first().n
    if given < seats:
        more = sources.where((F.col("quota") < limit) & (F.col("target") > 0)).select(
            "number", (-F.col("target") / (2 * F.col("quota") + 1)).alias("quotient")
        )
        first = numbered(more, "turn", "quotient", "number").where(F.col("turn") < seats - given).select(F.col("number").alias("one"))
        sources = sources.join(first, F.col("number") == F.col("one"), "left")
        sources = sources.withColumn("quota", F.col("quota") + F.when(F.col("one").isNotNull(), 1).otherwise(0)).drop("one")
    return sources


def shares(sources: DataFrame, weights=WEIGHTS) -> tuple[DataFrame, int]:
    """((m_source, m_no, m_source_size, m_target, quota, docs) of ``sources`` (m_source, size, docs), the words of a block).

    A catalogue of up to CATALOGUE sources, checked in rows and bytes, is shared
    out on the driver; a longer one in passes over its table. Both give the same.
    """
    names = ["m_source", "m_no", "m_source_size", "m_target", "quota", "docs"]
    known = sources.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("m_source")).alias("bytes")).first()
    if known.n <= CATALOGUE and (known.bytes or 0) <= CATALOGUE_BYTES:
        rows = sorted(sources.collect(), key=lambda r: (r.m_source is None, r.m_source or ""))
        sizes = [r["size"] for r in rows]
        wanted = [float(t) for t in targets(sizes, weights)]
        block = block_words(min([t for t in wanted if t > 0], default=0))
        given = sainte_lague(wanted, round(sum(sizes) / block), [math.ceil(n / block * MOST_REPEATS) for n in sizes])
        table = [(r.m_source, i, r["size"], wanted[i], int(given[i]), r.docs) for i, r in enumerate(rows)]
        return sources.sparkSession.createDataFrame(table, "m_source string, m_no long, m_source_size long, m_target double, quota long, docs long"), block
    found, total = with_targets(stored(numbered(sources, "number", F.col("m_source").asc_nulls_last()), "sources"), weights)
    found = stored(found, "targets")
    block = block_words(found.where("target > 0").agg(F.min("target")).first()[0] or 0)
    found = stored(with_quotas(found, round(total / block), block), "quotas")
    return found.select("m_source", "number", "size", "target", "quota", "docs").toDF(*names), block


def block_words(least: float) -> int:
    """Words of a block where ``least`` is the smallest target."""
    return max(1, min(BLOCK_WORDS, int(least // 1000)))


# ------------------------------------------------------------------- the mix


def _coprime(n: int, key: int) -> int:
    """A seeded number below n (1 for n of 1) that shares no factor with it."""
    step = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), SEED) % n
    while math.gcd(step, n) != 1:
        step = (step + 1) % n
    return max(step, 1)


def _shared(columns: list[str], quota: str, size: str, block: int):
    """Sainte-Laguë inside a group: its quota shared on the sizes of its rows, ordered by ``columns``."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(columns).reset_index(drop=True)
        blocks = -(-part[size] // block)
        given = sainte_lague(part[size], int(part[quota].iloc[0]), MOST_REPEATS * blocks)
        return part[[*columns, size]].assign(given=given)

    return run


def planned(slim: DataFrame, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """(m_source, m_id, m_size, m_hash, m_run, m_rows, m_begin, ...) of distinct rows, cut into runs of equal ones.

    ``slim`` has (m_source, m_id, m_size, m_hash, m_rows): m_rows equal rows
    each. A run of m_rows documents of m_size words begins at the word m_begin
    of its shard, whose plan (m_cell words, m_blocks blocks of m_block words,
    m_rounds rounds and m_rest blocks more, m_step, m_shift) tells what is taken.
    """
    sources = stored(
        slim.groupBy("m_source").agg(F.sum(F.col("m_size") * F.col("m_rows")).alias("size"), F.sum("m_rows").alias("docs")), "sources"
    )
    sources, block = shares(sources, weights)
    # a source's shards in two steps, so that neither has many to share among
    sources = sources.withColumn("sides", F.ceil(F.sqrt(F.ceil(F.col("docs") / SHARD_DOCS))).cast("long")).drop("docs")

    # a source may have most rows: its plan goes to every salt
    salted = slim.withColumn("m_salt", F.pmod(F.xxhash64("m_hash"), F.lit(SALTS)).cast("int"))
    spread = sources.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("m_source", "of_source")
    items = salted.join(
        spread.withColumnRenamed("m_salt", "of_salt"), (F.col("m_salt") == F.col("of_salt")) & F.col("m_source").eqNullSafe(F.col("of_source"))
    ).drop("of_source", "of_salt", "m_salt")
    runs = F.floor((F.col("m_rows") - 1) / TOGETHER)
    items = items.withColumn("m_run", F.explode(F.sequence(F.lit(0).cast("long"), runs)))
    items = items.withColumn("m_rows", F.least(F.lit(TOGETHER).cast("long"), F.col("m_rows") - F.col("m_run") * TOGETHER))

    def drawn(salt: int):
        return F.xxhash64(F.lit(seed + salt), "m_id", "m_size", "m_hash", "m_run")

    items = stored(items.withColumns({
        "m_group": F.pmod(drawn(0), F.col("sides")), "m_shard": F.pmod(drawn(1), F.col("sides")), "m_order": drawn(2),
    }), "runs")
    shards = items.groupBy("m_no", "quota", "m_group", "m_shard").agg(F.sum(F.col("m_size") * F.col("m_rows")).alias("cell"))
    groups = (
        shards.groupBy("m_no", "quota", "m_group").agg(F.sum("cell").alias("cell")).groupBy("m_no")
        .applyInPandas(_shared(["m_no", "m_group"], "quota", "cell", block), "m_no long, m_group long, cell long, given long")
        .select("m_no", "m_group", F.col("given").alias("share"))
    )

    def plans(part: pd.DataFrame) -> pd.DataFrame:
        part = _shared(["m_no", "m_group", "m_shard"], "share", "cell", block)(part)
        blocks = np.maximum(-(-part["cell"] // block), 1).astype(np.int64)
        keys = [hash_of(a, b, c) for a, b, c in zip(part["m_no"], part["m_group"], part["m_shard"], strict=True)]
        return pd.DataFrame({
            "m_no": part["m_no"], "m_group": part["m_group"], "m_shard": part["m_shard"], "m_cell": part["cell"], "m_blocks": blocks,
            "m_rounds": part["given"] // blocks, "m_rest": part["given"] % blocks,
            "m_step": [_coprime(n, k) for n, k in zip(blocks.tolist(), keys, strict=True)], "m_shift": [(k >> 7) % n for n, k in zip(blocks.tolist(), keys, strict=True)],
        })

    def hash_of(*numbers: int) -> int:
        return xxhash.xxh64_intdigest(b"".join(int(x).to_bytes(8, "little", signed=True) for x in numbers), seed) >> 1

    kinds = "m_no long, m_group long, m_shard long, m_cell long, m_blocks long, m_rounds long, m_rest long, m_step long, m_shift long"
    cells = shards.join(groups, ["m_no", "m_group"]).groupBy("m_no", "m_group").applyInPandas(plans, kinds)
    keys = ["m_no", "m_group", "m_shard"]
    order = Window.partitionBy(*keys).orderBy("m_order", "m_id", "m_size", "m_hash", "m_run")
    words = F.col("m_size") * F.col("m_rows")
    placed = items.withColumn("m_begin", F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0)) - words)
    return placed.join(cells, keys).withColumn("m_block", F.lit(block).cast("long")).drop("quota", "sides", "m_order", *keys)


def chosen(number):
    """Whether a block of a shard is among the m_rest ones that the seed picks: a permutation of the blocks' numbers."""
    return F.pmod(number * F.col("m_step") + F.col("m_shift"), F.col("m_blocks")) < F.col("m_rest")


def taken_words(begin):
    """Words taken of the document of m_size words that begins at ``begin``."""
    end, size = begin + F.col("m_size"), F.col("m_block")
    over = F.sequence(F.floor(begin / size).cast("long"), F.floor((end - 1) / size).cast("long"))
    part = F.aggregate(over, F.lit(0).cast("long"), lambda acc, b: acc + F.when(
        chosen(b), F.least(end, (b + 1) * size) - F.greatest(begin, b * size)
    ).otherwise(0))
    return F.when(F.col("m_size") > 0, F.col("m_rounds") * F.col("m_size") + part).otherwise(0).cast("long")


def taken_copies(begin):
    """Copies of the whole document: the rounds, and one more if its middle word's block is chosen."""
    middle = F.floor((begin + F.floor(F.col("m_size") / 2)) / F.col("m_block")).cast("long")
    return F.when(F.col("m_size") > 0, F.col("m_rounds") + F.when(chosen(middle), 1).otherwise(0)).otherwise(0).cast("long")


def _slim(rows: DataFrame, size) -> DataFrame:
    """Distinct rows and their number; texts stay behind."""
    keys = {"m_source": F.col("source"), "m_id": F.col("doc_id"), "m_size": size, "m_hash": row_hash(rows)}
    return stored(rows.select(*(c.alias(k) for k, c in keys.items())).groupBy(*keys).agg(F.count(F.lit(1)).alias("m_rows")), "sizes")


def _joined(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Distinct ``rows`` as a struct ``m_row``, joined to their plans; equal rows are cut to one before they travel."""
    keyed = rows.select(
        F.struct(*rows.columns).alias("m_row"), F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_null"), row_hash(rows).alias("k_hash")
    )
    one = keyed.groupBy("k_id", "k_null", "k_hash").agg(F.first("m_row").alias("m_row"))
    plans = plans.withColumns({"k_id": F.coalesce("m_id", F.lit(0)), "k_null": F.col("m_id").isNull(), "k_hash": F.col("m_hash")})
    return one.join(plans, ["k_id", "k_null", "k_hash"])


def mix(sized: DataFrame, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """``sized`` (doc_id, source, size, ...) with source_size, target, taken and copies.

    The mix has as many words as all documents. Its blocks go to the sources by
    Sainte-Laguë on their targets, a source's blocks to groups of its shards and
    a group's to its shards by Sainte-Laguë on their words, all as integer
    quotas. A shard is a seeded hash class of a source's documents, about
    SHARD_DOCS of them, so a source with most of the rows is many shards; there
    is no limit to sources or shards. Within a shard the documents stand in
    seeded order and are cut into equal blocks. The quota takes all blocks so
    many times, and once more the blocks that a seeded permutation puts first.
    ``taken`` counts the words, a document's cut ones too; ``copies`` is the
    whole-document form: full rounds, and one more if the block of the
    document's middle word is taken once more. No document exceeds MOST_REPEATS
    times its size. Equal inputs give equal results, however they are parted.

    A null source is a source of its own, the last. Documents of no words take
    part with nothing taken. Very long texts are words like any other. Repeated
    rows count each; they stand together, TOGETHER at most in one shard. More
    columns, of any names and types, pass through; of those named source_size,
    target, taken and copies this operator's stay. No rows, no result.
    """
    sized = sized.drop("source_size", "target", "taken", "copies")
    plans = planned(_slim(sized, F.col("size").cast("long")), weights, seed)
    if set(sized.columns) == {"doc_id", "source", "size"}:  # the plans have all there is
        made = {"doc_id": F.col("m_id"), "source": F.col("m_source"), "size": F.col("m_size").cast(sized.schema["size"].dataType)}
        rows = plans.withColumn("m_row", F.struct(*(made[c].alias(c) for c in sized.columns)))
    else:
        rows = _joined(sized, plans)
    # runs of equal rows are told apart after the join
    rows = rows.withColumn("m_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_rows") - 1)))
    begin = F.col("m_begin") + F.col("m_at") * F.col("m_size")
    return rows.select(
        "m_row.*", F.col("m_source_size").alias("source_size"), F.col("m_target").alias("target"),
        taken_words(begin).alias("taken"), taken_copies(begin).cast("int").alias("copies"),
    )


def mixed_documents(docs: DataFrame, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (whole documents), unchanged.

    Sizes are counted once, and decided on without the texts.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    plans = planned(_slim(docs, size), weights, seed)
    each = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.col("m_rows") - 1), F.lit(0).cast("long"),
        lambda acc, at: acc + taken_copies(F.col("m_begin") + at * F.col("m_size")),
    )
    wanted = plans.select("m_id", "m_hash", each.alias("m_copies")).where("m_copies > 0")
    rows = _joined(docs, wanted)
    return rows.withColumn("m_copy", F.explode(F.sequence(F.lit(1).cast("long"), "m_copies"))).select("m_row.*")
