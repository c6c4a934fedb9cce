"""The registered queries of the tracking engine, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinthread.config import (
    DistanceMetricConfig,
    MemoryConfig,
    NormalizationConfig,
    RecordScorerConfig,
    ResolverConfig,
    config,
)
from kinthread.functions import clustering, memories, similarity, words
from kinthread.operators import evaluation as E
from kinthread.operators import frames as R
from kinthread.operators import graph as G
from kinthread.operators import resolution, scoring
from kinthread.operators.word_pairs import WordPairs
from kinthread.plans import normalization, sweep, tracking
from kinthread.runtime import scratch_path, stored
from kinthread.schema import ElementType, FieldSchema, RecordSchema
from kinthread.sources import tables
from kinthread.streaming.tracking import StreamTracker

SCHEMA = RecordSchema([
    FieldSchema("name", ElementType.String), FieldSchema("origin", ElementType.String),
    FieldSchema("code", ElementType.String), FieldSchema("members", ElementType.MultiStrings),
])
STRINGS = RecordSchema(SCHEMA.fields[:3])
LV = DistanceMetricConfig("lv")
OPTI = DistanceMetricConfig()

# ---------------------------------------------------------------------- fixtures

#: Five noisy frames of all suppliers; valid in Spark and DuckDB. A sixth of a frame's
#: records have nothing in common with the entity's others: births and misses.
FRAMES_SQL = """
WITH f AS (SELECT 0 AS frame_idx UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4),
entity AS (SELECT s_suppkey AS k, n_name || '/' || r_name AS origin,
  CAST(100000 + (s_suppkey * 7919) % 89989 AS VARCHAR(20)) AS code,
  translate(CAST(100000 + (s_suppkey * 7919) % 899981 AS VARCHAR(20)), '0123456789', 'abehilnors') || ' ' ||
  translate(CAST(CAST(round(abs(s_acctbal) * 100) AS BIGINT) AS VARCHAR(20)), '0123456789', 'umtdrskaeo') AS name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
base AS (SELECT frame_idx, k, (k + frame_idx) % 6 = 0 AS other,
  CASE (k + 2 * frame_idx) % 5 WHEN 0 THEN substr(name, 2) WHEN 1 THEN name || 'e' WHEN 2 THEN replace(name, 'e', 'a') ELSE name END AS name,
  CASE WHEN (k + frame_idx) % 7 = 0 THEN NULL ELSE origin END AS origin,
  CASE WHEN (k + 3 * frame_idx) % 11 = 0 THEN replace(code, '1', '7') ELSE code END AS code, name AS clean FROM entity CROSS JOIN f)
SELECT frame_idx, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY k) - 1 AS BIGINT) AS record_idx,
  CASE WHEN other THEN reverse(name) ELSE name END AS name, CASE WHEN other THEN NULL ELSE origin END AS origin,
  CASE WHEN other THEN reverse(code) ELSE code END AS code, split(CASE WHEN other THEN reverse(clean) ELSE clean END, ' ') AS members FROM base
"""
EVENTS_SQL = """
SELECT tracker_id, frame_idx, record_idx, value FROM (
  SELECT user_id AS tracker_id, CAST(dayofyear(CAST(ts AS DATE)) - 1 AS INT) AS frame_idx, event_id AS record_idx,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS value,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS rn FROM events) WHERE rn = 1
"""
CONVERSATIONS_SQL = """
SELECT conv_id AS tracker_id, CAST(turn AS INT) AS frame_idx, conv_id AS record_idx, role AS value FROM conversations
"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five frames of FRAMES_SQL, numbered by the frame operators."""
    key = F.col("s_suppkey")
    digits = lambda n: n.cast("long").cast("string")
    clean = F.concat(
        F.translate(digits(F.lit(100000) + (key * 7919) % 899981), "0123456789", "abehilnors"), F.lit(" "),
        F.translate(digits(F.round(F.abs("s_acctbal") * 100)), "0123456789", "umtdrskaeo"),
    )
    entity = (
        _read(spark, sf_dir, "supplier")
        .join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(key, clean.alias("clean"), F.concat("n_name", F.lit("/"), "r_name").alias("origin"), digits(F.lit(100000) + (key * 7919) % 89989).alias("code"))
    )
    made = []
    for k in range(5):
        turn, other = (key + 2 * k) % 5, (key + k) % 6 == 0
        name, code = F.col("clean"), F.col("code")
        noisy = (
            F.when(turn == 0, F.substring(name, 2, 1 << 20)).when(turn == 1, F.concat(name, F.lit("e")))
            .when(turn == 2, F.replace(name, F.lit("e"), F.lit("a"))).otherwise(name)
        )
        coded = F.when((key + 3 * k) % 11 == 0, F.replace(code, F.lit("1"), F.lit("7"))).otherwise(code)
        made.append(entity.select(
            "s_suppkey", F.when(other, F.reverse(noisy)).otherwise(noisy).alias("name"),
            F.when(~other & ((key + k) % 7 != 0), F.col("origin")).alias("origin"),
            F.when(other, F.reverse(coded)).otherwise(coded).alias("code"),
            F.split(F.when(other, F.reverse(name)).otherwise(name), " ").alias("members"),
        ))
    return R.records_of(made, SCHEMA, ["s_suppkey"])


def events_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    first = F.row_number().over(Window.partitionBy("user_id", day).orderBy("event_id")) == 1
    rows = _read(spark, sf_dir, "events").withColumn("first", first).where("first")
    return rows.select(
        F.col("user_id").alias("tracker_id"), (F.dayofyear(day) - 1).cast("int").alias("frame_idx"),
        F.col("event_id").alias("record_idx"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("value"),
    )


def conversation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("tracker_id"), F.col("turn").cast("int").alias("frame_idx"),
        F.col("conv_id").alias("record_idx"), F.col("role").alias("value"),
    )


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("w1")).crossJoin(names.select(F.col("p_name").alias("w2")))


def sim_graphemes(spark, sf_dir):
    """Similarities of words whose letters are several code points: accents that combine, joined emoji."""
    pairs = word_pairs(spark, sf_dir)
    odd = {w: F.replace(F.replace(F.col(w), F.lit("e"), F.lit("e\u0301")), F.lit("o"), F.lit("\U0001f469\u200d\U0001f467")) for w in ("w1", "w2")}
    pairs = pairs.withColumns(odd)
    return pairs.withColumn("similarity", F.round(similarity.similarity_udf(OPTI)("w1", "w2").cast("double"), 5))


def _frame(records: DataFrame, k: int) -> DataFrame:
    return records.where(F.col("frame_idx") == k)


def _first_memories(records: DataFrame, schema: RecordSchema, k: int = 0) -> DataFrame:
    """Trackers of frame ``k`` with their records as memories."""
    return _frame(records, k).select(F.col("record_idx").alias("tracker_id"), *(tracking.cells(schema, i).alias(scoring.memory_name(i)) for i in range(len(schema.fields))))


def _rounded_scores(trackers: DataFrame, records: DataFrame, threshold: float, scorer: RecordScorerConfig = RecordScorerConfig()) -> DataFrame:
    found = scoring.score_pairs(trackers, records, STRINGS, LV, scorer, threshold)
    found = found.withColumn("score", F.round(F.col("score").cast("double"), 5))
    return found.withColumn("score", F.col("score").cast("float"))


def _scores(spark: SparkSession, sf_dir: str, threshold: float = 0.4137, scorer: RecordScorerConfig = RecordScorerConfig()) -> DataFrame:
    records = frames_table(spark, sf_dir).drop("members")
    return _rounded_scores(_first_memories(records, STRINGS), _frame(records, 1), threshold, scorer)


def _best_matches(spark: SparkSession, sf_dir: str, match: Callable[[DataFrame], DataFrame] = resolution.best_match) -> DataFrame:
    """The matching of ``_scores``, better scores first."""

    def over(trackers: DataFrame, records: DataFrame, threshold: float | None) -> DataFrame:
        if threshold is None:
            return _rounded_scores(trackers, records, 0.4137)
        # scores that are one when rounded are on one side
        return _rounded_scores(trackers, records, threshold - 1e-4).where(F.col("score") > F.lit(threshold).cast("float"))

    records = frames_table(spark, sf_dir).drop("members")
    return resolution.best_match_by_steps(_first_memories(records, STRINGS), _frame(records, 1), over, match=match)


# ----------------------------------------------------------------------- queries


def _similarity(metric: DistanceMetricConfig):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = similarity.similarity_udf(metric)("w1", "w2")
        return word_pairs(spark, sf_dir).select("w1", "w2", F.round(value.cast("double"), 5).alias("similarity"))

    return run


def frames_scan(spark, sf_dir):
    return frames_table(spark, sf_dir)


def frames_schema_prune(spark, sf_dir):
    return R.prune(frames_table(spark, sf_dir), RecordSchema(SCHEMA.fields[1:3]), ["frame_idx", "record_idx"])


def frames_write_back(spark, sf_dir):
    """Null lists come back as empty ones, lists as joined text."""
    records = frames_table(spark, sf_dir).withColumn("members", F.when(F.col("record_idx") % 3 != 0, F.col("members")))
    out = R.to_frames(records, SCHEMA)
    return out.select("frame_idx", "record_idx", "name", F.size("members").alias("n_members"), tables.join_list(F.col("members")).alias("joined"))


def list_columns(spark, sf_dir):
    """Splitting, filtering, cutting and joining of separated text."""
    part = _read(spark, sf_dir, "part")
    text = F.concat_ws("|", "p_brand", F.lit(""), "p_type", "p_name")
    items = tables.split_list(text)
    return part.select(
        "p_partkey", F.size(items).alias("n_items"), tables.join_list(tables.cut_list(items, 2)).alias("first_two"),
        tables.cut_text(text, 9).alias("cut"),
    )


def sim_lv_native(spark, sf_dir):
    value = similarity.native_levenshtein(F.col("w1"), F.col("w2"))
    return word_pairs(spark, sf_dir).select("w1", "w2", F.round(value.cast("double"), 5).alias("similarity"))


def _all_similarities(spark: SparkSession, sf_dir: str, schema: RecordSchema) -> DataFrame:
    """(left_idx, right_idx, distances) of all records of frame 0 and of frame 1."""
    records = frames_table(spark, sf_dir)
    found = scoring.all_similarities(_first_memories(records, schema), _frame(records, 1), schema, LV)
    return found.withColumnsRenamed({"tracker_id": "left_idx", "record_idx": "right_idx"})


def multi_similarity(spark, sf_dir):
    """List similarity of members, frame 0 against frame 1."""
    found = _all_similarities(spark, sf_dir, RecordSchema(SCHEMA.fields[3:]))
    return found.select("left_idx", "right_idx", F.round(F.get("distances", 0).cast("double"), 5).alias("similarity"))


def _scored(scorer: RecordScorerConfig):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Scores of frame 0 against frame 1 of all pairs, over name, origin, code."""
        records = frames_table(spark, sf_dir)
        found = scoring.all_scores(_first_memories(records, STRINGS), _frame(records, 1), STRINGS, LV, scorer, 4)
        return found.withColumnsRenamed({"tracker_id": "left_idx", "record_idx": "right_idx"})

    return run


WEIGHTED = RecordScorerConfig("weighted-average", (1.0, 2.0, 3.0), 0.7)
QUADRATIC = RecordScorerConfig("weighted-quadratic", (1.0, 2.0, 3.0), 0.7)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 5 if n == "score" else 4) for n in names})


def interest_filter(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir).select("tracker_id", "record_idx", "score"), "score")


def _ranked(spark: SparkSession, sf_dir: str, k: int, other: int) -> DataFrame:
    """Scores of frame ``k``, as memories, against another, with the ranks that each of its rows gives."""
    records = frames_table(spark, sf_dir).drop("members")
    return scoring.ranked_scores(_first_memories(records, STRINGS, k), _frame(records, other), STRINGS, LV, RecordScorerConfig(), 0.4137, 5)


def rank_records(spark, sf_dir):
    return _ranked(spark, sf_dir, 0, 1).select("tracker_id", "record_idx", "score", F.col("rank").alias("record_rank"))


def rank_trackers(spark, sf_dir):
    # a memory of one word is as like a word as that to it: records are held against trackers
    found = _ranked(spark, sf_dir, 1, 0).select(F.col("record_idx").alias("tracker_id"), F.col("tracker_id").alias("record_idx"), "score", "rank")
    return found.withColumnRenamed("rank", "tracker_rank")


def resolve_simple(spark, sf_dir):
    return _rounded(resolution.simple(_scores(spark, sf_dir)), "score")


def resolve_best_match(spark, sf_dir):
    return _rounded(_best_matches(spark, sf_dir), "score")


def resolve_mutual_best(spark, sf_dir):
    """The same matching in distributed rounds, of those over a falling threshold at a time."""
    return _rounded(_best_matches(spark, sf_dir, resolution.mutual_best), "score")


def new_trackers(spark, sf_dir):
    records = frames_table(spark, sf_dir)
    matches = _best_matches(spark, sf_dir)
    return resolution.unmatched_records(_frame(records, 1), matches).select("record_idx", "name", "code")


def unmatched_trackers(spark, sf_dir):
    trackers = _first_memories(frames_table(spark, sf_dir).drop("members"), STRINGS)
    return resolution.unmatched_trackers(trackers, _best_matches(spark, sf_dir)).select("tracker_id")


def dead_trackers(spark, sf_dir):
    """Streak of misses after each chain's last match, and who outlived a limit of one."""
    return resolution.final_streaks(events_chains(spark, sf_dir)).withColumn("alive", resolution.is_alive(1))


def memory_bruteforce(spark, sf_dir):
    return _histories(spark, sf_dir, "bruteforce")


def _histories(spark, sf_dir, strategy: str, chains=events_chains) -> DataFrame:
    """The memory of each chain's whole history, as text in its order."""
    rows = chains(spark, sf_dir).groupBy("tracker_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("frame_idx", "value")))).alias("h")
    )
    history = F.transform("h", lambda x: F.array(x["value"]))
    memory = memories.memory_column(MemoryConfig(strategy), history)
    return rows.select("tracker_id", F.array_join(F.flatten(memory), ",").alias("memory"))


def _memory(strategy: str, chains=events_chains):
    return lambda spark, sf_dir: _histories(spark, sf_dir, strategy, chains)


def memory_median(spark, sf_dir):
    return _part_memory(spark, sf_dir, MemoryConfig("median"), "name")


def memory_mw_median(spark, sf_dir):
    return _part_memory(spark, sf_dir, MemoryConfig("mw-median", 0.6, OPTI), "members")


def memory_mw_mostfrequent(spark, sf_dir):
    return _part_memory(spark, sf_dir, MemoryConfig("mw-mostfrequent", 0.6, OPTI), "members")


def _part_memory(spark, sf_dir, memory: MemoryConfig, column: str) -> DataFrame:
    """Memory over the five frames of every code."""
    records = frames_table(spark, sf_dir)
    multi = column == "members"
    cell = F.col(column) if multi else F.array(column)
    rows = records.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "record_idx", cell.alias("c")))).alias("h"))
    kind = ElementType.MultiStrings if multi else ElementType.String
    value = memories.memory_column(memory, F.transform("h", lambda x: x["c"]), kind)
    return rows.select("code", F.array_join(F.flatten(value), ",").alias("memory"))


def running_latest(spark, sf_dir):
    """The latest value before each node."""
    return memories.running_latest(events_chains(spark, sf_dir)).select("tracker_id", "frame_idx", "latest")


def running_median(spark, sf_dir):
    """The median word of the values before each node of every chain of events."""
    found = memories.running_memory(events_chains(spark, sf_dir), MemoryConfig("median"))
    return found.select("tracker_id", "frame_idx", F.array_join(F.flatten("memory"), ",").alias("memory"))


def running_mostfrequent(spark, sf_dir):
    """The most frequent values before each node."""
    found = memories.running_memory(events_chains(spark, sf_dir), MemoryConfig("mostfrequent"))
    return found.select("tracker_id", "frame_idx", F.array_join(F.array_sort(F.flatten("memory")), ",").alias("memory"))


def edit_scripts(spark, sf_dir):
    """The edit scripts between all words, edit by edit."""
    script = words.edit_script_udf()("w1", "w2")
    text = F.transform(script, lambda e: F.concat(e["kind"], e["at"].cast("string")))
    return word_pairs(spark, sf_dir).select("w1", "w2", F.array_join(text, ",").alias("script"))


def median_words(spark, sf_dir):
    """The median of every code's names over the frames."""
    names = frames_table(spark, sf_dir).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "record_idx", "name"))).alias("h"))
    return names.select("code", words.median_word_udf()(F.transform("h", lambda x: x["name"])).alias("median"))


def word_clusters(spark, sf_dir):
    """Clusters of every code's names."""
    names = frames_table(spark, sf_dir).groupBy("code").agg(F.sort_array(F.collect_list("name")).alias("names"))
    found = clustering.word_clusters_udf(OPTI, 0.6)("names")
    return names.select("code", F.posexplode(found).alias("cluster", "members")).select("code", "cluster", F.array_join("members", ",").alias("members"))


def fill_missing_clusters(spark, sf_dir):
    """Nulls take the last value to the left, or else the next to the right."""
    return clustering.fill_missing(events_chains(spark, sf_dir)).select("tracker_id", "frame_idx", F.col("value").alias("filled"))


def range_fill(spark, sf_dir):
    """Every value of a chain at all its nodes from the value's first to its last."""
    return clustering.fill_spans(events_chains(spark, sf_dir)).select("tracker_id", "frame_idx", "value")


def streaks(spark, sf_dir):
    """Frames missed before each match."""
    return resolution.missed_before(events_chains(spark, sf_dir))


def chain_edges(spark, sf_dir):
    return G.edges(conversation_chains(spark, sf_dir))


def chain_positions(spark, sf_dir):
    return G.with_positions(events_chains(spark, sf_dir)).select("tracker_id", "frame_idx", "pos", "comes_in", "goes_out")


def chain_lengths(spark, sf_dir):
    return E.chain_lengths(events_chains(spark, sf_dir))


def chain_stats(spark, sf_dir):
    return E.length_statistics(conversation_chains(spark, sf_dir)).withColumn("average", F.round(F.col("average").cast("double"), 4)).withColumn("histogram", F.array_join(F.col("histogram").cast("array<string>"), ","))


def chains_at_least(spark, sf_dir):
    return G.chains_at_least(conversation_chains(spark, sf_dir), 6)


def first_chain_at_least(spark, sf_dir):
    return G.chains_at_least(conversation_chains(spark, sf_dir), 6, start=10)


def tail_counts(spark, sf_dir):
    return E.tail_counts(events_chains(spark, sf_dir), (2, 5, 10, 25))


def _event_nodes(chains: DataFrame) -> DataFrame:
    """Nodes by day: a record per user, matched or not."""
    users, days = chains.select("tracker_id").distinct(), chains.select("frame_idx").distinct()
    return days.crossJoin(users).select("frame_idx", F.col("tracker_id").alias("record_idx"))


def graph_ratios(spark, sf_dir):
    chains = events_chains(spark, sf_dir).withColumn("record_idx", F.col("tracker_id"))
    found = E.graph_properties(chains, _event_nodes(chains))
    text = {c: F.when(F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.4f", F.col(c).cast("double"))) for c in found.columns if c != "frame_idx"}
    return found.withColumns(text)


def average_ratios(spark, sf_dir):
    chains = events_chains(spark, sf_dir).withColumn("record_idx", F.col("tracker_id"))
    return _rounded(E.average_match_ratios(E.graph_properties(chains, _event_nodes(chains))), "records_match_ratio", "trackers_match_ratio")


def start_end_frames(spark, sf_dir):
    return E.start_end_frames(events_chains(spark, sf_dir), 30)


def match_histograms(spark, sf_dir):
    records = frames_table(spark, sf_dir).drop("members")
    return E.match_histograms(_scores(spark, sf_dir), _first_memories(records, STRINGS), _frame(records, 1))


def divergence_conflict(spark, sf_dir):
    return _rounded(E.divergence_and_conflict(match_histograms(spark, sf_dir)), "divergence", "conflict")


def histogram_merge(spark, sf_dir):
    """Histograms of event counts by type, summed."""
    counts = events_chains(spark, sf_dir).groupBy("value", "tracker_id").agg(F.count(F.lit(1)).alias("n")).groupBy("value", "n").agg(F.count(F.lit(1)).alias("m"))
    parts = counts.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("n", "m"))).alias("counts"))
    dense = parts.select(F.transform(F.sequence(F.lit(0).cast("long"), F.array_max(F.map_keys("counts"))), lambda i: F.coalesce(F.col("counts")[i], F.lit(0).cast("long"))).alias("histogram"))
    return E.merge_histograms(dense)


def histogram_mean_median(spark, sf_dir):
    counts = E.chain_lengths(events_chains(spark, sf_dir)).groupBy(F.col("length").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(E.histogram_mean_median(counts), "mean")


def value_counts(spark, sf_dir):
    """Distinct values of each word feature, with counts."""
    return E.value_counts(frames_table(spark, sf_dir), STRINGS.names)


def chain_consistency(spark, sf_dir):
    return _rounded(E.consistency(events_chains(spark, sf_dir)), "consistency")


def chain_consistency_strict(spark, sf_dir):
    return _rounded(E.consistency(events_chains(spark, sf_dir).where("value is not null"), strict=True), "consistency")


def mean_consistency(spark, sf_dir):
    return _rounded(E.consistency(events_chains(spark, sf_dir)).agg(F.avg("consistency").alias("consistency")), "consistency")


def results_in_box(spark, sf_dir):
    lengths = E.chain_lengths(conversation_chains(spark, sf_dir))
    return E.in_box(lengths, "length", "lifespan", (3, 6), (3, 5))


def group_results(spark, sf_dir):
    lengths = E.chain_lengths(conversation_chains(spark, sf_dir))
    found = E.group_results(lengths, F.col("tracker_id") % 4, ["length", "lifespan"], F.col("length") <= 5)
    return found.select("key", F.size("results").alias("n"), F.element_at("results", -1)["length"].alias("longest"))


def column_distance_sum(spark, sf_dir):
    """Similarities of every name to one word, summed."""
    found = E.column_similarity_sum(frames_table(spark, sf_dir), "name", "almond", ["frame_idx"])
    return found.select("frame_idx", F.round("total", 3).alias("total"))


def product_distance_sum(spark, sf_dir):
    """Similarities over all pairs of names of consecutive frames, summed, and how many of them were computed."""
    found = E.consecutive_similarity_sums(frames_table(spark, sf_dir), "name")
    return found.select("frame_idx", F.round("total", 2).alias("total"), "pairs", "computations")


def chain_records(spark, sf_dir):
    """Nodes joined to their records: chains of one code over the frames."""
    records = frames_table(spark, sf_dir)
    chains = records.select(F.substring("code", 2, 9).cast("long").alias("tracker_id"), "frame_idx", "record_idx")
    return G.dereference(chains, records.select("frame_idx", "record_idx", "name", "origin")).select("tracker_id", "frame_idx", "record_idx", "name", "origin")


# -------------------------------------------------------------- whole processes


def _rules(threshold: float = 0.6137, limit: int = 2, **changes):
    return config(
        SCHEMA, LV, memory_config=MemoryConfig("median"), multistring_memory_config=MemoryConfig("bruteforce"),
        interest_threshold=threshold, limit_no_match_streak=limit, **changes,
    )


def _tracked(spark, sf_dir, threshold: float = 0.6137, words: WordPairs | None = None, diagnostics: bool = True, **changes):
    """A run over the five frames: names, origins and codes remember their median word, members all lists."""
    records = frames_table(spark, sf_dir)
    return tracking.track(_rules(threshold, **changes), SCHEMA, records, words, diagnostics), records


def tracking_defaults(spark, sf_dir):
    """A run with the default metric and memories."""
    rules = config(SCHEMA, interest_threshold=0.6, limit_no_match_streak=2)
    return tracking.track(rules, SCHEMA, frames_table(spark, sf_dir)).chain_nodes


def tracking_end_to_end(spark, sf_dir):
    return _tracked(spark, sf_dir)[0].chain_nodes


def tracking_word_pairs(spark, sf_dir):
    """A run whose similarities come from a table of word pairs."""
    return _tracked(spark, sf_dir, words=WordPairs(spark, LV))[0].diag_records.select(
        "tracker_id", "frame_idx", "record_idx", F.round(F.col("score").cast("double"), 5).alias("score"),
        *(F.round(F.get("distances", i).cast("double"), 4).alias(f"d{i}") for i in range(4)),
    )


#: (threshold, frames a tracker may miss, strategy) of the runs of ``sweep_chains``.
SWEPT = [(0.6137, 2, "best-match"), (0.6137, 2, "simple"), (0.4137, 1, "simple"), (0.7137, 1, "best-match")]


#: Those of ``sweep_summaries``.
SUMMED = SWEPT[1:]


def sweep_chains(spark, sf_dir):
    """The chains of several configurations that run side by side."""
    rules = [_rules(threshold, limit, resolver_config=ResolverConfig(strategy)) for threshold, limit, strategy in SWEPT]
    return sweep.track_all(rules, SCHEMA, frames_table(spark, sf_dir)).chains()


def sweep_summaries(spark, sf_dir):
    """What a stored sweep says of its configurations, read back from JSON."""
    records, path = stored(frames_table(spark, sf_dir), "frames"), scratch_path(spark, "summaries")
    rules = [_rules(threshold, limit, resolver_config=ResolverConfig(strategy)) for threshold, limit, strategy in SUMMED]
    sweep.run_sweep(rules, SCHEMA, records, "name", path)
    found = tables.load_json(spark, path)
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    frame = lambda x: F.concat_ws(":", x["frame_idx"], x["starts"], x["ends"])
    ratios = ("average", "avg_records_match_ratio", "avg_trackers_match_ratio", "consistency")
    return found.select(
        F.get_json_object("config", "$.tracker.interest_threshold").cast("double").alias("threshold"),
        F.get_json_object("config", "$.resolver.resolving_strategy").alias("strategy"), "median", "max", "min",
        *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ratios),
        *(numbers(c).alias(c) for c in ("histogram", "histogram_record_matchs", "histogram_tracker_matchs")),
        F.array_join(F.transform("start_end", frame), ",").alias("start_end"),
        *(F.round(F.get("distances", i)["distance"], 4).alias(f"d{i}") for i in range(4)),
    )


def tracking_stream(spark, sf_dir):
    """The frames as a stream, each in two deliveries among others' rows, then a tenth of the first once more: the batch run's chains, and the rows that came too late."""
    records, folder = stored(frames_table(spark, sf_dir), "frames"), scratch_path(spark, "arrivals")
    checkpoint, state = scratch_path(spark, "offsets"), scratch_path(spark, "stream")
    frame, half = F.col("frame_idx"), F.col("record_idx") % 2
    arrivals = [((frame == k) & (half == 0)) | ((frame == k - 1) & (half == 1)) for k in range(6)]
    for rows in [*arrivals, (frame == 0) & (F.col("record_idx") % 10 == 0)]:
        records.where(rows).write.mode("append").parquet(folder)
        tracker = StreamTracker(_rules(), SCHEMA, state, delay=1)  # a driver of its own each time
        tracker.start(spark.readStream.schema(records.schema).parquet(folder), checkpoint).awaitTermination()
    chains = tracker.finish().chain_nodes.select(F.lit("chain").alias("kind"), "tracker_id", "frame_idx", "record_idx")
    return chains.union(tracker.late().select(F.lit("late"), F.lit(None).cast("long"), "frame_idx", "record_idx"))


def stored_graph(spark, sf_dir):
    """A run that is stored, stored again as it was read, and read after the first version has gone: its chains, with the scores of their matches."""
    path = scratch_path(spark, "graph")
    tables.save_graph(_tracked(spark, sf_dir)[0], path)
    tables.save_graph(tables.read_graph(spark, path), path)
    tables.prune_graph(spark, path)
    store = tables.GraphStore()
    store.set_graph(tables.read_graph(spark, path))
    scores = store.take_diagnostics()[0].select("tracker_id", "frame_idx", "record_idx", F.round(F.col("score").cast("double"), 5).alias("score"))
    return store.take_graph().chain_nodes.join(scores, ["tracker_id", "frame_idx", "record_idx"], "left")


def one_chain(spark, sf_dir):
    """The first chain of a run of the default frames: its matched records, how many they are and how many frames they span."""
    graph, records = _tracked(spark, sf_dir)
    chain = graph.materialize_tracking_chain(graph.trackers_ids.first()[0], records, SCHEMA)
    nodes = G.chain_of(graph.chain_nodes, graph.trackers_ids.first()[0])
    rows = chain.as_dataframe().withColumns({"members": tables.join_list(F.col("members")), "length": F.lit(chain.length), "lifespan": F.lit(chain.lifespan)})
    return rows.join(nodes, "frame_idx")


def materialize_memories(spark, sf_dir):
    """What the trackers remember of their strings at every frame of their lives, nothing at their births."""
    graph, records = _tracked(spark, sf_dir)
    words = [F.array_join(F.get("memory", i), ",").alias(n) for i, n in enumerate(STRINGS.names)]
    return G.materialize(graph, records, SCHEMA).select("tracker_id", "frame_idx", "record_idx", *words)


def tracking_pairs(spark, sf_dir):
    """Pairs that a run's frames could meet, and those over the threshold."""
    return _tracked(spark, sf_dir)[0].diag_pairs.select("frame_idx", "possible", "kept")


def tracking_simple(spark, sf_dir):
    return _tracked(spark, sf_dir, diagnostics=False, resolver_config=ResolverConfig("simple"))[0].chain_nodes


def tracking_diagnostics(spark, sf_dir):
    found = _tracked(spark, sf_dir)[0].diag_records
    return found.select("tracker_id", "frame_idx", "record_idx", F.round(F.col("score").cast("double"), 5).alias("score"), F.size("distances").alias("n_features"))


def tracking_distances(spark, sf_dir):
    """Similarities of every feature of every interesting pair of a run."""
    found = _tracked(spark, sf_dir)[0].diag_records
    return found.select("tracker_id", "frame_idx", "record_idx", *(F.round(F.get("distances", i).cast("double"), 4).alias(f"d{i}") for i in range(4)))


def tracking_memories(spark, sf_dir):
    """What the trackers of a run remember of their strings when they meet each frame."""
    words = [F.array_join(F.get("memory", i), ",").alias(n) for i, n in enumerate(STRINGS.names)]
    return _tracked(spark, sf_dir)[0].diag_memory.select("tracker_id", "frame_idx", *words)


def conflict_ratios(spark, sf_dir):
    """Ratios of a run of a low threshold whose trackers may share records, as some do."""
    graph = _tracked(spark, sf_dir, 0.3137, diagnostics=False, resolver_config=ResolverConfig("simple"))[0]
    found = E.graph_properties(graph.chain_nodes, graph.nodes)
    return found.select("frame_idx", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("records_match_ratio", "conflict_ratio")))


def tracking_histograms(spark, sf_dir):
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("histogram_record_matchs", "histogram_tracker_matchs")}
    return _tracked(spark, sf_dir)[0].diag_resolving.withColumns(text)


def memory_distances(spark, sf_dir):
    graph = _tracked(spark, sf_dir)[0]
    return _rounded(E.mean_memory_distances(graph.diag_records, graph.chain_nodes), "distance")


def materialize_chain(spark, sf_dir):
    graph, records = _tracked(spark, sf_dir)
    return G.materialize(graph, records, SCHEMA).select("tracker_id", "frame_idx", "record_idx", "record.name", "record.code", F.size("memory").alias("n_memories"))


NORMALIZE = NormalizationConfig(0.6, 2, True, OPTI)


def normalize_end_to_end(spark, sf_dir):
    graph, records = _tracked(spark, sf_dir)
    done = normalization.normalize(graph, records, SCHEMA, NORMALIZE)
    return done.withColumn("members", F.array_join("members", "|"))


def sampled_chains(spark, sf_dir):
    """Fifty chains that a seed picks."""
    return G.sample_ids(events_chains(spark, sf_dir), 50, seed=3)


def yearly_csv(spark, sf_dir):
    """The frames as yearly CSV, each with another order of columns and one without origin, read by name."""
    records = frames_table(spark, sf_dir).drop("members")
    path = scratch_path(spark, "yearly")
    for k in range(5):
        columns = STRINGS.names[k % 3 :] + STRINGS.names[: k % 3]
        rows = _frame(records, k).repartitionByRange(4, "record_idx").sortWithinPartitions("record_idx")
        rows.select(*(c for c in columns if k != 2 or c != "origin")).write.option("header", True).csv(f"{path}/{1835 + k}.csv")
    return tables.read_yearly_csv(spark, path, range(1835, 1840)).select("frame_idx", "line", *STRINGS.names)


def written_csv(spark, sf_dir):
    """The frames written as yearly CSV and read back: lists are joined, nulls stay null."""
    path = scratch_path(spark, "written")
    tables.write_yearly_csv(frames_table(spark, sf_dir), path)
    found = spark.read.option("header", True).csv(path)
    return found.select("frame_idx", F.col("record_idx").cast("long").alias("record_idx"), *SCHEMA.names)


def _blocked(threshold: float, metric: DistanceMetricConfig = LV):
    def run(spark, sf_dir):
        """Scores by candidates, or by scanning in blocks (see ``score_pairs``): the same pairs as all against all."""
        records = frames_table(spark, sf_dir).drop("members")
        found = scoring.score_pairs(_first_memories(records, STRINGS), _frame(records, 1), STRINGS, metric, RecordScorerConfig(), threshold, all_pairs=0)
        found = found.withColumn("score", F.round(F.col("score").cast("double"), 5))
        return _rounded(found.select("tracker_id", "record_idx", "score"), "score")

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "frames_scan": frames_scan, "frames_schema_prune": frames_schema_prune, "frames_write_back": frames_write_back,
    "list_columns": list_columns, "yearly_csv": yearly_csv, "sim_lv": _similarity(LV), "sim_lv_native": sim_lv_native,
    "sim_lv_sigmoid": _similarity(DistanceMetricConfig("lv", use_sigmoid=True)), "sim_lv_opti": _similarity(OPTI),
    "sim_lv_substring": _similarity(DistanceMetricConfig("lv_substring", lv_substring_weight=0.6)),
    "sim_lv_edit": _similarity(DistanceMetricConfig("lv_edit", lv_edit_weights=(0.5, 1.0, 1.5))),
    "sim_lv_multiword": _similarity(DistanceMetricConfig("lv_multiword", lv_multiword_separator=" ")),
    "sim_graphemes": sim_graphemes, "multi_similarity": multi_similarity, "score_average": _scored(RecordScorerConfig()),
    "score_weighted": _scored(WEIGHTED), "score_quadratic": _scored(QUADRATIC), "interest_filter": interest_filter,
    "blocked_scores": _blocked(0.4137), "blocked_scores_060": _blocked(0.6037), "blocked_scores_079": _blocked(0.7937),
    "blocked_substring": _blocked(0.6037, DistanceMetricConfig("lv_substring", lv_substring_weight=0.6)),
    "blocked_multiword": _blocked(0.6037, DistanceMetricConfig("lv_multiword", lv_multiword_separator=" ")),
    "rank_records": rank_records, "rank_trackers": rank_trackers,
    "resolve_simple": resolve_simple, "resolve_best_match": resolve_best_match, "resolve_mutual_best": resolve_mutual_best,
    "new_trackers": new_trackers, "unmatched_trackers": unmatched_trackers, "dead_trackers": dead_trackers,
    "memory_bruteforce": memory_bruteforce, "memory_mostfrequent": _memory("mostfrequent"),
    "memory_ls_bruteforce": _memory("ls-bruteforce"), "memory_ls_mostfrequent": _memory("ls-mostfrequent"),
    "memory_conversations": _memory("mostfrequent", conversation_chains),
    "memory_median": memory_median, "memory_ls_median": _memory("ls-median"), "memory_mw_median": memory_mw_median,
    "memory_mw_mostfrequent": memory_mw_mostfrequent, "running_latest": running_latest,
    "running_mostfrequent": running_mostfrequent, "running_median": running_median, "edit_scripts": edit_scripts, "median_words": median_words,
    "word_clusters": word_clusters,
    "fill_missing_clusters": fill_missing_clusters, "range_fill": range_fill, "streaks": streaks,
    "chain_edges": chain_edges, "chain_positions": chain_positions, "chain_lengths": chain_lengths,
    "chain_stats": chain_stats, "chains_at_least": chains_at_least, "first_chain_at_least": first_chain_at_least,
    "tail_counts": tail_counts, "graph_ratios": graph_ratios, "average_ratios": average_ratios,
    "start_end_frames": start_end_frames, "match_histograms": match_histograms, "divergence_conflict": divergence_conflict,
    "histogram_merge": histogram_merge, "histogram_mean_median": histogram_mean_median, "value_counts": value_counts,
    "chain_consistency": chain_consistency, "chain_consistency_strict": chain_consistency_strict,
    "mean_consistency": mean_consistency, "results_in_box": results_in_box, "group_results": group_results,
    "column_distance_sum": column_distance_sum, "product_distance_sum": product_distance_sum,
    "chain_records": chain_records, "sampled_chains": sampled_chains, "tracking_end_to_end": tracking_end_to_end, "tracking_defaults": tracking_defaults,
    "tracking_distances": tracking_distances, "tracking_memories": tracking_memories, "conflict_ratios": conflict_ratios,
    "tracking_word_pairs": tracking_word_pairs, "tracking_pairs": tracking_pairs, "sweep_chains": sweep_chains,
    "sweep_summaries": sweep_summaries, "tracking_stream": tracking_stream, "stored_graph": stored_graph, "one_chain": one_chain,
    "materialize_memories": materialize_memories, "written_csv": written_csv,
    "tracking_simple": tracking_simple, "tracking_diagnostics": tracking_diagnostics,
    "tracking_histograms": tracking_histograms, "memory_distances": memory_distances,
    "materialize_chain": materialize_chain, "normalize_end_to_end": normalize_end_to_end,
}
