"""SQL (DuckDB) for the registered queries of the tracking engine."""

from __future__ import annotations

from kinthread import oracle_parts as parts
from kinthread.queries import CONVERSATIONS_SQL, EVENTS_SQL, FRAMES_SQL, SUMMED

FRAMES = f"frames AS MATERIALIZED ({FRAMES_SQL})"
EVENTS = f"events_chains AS MATERIALIZED ({EVENTS_SQL})"
TALKS = f"talks AS MATERIALIZED ({CONVERSATIONS_SQL})"
PAIRS = "words AS (SELECT DISTINCT p_name FROM part), pairs AS (SELECT a.p_name AS w1, b.p_name AS w2 FROM words a, words b)"


def _lv(a: str, b: str) -> str:
    """Similarity of two ASCII columns in FLOAT."""
    size = f"CAST(greatest(strlen({a}), strlen({b})) AS FLOAT)"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE CAST(1 AS FLOAT) - CAST(levenshtein({a}, {b}) AS FLOAT) / {size} END)"


_TRIANGLE = parts.TRIANGLE
_SIM = "CAST(1 AS FLOAT) - CAST({} AS FLOAT) / size"


def _score(weights: tuple[float, ...] | None, power: int = 1) -> str:
    sims = [_lv(f"x.{n}", f"y.{n}") for n in ("name", "origin", "code")]
    if weights is None:
        return f"({' + '.join(f'coalesce({s}, 0)' for s in sims)}) / 3.0"
    top = " + ".join(f"coalesce({w} * {' * '.join([f'CAST({s} AS DOUBLE)'] * power)}, 0)" for w, s in zip(weights, sims, strict=True))
    present = " + ".join(f"CASE WHEN {s} IS NULL THEN 0.0 ELSE {w} END" for w, s in zip(weights, sims, strict=True))
    return f"({top}) / greatest({present}, {0.7 * sum(weights)})"


TIE = parts.TIE
SCORES = f"""{FRAMES}, scores AS MATERIALIZED (SELECT x.record_idx AS tracker_id, y.record_idx AS record_idx, round(CAST({_score(None)} AS DOUBLE), 5) AS score
  FROM frames x JOIN frames y ON x.frame_idx = 0 AND y.frame_idx = 1 WHERE {_score(None)} > 0.4137)"""
BEST = f"""WITH RECURSIVE {SCORES},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, {TIE} DESC, tracker_id, record_idx) AS n FROM scores),
g(n, ts, rs, won) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false
  UNION ALL
  SELECT k.n, CASE WHEN ok THEN list_append(ts, k.tracker_id) ELSE ts END, CASE WHEN ok THEN list_append(rs, k.record_idx) ELSE rs END, ok
  FROM (SELECT r.*, g.ts, g.rs, NOT list_contains(g.ts, r.tracker_id) AND NOT list_contains(g.rs, r.record_idx) AS ok FROM g JOIN ranked r ON r.n = g.n + 1) k),
matches AS (SELECT tracker_id, record_idx, score FROM g JOIN ranked USING (n) WHERE won)"""
_MATCHES = BEST + " SELECT tracker_id, record_idx, round(score, 5) AS score FROM matches"


def _scored(weights, power: int = 1) -> str:
    return f"WITH {FRAMES} SELECT x.record_idx AS left_idx, y.record_idx AS right_idx, round(CAST({_score(weights, power)} AS DOUBLE), 4) AS score FROM frames x JOIN frames y ON x.frame_idx = 0 AND y.frame_idx = 1"


_HISTORIES = "WITH {src}, h AS (SELECT *, frame_idx AS place FROM {t} WHERE value IS NOT NULL), ids AS (SELECT DISTINCT tracker_id FROM {t})"
_TEXT = " SELECT tracker_id, coalesce(string_agg(value, ',' ORDER BY place), '') AS memory FROM ids LEFT JOIN {m} USING (tracker_id) GROUP BY tracker_id"
_MODE = "(SELECT tracker_id, value, place FROM (SELECT *, rank() OVER (PARTITION BY tracker_id ORDER BY n DESC) AS k FROM (SELECT tracker_id, value, count(*) AS n, min(frame_idx) AS place FROM {h} GROUP BY tracker_id, value)) WHERE k = 1)"
_EVENT_MEMORY = _HISTORIES.format(src=EVENTS, t="events_chains")


def _ratios() -> str:
    return f"""WITH {EVENTS}, c AS (SELECT tracker_id, frame_idx, lag(frame_idx) OVER w IS NOT NULL AS i, lead(frame_idx) OVER w IS NOT NULL AS o
  FROM events_chains WINDOW w AS (PARTITION BY tracker_id ORDER BY frame_idx)),
nodes AS (SELECT count(DISTINCT tracker_id) AS n FROM events_chains),
p AS (SELECT frame_idx, CAST(CAST(count(*) FILTER (i) AS DOUBLE) / any_value(n) AS FLOAT) AS r,
  CASE WHEN count(*) FILTER (o) = 0 THEN NULL ELSE CAST(CAST(count(*) FILTER (i AND o) AS DOUBLE) / count(*) FILTER (o) AS FLOAT) END AS t FROM c, nodes GROUP BY frame_idx)"""


ORACLES: dict[str, str] = {
    "frames_scan": FRAMES_SQL,
    "frames_schema_prune": f"SELECT frame_idx, record_idx, origin, code FROM ({FRAMES_SQL})",
    "frames_write_back": f"""SELECT frame_idx, record_idx, name, CAST(CASE WHEN record_idx % 3 = 0 THEN 0 ELSE len(members) END AS INTEGER) AS n_members,
  CASE WHEN record_idx % 3 = 0 THEN '' ELSE array_to_string(members, '|') END AS joined FROM ({FRAMES_SQL})""",
    "list_columns": """SELECT p_partkey, CAST(len(items) AS INTEGER) AS n_items, array_to_string(items[1:2], '|') AS first_two, substr(t, 1, 9) AS cut FROM (
  SELECT p_partkey, t, list_filter(string_split(t, '|'), lambda x: x <> '') AS items FROM (SELECT p_partkey, p_brand || '||' || p_type || '|' || p_name AS t FROM part))""",
    "sim_lv": f"WITH {PAIRS} SELECT w1, w2, round(CAST({_lv('w1', 'w2')} AS DOUBLE), 5) AS similarity FROM pairs",
    "sim_lv_sigmoid": f"WITH {PAIRS} SELECT w1, w2, round(1 / (1 + exp(-(8 * CAST({_lv('w1', 'w2')} AS DOUBLE) - 4))), 5) AS similarity FROM pairs",
    "sim_lv_opti": f"WITH RECURSIVE {PAIRS}, {_TRIANGLE} SELECT w1, w2, round(CAST({_SIM.format('e')} AS DOUBLE), 5) AS similarity FROM edits",
    "sim_lv_substring": f"WITH RECURSIVE {PAIRS}, {_TRIANGLE} SELECT w1, w2, round(CAST(1 - greatest(e - 0.6 * longest, 0) / size AS DOUBLE), 5) AS similarity FROM edits",
    "multi_similarity": f"""WITH {FRAMES}, best AS (SELECT x.record_idx AS l, y.record_idx AS r, len(x.members) AS n, len(y.members) AS m,
    list_transform(x.members, lambda a: list_max(list_transform(y.members, lambda b: {_lv('a', 'b')}))) AS v
  FROM frames x JOIN frames y ON x.frame_idx = 0 AND y.frame_idx = 1)
SELECT l AS left_idx, r AS right_idx, round(CAST(list_sum(v) / greatest(n, m) AS DOUBLE), 5) AS similarity FROM best""",
    "score_average": _scored(None),
    "score_weighted": _scored((1.0, 2.0, 3.0)),
    "score_quadratic": _scored((1.0, 2.0, 3.0), 2),
    "interest_filter": f"WITH {SCORES} SELECT tracker_id, record_idx, round(score, 5) AS score FROM scores",
    "rank_records": f"WITH {SCORES} SELECT tracker_id, record_idx, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY tracker_id ORDER BY score DESC, record_idx) AS INTEGER) AS record_rank FROM scores",
    "rank_trackers": f"WITH {SCORES} SELECT tracker_id, record_idx, round(score, 5) AS score, CAST(row_number() OVER (PARTITION BY record_idx ORDER BY score DESC, tracker_id) AS INTEGER) AS tracker_rank FROM scores",
    "resolve_simple": f"WITH {SCORES} SELECT tracker_id, record_idx, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tracker_id ORDER BY score DESC, record_idx) AS k FROM scores) WHERE k = 1",
    "resolve_best_match": _MATCHES,
    "resolve_mutual_best": _MATCHES,
    "new_trackers": BEST + " SELECT record_idx, name, code FROM frames WHERE frame_idx = 1 AND record_idx NOT IN (SELECT record_idx FROM matches)",
    "unmatched_trackers": BEST + " SELECT record_idx AS tracker_id FROM frames WHERE frame_idx = 0 AND record_idx NOT IN (SELECT tracker_id FROM matches)",
    "dead_trackers": f"WITH {EVENTS} SELECT tracker_id, CAST((SELECT max(frame_idx) FROM events_chains) - max(frame_idx) AS INTEGER) AS streak, (SELECT max(frame_idx) FROM events_chains) - max(frame_idx) <= 1 AS alive FROM events_chains GROUP BY tracker_id",
    "memory_bruteforce": _EVENT_MEMORY + _TEXT.format(m="h"),
    "memory_ls_bruteforce": _EVENT_MEMORY + _TEXT.format(m="h"),
    "memory_mostfrequent": _EVENT_MEMORY + ", m AS " + _MODE.format(h="h") + _TEXT.format(m="m"),
    "memory_ls_mostfrequent": _EVENT_MEMORY + """, k AS (SELECT *, row_number() OVER (PARTITION BY tracker_id ORDER BY frame_idx DESC) AS back FROM h),
old AS (SELECT tracker_id, frame_idx, value FROM k WHERE back > 1), m AS (SELECT * FROM """ + _MODE.format(h="old") + " UNION ALL SELECT tracker_id, value, frame_idx FROM k WHERE back = 1)" + _TEXT.format(m="m"),
    "memory_conversations": _HISTORIES.format(src=TALKS, t="talks") + ", m AS " + _MODE.format(h="h") + _TEXT.format(m="m"),
    "running_latest": f"WITH {EVENTS} SELECT tracker_id, frame_idx, last_value(value IGNORE NULLS) OVER (PARTITION BY tracker_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events_chains",
    "fill_missing_clusters": f"""WITH {EVENTS} SELECT tracker_id, frame_idx, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY tracker_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY tracker_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM events_chains""",
    "range_fill": f"""WITH {EVENTS}, s AS (SELECT tracker_id, value, min(frame_idx) AS a, max(frame_idx) AS b FROM events_chains WHERE value IS NOT NULL GROUP BY ALL)
SELECT e.tracker_id, e.frame_idx, s.value FROM events_chains e JOIN s ON s.tracker_id = e.tracker_id AND e.frame_idx BETWEEN s.a AND s.b""",
    "streaks": f"WITH {EVENTS} SELECT tracker_id, frame_idx, CAST(coalesce(frame_idx - lag(frame_idx) OVER (PARTITION BY tracker_id ORDER BY frame_idx) - 1, 0) AS INTEGER) AS missed FROM events_chains",
    "chain_edges": f"""WITH {TALKS}, e AS (SELECT tracker_id, frame_idx AS from_frame, record_idx AS from_record,
  lead(frame_idx) OVER w AS to_frame, lead(record_idx) OVER w AS to_record FROM talks WINDOW w AS (PARTITION BY tracker_id ORDER BY frame_idx))
SELECT * FROM e WHERE to_frame IS NOT NULL""",
    "chain_positions": f"""WITH {EVENTS} SELECT tracker_id, frame_idx, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, lag(frame_idx) OVER w IS NOT NULL AS comes_in,
  lead(frame_idx) OVER w IS NOT NULL AS goes_out FROM events_chains WINDOW w AS (PARTITION BY tracker_id ORDER BY frame_idx)""",
    "chain_lengths": f"WITH {EVENTS} SELECT tracker_id, count(*) AS length, CAST(max(frame_idx) - min(frame_idx) + 1 AS INTEGER) AS lifespan FROM events_chains GROUP BY tracker_id",
    "chain_stats": f"""WITH {TALKS}, l AS (SELECT tracker_id, count(*) AS n FROM talks GROUP BY tracker_id), d AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM l))) AS v)
SELECT round(CAST(CAST(avg(n) AS FLOAT) AS DOUBLE), 4) AS average, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median, max(n) AS max, min(n) AS min,
  (SELECT string_agg(c, ',' ORDER BY v) FROM (SELECT v, CAST((SELECT count(*) FROM l WHERE n = v) AS VARCHAR) AS c FROM d)) AS histogram FROM l""",
    "chains_at_least": f"WITH {TALKS} SELECT tracker_id, count(*) AS length FROM talks GROUP BY tracker_id HAVING count(*) >= 6",
    "first_chain_at_least": f"WITH {TALKS} SELECT tracker_id, count(*) AS length FROM talks WHERE tracker_id >= 10 GROUP BY tracker_id HAVING count(*) >= 6 ORDER BY tracker_id LIMIT 1",
    "tail_counts": f"WITH {EVENTS}, l AS (SELECT count(*) AS n FROM events_chains GROUP BY tracker_id) SELECT "
    + ", ".join(f"count(*) FILTER (n >= {t}) AS at_least_{t}" for t in (2, 5, 10, 25)) + " FROM l",
    "graph_ratios": _ratios() + " SELECT frame_idx, printf('%.4f', CAST(r AS DOUBLE)) AS records_match_ratio, CASE WHEN t IS NULL THEN 'nan' ELSE printf('%.4f', CAST(t AS DOUBLE)) END AS trackers_match_ratio, '0.0000' AS conflict_ratio FROM p",
    "average_ratios": _ratios() + " SELECT round(avg(CAST(r AS DOUBLE)), 4) AS records_match_ratio, round(avg(CASE WHEN frame_idx < (SELECT max(frame_idx) FROM p) THEN CAST(t AS DOUBLE) END), 4) AS trackers_match_ratio FROM p WHERE frame_idx > (SELECT min(frame_idx) FROM p)",
    "start_end_frames": f"""WITH {EVENTS}, e AS (SELECT min(frame_idx) AS s, max(frame_idx) AS x FROM events_chains GROUP BY tracker_id), d AS (SELECT unnest(range(30)) AS f)
SELECT CAST(f AS INTEGER) AS frame_idx, (SELECT count(*) FROM e WHERE s = f) AS starts, (SELECT count(*) FROM e WHERE x = f) AS ends FROM d""",
}
HISTOGRAMS = f"""WITH {SCORES}, h AS (
  SELECT 'record' AS kind, value, count(*) AS n FROM (SELECT f.record_idx, count(s.tracker_id) AS value FROM frames f LEFT JOIN scores s USING (record_idx) WHERE f.frame_idx = 1 GROUP BY f.record_idx) GROUP BY value
  UNION ALL
  SELECT 'tracker', value, count(*) FROM (SELECT f.record_idx, count(s.record_idx) AS value FROM frames f LEFT JOIN scores s ON s.tracker_id = f.record_idx WHERE f.frame_idx = 0 GROUP BY f.record_idx) GROUP BY value)"""


def _share(kind: str) -> str:
    return f"round(CAST(sum(n) FILTER (kind = '{kind}' AND value >= 2) AS DOUBLE) / sum(n) FILTER (kind = '{kind}' AND value >= 1), 4)"


def _consistency(rows: str, like: str) -> str:
    return f"""WITH {EVENTS}, r AS ({rows}), p AS (SELECT tracker_id, v, lag(v) OVER (PARTITION BY tracker_id ORDER BY frame_idx) AS b FROM r),
s AS (SELECT tracker_id, {like} AS s FROM p), c AS (SELECT tracker_id, coalesce(avg(s), 0) AS consistency FROM s GROUP BY tracker_id)"""


_LIKE = "CASE WHEN b IS NULL OR greatest(length(v), length(b)) = 0 THEN NULL ELSE 1 - levenshtein(b, v) / CAST(greatest(length(v), length(b)) AS DOUBLE) END"
_LOOSE = _consistency("SELECT tracker_id, frame_idx, coalesce(value, '') AS v FROM events_chains", _LIKE)
_LENGTHS = f"WITH {TALKS}, l AS (SELECT tracker_id, count(*) AS length, CAST(max(frame_idx) - min(frame_idx) + 1 AS INTEGER) AS lifespan FROM talks GROUP BY tracker_id)"

ORACLES |= {
    "running_mostfrequent": f"""WITH {EVENTS}, c AS (SELECT e.tracker_id, e.frame_idx, h.value, count(*) AS n FROM events_chains e JOIN events_chains h
  ON h.tracker_id = e.tracker_id AND h.frame_idx < e.frame_idx AND h.value IS NOT NULL GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY tracker_id, frame_idx ORDER BY n DESC) AS k FROM c) WHERE k = 1)
SELECT tracker_id, frame_idx, coalesce(string_agg(m.value, ',' ORDER BY m.value), '') AS memory FROM events_chains e LEFT JOIN m USING (tracker_id, frame_idx) GROUP BY ALL""",
    "edit_scripts": f"WITH RECURSIVE {PAIRS}, todo AS (SELECT w1 AS s, w2 AS t FROM pairs), {parts.scripts('p_', 'todo')} SELECT s AS w1, t AS w2, array_to_string(moves, ',') AS script FROM p_script",
    "sim_lv_native": ORACLES["sim_lv"],
    "sim_lv_edit": f"""WITH RECURSIVE {PAIRS}, todo AS (SELECT w1 AS s, w2 AS t FROM pairs), {parts.scripts('p_', 'todo')},
n AS (SELECT s, t, len(list_filter(moves, lambda m: m[1:3] = 'sub')) AS a, len(list_filter(moves, lambda m: m[1:3] = 'del')) AS b, len(list_filter(moves, lambda m: m[1:3] = 'add')) AS c FROM p_script)
SELECT s AS w1, t AS w2, round(CAST(CAST(1 AS FLOAT) - CAST(0.5 * a + 1.0 * b + 1.5 * c AS FLOAT) / CAST(greatest(strlen(s), strlen(t)) AS FLOAT) AS DOUBLE), 5) AS similarity FROM n""",
    "blocked_scores": ORACLES["interest_filter"],
    "blocked_scores_060": ORACLES["interest_filter"].replace("0.4137", "0.6037"),
    "blocked_scores_079": ORACLES["interest_filter"].replace("0.4137", "0.7937"),
    "match_histograms": HISTOGRAMS + " SELECT * FROM h",
    "divergence_conflict": HISTOGRAMS + f" SELECT {_share('tracker')} AS divergence, {_share('record')} AS conflict FROM h",
    "histogram_merge": f"""WITH {EVENTS}, c AS (SELECT value AS t, n, count(*) AS m FROM (SELECT value, tracker_id, count(*) AS n FROM events_chains GROUP BY ALL) GROUP BY ALL),
top AS (SELECT t, max(n) AS x FROM c GROUP BY t), d AS (SELECT t, unnest(range(0, x + 1)) AS v FROM top)
SELECT CAST(v AS INTEGER) AS value, CAST(sum(coalesce(m, 0)) AS BIGINT) AS n FROM d LEFT JOIN c ON d.t IS NOT DISTINCT FROM c.t AND d.v = c.n GROUP BY v""",
    "histogram_mean_median": f"WITH {EVENTS}, l AS (SELECT count(*) AS n FROM events_chains GROUP BY tracker_id) SELECT round(avg(n), 4) AS mean, CAST(quantile_disc(n, 0.5) AS BIGINT) AS median FROM l",
    "value_counts": f"WITH {FRAMES} SELECT feature, value, count(*) AS n FROM (SELECT 'name' AS feature, name AS value FROM frames UNION ALL SELECT 'origin', origin FROM frames UNION ALL SELECT 'code', code FROM frames) WHERE value IS NOT NULL GROUP BY ALL",
    "chain_consistency": _LOOSE + " SELECT tracker_id, round(consistency, 4) AS consistency FROM c",
    "chain_consistency_strict": _consistency("SELECT tracker_id, frame_idx, value AS v FROM events_chains WHERE value IS NOT NULL", _LIKE) + " SELECT tracker_id, round(consistency, 4) AS consistency FROM c",
    "mean_consistency": _LOOSE + " SELECT round(avg(consistency), 4) AS consistency FROM c",
    "results_in_box": _LENGTHS + " SELECT * FROM l WHERE length BETWEEN 3 AND 6 AND lifespan BETWEEN 3 AND 5",
    "group_results": _LENGTHS + " SELECT tracker_id % 4 AS key, CAST(count(*) AS INTEGER) AS n, max(length) AS longest FROM l WHERE length <= 5 GROUP BY 1",
    "column_distance_sum": f"WITH {FRAMES} SELECT frame_idx, round(sum(CAST({_lv('name', chr(39) + 'almond' + chr(39))} AS DOUBLE)), 3) AS total FROM frames GROUP BY frame_idx",
    "product_distance_sum": f"""WITH {FRAMES}, p AS (SELECT x.frame_idx, x.name AS a, y.name AS b FROM frames x JOIN frames y ON y.frame_idx = x.frame_idx + 1),
f AS (SELECT a, b, min(frame_idx) AS first FROM p GROUP BY a, b), c AS (SELECT first AS frame_idx, count(*) AS computations FROM f GROUP BY first)
SELECT frame_idx, total, pairs, coalesce(computations, 0) AS computations FROM (
  SELECT frame_idx, round(sum(CAST({_lv('a', 'b')} AS DOUBLE)), 2) AS total, count(*) AS pairs FROM p GROUP BY frame_idx) LEFT JOIN c USING (frame_idx)""",
    "chain_records": f"WITH {FRAMES} SELECT CAST(substr(code, 2) AS BIGINT) AS tracker_id, frame_idx, record_idx, name, origin FROM frames",
    "sampled_chains": f"WITH {EVENTS} SELECT tracker_id FROM (SELECT DISTINCT tracker_id FROM events_chains) ORDER BY md5('3:' || tracker_id), tracker_id LIMIT 50",
}

# ------------------------------------------------------------------ medians, clusters, whole runs

_BY_CODE = "named AS MATERIALIZED (SELECT code AS g, frame_idx * CAST(1000000000 AS BIGINT) + record_idx AS ord, name AS word, members FROM frames)"
_IN_ORDER = "in_order AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY ord, i) AS ord, word FROM (SELECT g, ord, unnest(range(len(members))) AS i, unnest(members) AS word FROM named))"
_MEDIANS = f"WITH RECURSIVE {FRAMES}, {_BY_CODE}, {parts.medians('m_', 'named')}"
_RUN = f"WITH RECURSIVE {FRAMES}, {parts.tracking(5, 0.6137, 2)}"


def _multi_word(strategy: str) -> str:
    return f"WITH RECURSIVE {FRAMES}, {_BY_CODE}, {_IN_ORDER}, {parts.multi_word_memory('in_order', strategy)} SELECT g AS code, memory FROM memory"


def _dense(kind: str, over: str, other: str) -> str:
    """Text of a histogram of how many ``other`` each of ``over`` has, by frame, from 0 up."""
    return f"""{kind}_n AS (SELECT o.frame_idx, count(s.{other}) AS v FROM ({over}) o LEFT JOIN scores s ON s.frame_idx = o.frame_idx AND s.{kind} = o.id GROUP BY o.frame_idx, o.id),
{kind}_h AS (SELECT frame_idx, string_agg(CAST(n AS VARCHAR), ',' ORDER BY v) AS h FROM (
  SELECT d.frame_idx, d.v, count(x.v) AS n FROM (SELECT frame_idx, unnest(range(max(v) + 1)) AS v FROM {kind}_n GROUP BY frame_idx) d LEFT JOIN {kind}_n x ON x.frame_idx = d.frame_idx AND x.v = d.v GROUP BY ALL) GROUP BY frame_idx)"""


def _blocked(ctes: str, edits: str, threshold: float = 0.6037) -> str:
    """Scores of all pairs of the first two frames by a similarity of ``edits``, from ``pairs`` (w1, w2) of their words."""
    words = " UNION ".join(f"SELECT x.{n} AS w1, y.{n} AS w2 FROM x, y WHERE x.{n} IS NOT NULL AND y.{n} IS NOT NULL" for n in ("name", "origin", "code"))
    joins = " ".join(f"LEFT JOIN sims {n}_sim ON {n}_sim.w1 = x.{n} AND {n}_sim.w2 = y.{n}" for n in ("name", "origin", "code"))
    total = " + ".join(f"coalesce({n}_sim.sim, 0)" for n in ("name", "origin", "code"))
    return f"""WITH RECURSIVE {FRAMES}, x AS (SELECT * FROM frames WHERE frame_idx = 0), y AS (SELECT * FROM frames WHERE frame_idx = 1),
whole AS MATERIALIZED ({words}), {ctes}, sims AS MATERIALIZED (SELECT w1, w2, CAST(CAST(1 AS FLOAT) - CAST({edits} AS FLOAT) / size AS FLOAT) AS sim FROM done),
s AS (SELECT x.record_idx AS tracker_id, y.record_idx AS record_idx, CAST(({total}) / 3.0 AS DOUBLE) AS score FROM x CROSS JOIN y {joins})
SELECT tracker_id, record_idx, round(score, 5) AS score FROM s WHERE score > {threshold}"""


_BY_PARTS = f"""cut AS (SELECT w1, w2, list_filter(string_split(w1, ' '), lambda x: x <> '') AS a, list_filter(string_split(w2, ' '), lambda x: x <> '') AS b FROM whole),
part_pairs AS (SELECT w1 AS p1, w2 AS p2, unnest(a) AS w1, unnest(b) AS w2 FROM cut WHERE len(a) = len(b) AND len(a) > 1),
pairs AS (SELECT w1, w2 FROM whole UNION SELECT w1, w2 FROM part_pairs), {_TRIANGLE},
each AS (SELECT p1, p2, CAST(sum(e) AS FLOAT) AS total, CAST(1 AS FLOAT) - CAST(count(*) FILTER (e = 0) AS FLOAT) / CAST(count(*) AS FLOAT) AS share FROM part_pairs p JOIN edits USING (w1, w2) GROUP BY p1, p2),
done AS (SELECT w.w1, w.w2, CASE WHEN p1 IS NULL THEN CAST(e AS FLOAT) ELSE CAST(trunc(total * share) AS FLOAT) END AS e, size FROM whole w JOIN edits USING (w1, w2) LEFT JOIN each ON p1 = w.w1 AND p2 = w.w2)"""


def _summary(threshold: float, limit: int, strategy: str) -> str:
    """The summary of a run of five frames, chains of two nodes or more for the consistency of names."""
    records = "SELECT frame_idx, record_idx AS id FROM frames WHERE frame_idx > 0"
    merged = "(SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY v) FROM (SELECT d.v, count(x.v) AS n FROM (SELECT unnest(range(max(v) + 1)) AS v FROM {0}_n) d LEFT JOIN {0}_n x ON x.v = d.v GROUP BY d.v)) AS {1}"
    return f"""WITH RECURSIVE {FRAMES}, {parts.tracking(5, threshold, limit, strategy)},
l AS MATERIALIZED (SELECT tracker_id, count(*) AS n, min(frame_idx) AS s, max(frame_idx) AS e FROM chain GROUP BY tracker_id),
node AS MATERIALIZED (SELECT *, lag(frame_idx) OVER w AS before, lead(frame_idx) OVER w AS after FROM chain WINDOW w AS (PARTITION BY tracker_id ORDER BY frame_idx)),
matched AS (SELECT f.frame_idx, CAST(CAST(count(*) FILTER (n >= 1) AS DOUBLE) / count(*) AS FLOAT) AS r
  FROM frames f LEFT JOIN (SELECT frame_idx, record_idx, count(before) AS n FROM node GROUP BY ALL) USING (frame_idx, record_idx) GROUP BY f.frame_idx),
passed AS (SELECT frame_idx, CAST(CAST(count(before) FILTER (after IS NOT NULL) AS DOUBLE) / count(after) AS FLOAT) AS t FROM node GROUP BY frame_idx),
{_dense("record_idx", records, "tracker_id")}, {_dense("tracker_id", "SELECT frame_idx, tracker_id AS id FROM live", "record_idx")},
d AS (SELECT feature, avg(distance) AS distance FROM (SELECT tracker_id, feature, coalesce(avg(CAST(distance AS DOUBLE)), 0) AS distance FROM (
  SELECT tracker_id, unnest(range(4)) AS feature, unnest(distances) AS distance FROM scores JOIN node USING (tracker_id, frame_idx, record_idx) WHERE before IS NOT NULL) GROUP BY ALL) GROUP BY feature),
chosen AS (SELECT tracker_id FROM l WHERE n >= 2 ORDER BY md5('0:' || tracker_id), tracker_id LIMIT 100),
v AS (SELECT tracker_id, name AS v, lag(name) OVER (PARTITION BY tracker_id ORDER BY frame_idx) AS b FROM chain JOIN chosen USING (tracker_id) JOIN frames USING (frame_idx, record_idx)),
same AS (SELECT avg(s) AS consistency FROM (SELECT coalesce(avg({_LIKE}), 0) AS s FROM v GROUP BY tracker_id))
SELECT CAST({threshold} AS DOUBLE) AS threshold, '{strategy}' AS strategy, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median, max(n) AS max, min(n) AS min,
  round(CAST(CAST(avg(n) AS FLOAT) AS DOUBLE), 4) AS average, (SELECT round(avg(CAST(r AS DOUBLE)), 4) FROM matched WHERE frame_idx > 0) AS avg_records_match_ratio,
  (SELECT round(avg(CAST(t AS DOUBLE)), 4) FROM passed WHERE frame_idx BETWEEN 1 AND 3) AS avg_trackers_match_ratio, (SELECT round(consistency, 4) FROM same) AS consistency,
  (SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY x) FROM (SELECT x, count(n) AS c FROM (SELECT unnest(range(max(n) + 1)) AS x FROM l) LEFT JOIN l ON n = x GROUP BY x)) AS histogram,
  {merged.format("record_idx", "histogram_record_matchs")}, {merged.format("tracker_id", "histogram_tracker_matchs")},
  (SELECT string_agg(k || ':' || a || ':' || b, ',' ORDER BY k) FROM (SELECT k, (SELECT count(*) FROM l WHERE s = k) AS a, (SELECT count(*) FROM l WHERE e = k) AS b FROM (SELECT unnest(range(5)) AS k))) AS start_end,
  {", ".join(f"(SELECT round(distance, 4) FROM d WHERE feature = {i}) AS d{i}" for i in range(4))} FROM l"""


_REMEMBERED = " UNION ALL ".join(
    f"SELECT a.tracker_id, CAST({k} AS INTEGER) AS frame_idx, " + ", ".join(f"coalesce(m{i}.median, '') AS {n}" for i, n in enumerate(parts.STRINGS)) + f" FROM alive{k - 1} a "
    + " ".join(f"LEFT JOIN t{k}_median m{i} ON m{i}.g = a.tracker_id * 3 + {i}" for i in range(3)) for k in range(1, 5)
)
ORACLES |= {
    "sim_graphemes": f"WITH RECURSIVE words AS (SELECT DISTINCT replace(replace(p_name, 'e', 'e\u0301'), 'o', '\U0001f469\u200d\U0001f467') AS w FROM part), "
    f"pairs AS (SELECT a.w AS w1, b.w AS w2 FROM words a, words b), {_TRIANGLE.replace('substr(', 'substring_grapheme(').replace(' length(', ' length_grapheme(').replace('(length(', '(length_grapheme(').replace('[length(', '[length_grapheme(')} "
    "SELECT w1, w2, round(CAST(CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size AS DOUBLE), 5) AS similarity FROM edits",
    "yearly_csv": f"WITH {FRAMES} SELECT frame_idx, record_idx AS line, name, CASE WHEN frame_idx <> 2 THEN origin END AS origin, code FROM frames",
    "blocked_substring": _blocked(f"pairs AS (SELECT * FROM whole), {_TRIANGLE}, done AS (SELECT * FROM edits)", "greatest(e - 0.6 * longest, 0)"),
    "blocked_multiword": _blocked(_BY_PARTS, "e"),
    "sim_lv_multiword": f"""WITH RECURSIVE words AS (SELECT DISTINCT p_name FROM part), whole AS (SELECT a.p_name AS w1, b.p_name AS w2 FROM words a, words b), {_BY_PARTS}
SELECT w1, w2, round(CAST(CAST(1 AS FLOAT) - e / size AS DOUBLE), 5) AS similarity FROM done""",
    "memory_median": _MEDIANS + " SELECT g AS code, median AS memory FROM m_median",
    "median_words": _MEDIANS + " SELECT g AS code, median FROM m_median",
    "memory_mw_median": _multi_word("mw-median"),
    "memory_mw_mostfrequent": _multi_word("mw-mostfrequent"),
    "memory_ls_median": f"""WITH RECURSIVE {EVENTS}, k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tracker_id ORDER BY frame_idx DESC) AS back FROM events_chains WHERE value IS NOT NULL),
old AS (SELECT tracker_id AS g, frame_idx AS ord, value AS word FROM k WHERE back > 1), {parts.medians('m_', 'old')}
SELECT tracker_id, concat_ws(',', m_median.median, k.value) AS memory FROM (SELECT DISTINCT tracker_id FROM events_chains) e LEFT JOIN m_median ON g = e.tracker_id LEFT JOIN (SELECT * FROM k WHERE back = 1) k USING (tracker_id)""",
    "running_median": f"""WITH RECURSIVE {EVENTS}, old AS (SELECT e.tracker_id * 1000 + e.frame_idx AS g, h.frame_idx AS ord, h.value AS word FROM events_chains e JOIN events_chains h
  ON h.tracker_id = e.tracker_id AND h.frame_idx < e.frame_idx AND h.value IS NOT NULL), {parts.medians('m_', 'old')}
SELECT tracker_id, frame_idx, coalesce(median, '') AS memory FROM events_chains LEFT JOIN m_median ON g = tracker_id * 1000 + frame_idx""",
    "word_clusters": f"""WITH RECURSIVE {FRAMES}, listed AS MATERIALIZED (SELECT code AS g, row_number() OVER (PARTITION BY code ORDER BY name) AS ord, name AS word FROM frames),
pairs AS (SELECT DISTINCT x.word AS w1, y.word AS w2 FROM listed x JOIN listed y USING (g)), {_TRIANGLE}, {parts.linkage('n_', 'listed', 'edits')}
SELECT g AS code, CAST(cluster AS INTEGER) AS cluster, string_agg(word, ',' ORDER BY spot) AS members FROM n_cluster JOIN n_placed USING (g, spot) GROUP BY g, cluster""",
    "tracking_end_to_end": _RUN + " SELECT * FROM chain",
    "tracking_defaults": f"WITH RECURSIVE {FRAMES}, {parts.tracking(5, 0.6, 2, defaults=True)} SELECT * FROM chain",
    "tracking_simple": f"WITH RECURSIVE {FRAMES}, {parts.tracking(5, 0.6137, 2, 'simple')} SELECT * FROM chain",
    "tracking_distances": _RUN + " SELECT tracker_id, frame_idx, record_idx, " + ", ".join(f"round(CAST(distances[{i + 1}] AS DOUBLE), 4) AS d{i}" for i in range(4)) + " FROM scores",
    "tracking_word_pairs": _RUN + " SELECT tracker_id, frame_idx, record_idx, round(CAST(score AS DOUBLE), 5) AS score, " + ", ".join(f"round(CAST(distances[{i + 1}] AS DOUBLE), 4) AS d{i}" for i in range(4)) + " FROM scores",
    "tracking_pairs": _RUN + """ SELECT l.frame_idx, t * r AS possible, coalesce(kept, 0) AS kept FROM (SELECT frame_idx, count(*) AS t FROM live GROUP BY frame_idx) l
JOIN (SELECT frame_idx, count(*) AS r FROM frames GROUP BY frame_idx) f USING (frame_idx) LEFT JOIN (SELECT frame_idx, count(*) AS kept FROM scores GROUP BY frame_idx) s USING (frame_idx)""",
    "sweep_chains": " UNION ALL ".join(
        f"SELECT CAST({n} AS INTEGER) AS config, * FROM (WITH RECURSIVE {FRAMES}, {parts.tracking(5, threshold, limit, strategy)} SELECT * FROM chain)"
        for n, (threshold, limit, strategy) in enumerate(((0.6137, 2, "best-match"), (0.6137, 2, "simple"), (0.4137, 1, "simple"), (0.7137, 1, "best-match")))
    ),
    "tracking_memories": _RUN + " " + _REMEMBERED,
    "materialize_memories": _RUN + f", remembered AS ({_REMEMBERED}) SELECT tracker_id, frame_idx, record_idx, name, origin, code FROM chain FULL JOIN remembered USING (tracker_id, frame_idx)",
    "sweep_summaries": " UNION ALL ".join(f"SELECT * FROM ({_summary(*one)})" for one in SUMMED),
    "tracking_stream": _RUN + """ SELECT 'chain' AS kind, tracker_id, frame_idx, record_idx FROM chain
UNION ALL SELECT 'late', NULL, CAST(0 AS INTEGER), record_idx FROM frames WHERE frame_idx = 0 AND record_idx % 10 = 0""",
    "stored_graph": _RUN + " SELECT c.*, round(CAST(s.score AS DOUBLE), 5) AS score FROM chain c LEFT JOIN scores s USING (tracker_id, frame_idx, record_idx)",
    "one_chain": _RUN + """ SELECT tracker_id, frame_idx, record_idx, name, origin, code, array_to_string(members, '|') AS members,
  CAST(count(*) OVER () AS INTEGER) AS length, CAST(max(frame_idx) OVER () - min(frame_idx) OVER () + 1 AS INTEGER) AS lifespan
FROM chain JOIN frames USING (frame_idx, record_idx) WHERE tracker_id = (SELECT min(tracker_id) FROM chain)""",
    "written_csv": f"WITH {FRAMES} SELECT frame_idx, record_idx, name, origin, code, array_to_string(members, '|') AS members FROM frames",
    "conflict_ratios": f"""WITH RECURSIVE {FRAMES}, {parts.tracking(5, 0.3137, 2, 'simple')},
e AS (SELECT frame_idx, record_idx, lag(frame_idx) OVER (PARTITION BY tracker_id ORDER BY frame_idx) AS before FROM chain),
i AS (SELECT frame_idx, record_idx, count(before) AS n FROM e GROUP BY ALL)
SELECT f.frame_idx, round(CAST(CAST(CAST(count(*) FILTER (n >= 1) AS DOUBLE) / count(*) AS FLOAT) AS DOUBLE), 4) AS records_match_ratio,
  round(CAST(CAST(CAST(count(*) FILTER (n >= 2) AS DOUBLE) / count(*) AS FLOAT) AS DOUBLE), 4) AS conflict_ratio
FROM frames f LEFT JOIN i USING (frame_idx, record_idx) GROUP BY f.frame_idx""",
    "tracking_diagnostics": _RUN + " SELECT tracker_id, frame_idx, record_idx, round(CAST(score AS DOUBLE), 5) AS score, CAST(4 AS INTEGER) AS n_features FROM scores",
    "tracking_histograms": _RUN + ", " + _dense("record_idx", "SELECT frame_idx, record_idx AS id FROM frames WHERE frame_idx > 0", "tracker_id")
    + ", " + _dense("tracker_id", "SELECT frame_idx, tracker_id AS id FROM live", "record_idx")
    + " SELECT frame_idx, r.h AS histogram_record_matchs, t.h AS histogram_tracker_matchs FROM record_idx_h r JOIN tracker_id_h t USING (frame_idx)",
    "memory_distances": _RUN + """, born AS (SELECT tracker_id, min(frame_idx) AS frame_idx FROM chain GROUP BY tracker_id),
m AS (SELECT s.tracker_id, unnest(range(4)) AS feature, unnest(distances) AS distance FROM scores s JOIN chain USING (tracker_id, frame_idx, record_idx) WHERE (tracker_id, frame_idx) NOT IN (SELECT tracker_id, frame_idx FROM born))
SELECT CAST(feature AS INTEGER) AS feature, round(avg(distance), 4) AS distance FROM (SELECT tracker_id, feature, coalesce(avg(CAST(distance AS DOUBLE)), 0) AS distance FROM m GROUP BY tracker_id, feature) GROUP BY feature""",
    "materialize_chain": _RUN + """ SELECT l.tracker_id, l.frame_idx, c.record_idx, f.name, f.code, CASE WHEN v.tracker_id IS NULL THEN NULL ELSE CAST(4 AS INTEGER) END AS n_memories
FROM (SELECT tracker_id, frame_idx FROM chain UNION SELECT tracker_id, frame_idx FROM live) l LEFT JOIN chain c USING (tracker_id, frame_idx)
LEFT JOIN frames f ON f.frame_idx = l.frame_idx AND f.record_idx = c.record_idx LEFT JOIN live v ON v.tracker_id = l.tracker_id AND v.frame_idx = l.frame_idx""",
    "normalize_end_to_end": _RUN + f", {parts.normalized()} SELECT * FROM done",
}
