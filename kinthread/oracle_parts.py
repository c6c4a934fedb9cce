"""Building blocks (DuckDB SQL) of the oracles: edit programmes, medians, clusters, memories, tracking."""

from __future__ import annotations

import re

#: What orders pairs of equal scores, largest first.
TIE = "substr(md5(tracker_id || ':' || record_idx), 1, 12)"
#: Edits of the lower triangle for every pair of ``pairs`` (w1, w2): ``edits`` (w1, w2, e, longest, size).
TRIANGLE = """
sized AS (SELECT w1, w2, CASE WHEN length(w1) < length(w2) THEN w2 ELSE w1 END AS a, CASE WHEN length(w1) < length(w2) THEN w1 ELSE w2 END AS b FROM pairs),
dp(w1, w2, a, b, i, r, run, longest) AS (
  SELECT w1, w2, a, b, 0, list_prepend(0, list_transform(range(length(b)), lambda j: 9999)), list_transform(range(length(b) + 1), lambda j: 0), 0 FROM sized
  UNION ALL
  SELECT w1, w2, a, b, i + 1,
    list_reduce(list_prepend([i + 1], list_transform(range(1, length(b) + 1), lambda j: [CAST(j AS INTEGER)])), lambda acc, x: list_append(acc,
      CASE WHEN x[1] > i + 1 THEN 9999 WHEN substr(a, i + 1, 1) = substr(b, x[1], 1) THEN r[x[1]]
           ELSE 1 + least(r[x[1]], r[x[1] + 1], acc[x[1]]) END)),
    list_prepend(0, list_transform(range(1, length(b) + 1), lambda j: CASE WHEN j <= i + 1 AND substr(a, i + 1, 1) = substr(b, CAST(j AS INTEGER), 1) THEN run[j] + 1 ELSE 0 END)),
    greatest(longest, list_max(list_transform(range(1, length(b) + 1), lambda j: CASE WHEN j <= i + 1 AND substr(a, i + 1, 1) = substr(b, CAST(j AS INTEGER), 1) THEN run[j] + 1 ELSE 0 END)))
  FROM dp WHERE i < length(a)),
edits AS (SELECT w1, w2, r[length(b) + 1] AS e, longest, CAST(greatest(strlen(w1), strlen(w2)) AS FLOAT) AS size FROM dp WHERE i = length(a))
"""


def triangle(name: str, pairs: str) -> str:
    """``TRIANGLE`` under another name: CTE ``name`` from the CTE ``pairs``."""
    text = TRIANGLE.replace("FROM pairs)", f"FROM {pairs})")
    for part in ("sized", "dp", "edits"):
        text = re.sub(rf"\b{part}\b", f"{name}_{part}", text)
    return text + f", {name} AS (SELECT * FROM {name}_edits)"


def scripts(p: str, todo: str) -> str:
    """CTE ``{p}script`` (s, t, aligned, moves) of the CTE ``todo`` (s, t): the word s stretched or cut to t, and its edits.

    Costs are those of edit distance; the way back takes a substitution only
    where strictly cheapest, a deletion only where cheaper than an addition.
    """
    return f"""{p}dp(s, t, i, r, tab) AS (
  SELECT s, t, CAST(0 AS BIGINT), range(length(t) + 1), [range(length(t) + 1)] FROM {todo}
  UNION ALL
  SELECT s, t, i + 1, row, list_append(tab, row) FROM (SELECT *, list_reduce(
      list_prepend([i + 1], list_transform(range(1, length(t) + 1), lambda j: [j])), lambda acc, x: list_append(acc,
        CASE WHEN substr(s, i + 1, 1) = substr(t, x[1], 1) THEN r[x[1]] ELSE 1 + least(r[x[1]], r[x[1] + 1], acc[x[1]]) END)) AS row
    FROM {p}dp WHERE i < length(s))),
{p}back(s, t, i, j, tab, aligned, moves) AS (
  SELECT s, t, CAST(length(s) AS BIGINT), CAST(length(t) AS BIGINT), tab, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM {p}dp WHERE i = length(s)
  UNION ALL
  SELECT s, t, CASE WHEN move = 'add' THEN i ELSE i - 1 END, CASE WHEN move = 'del' THEN j ELSE j - 1 END, tab,
    CASE move WHEN 'del' THEN aligned WHEN 'add' THEN list_prepend(NULL, aligned) ELSE list_prepend(substr(s, i, 1), aligned) END,
    CASE move WHEN 'same' THEN moves WHEN 'del' THEN list_prepend('del' || CAST(i - 1 AS VARCHAR), moves) ELSE list_prepend(move || CAST(j - 1 AS VARCHAR), moves) END
  FROM (SELECT *, CASE
      WHEN i > 0 AND j > 0 AND substr(s, i, 1) = substr(t, j, 1) THEN 'same'
      WHEN i > 0 AND j > 0 AND tab[i][j] < tab[i][j + 1] AND tab[i][j] < tab[i + 1][j] THEN 'sub'
      WHEN i > 0 AND (j = 0 OR tab[i][j + 1] < tab[i + 1][j]) THEN 'del' ELSE 'add' END AS move
    FROM {p}back WHERE i > 0 OR j > 0)),
{p}script AS (SELECT s, t, aligned, moves FROM {p}back WHERE i = 0 AND j = 0)"""


def medians(p: str, words: str) -> str:
    """CTE ``{p}median`` (g, median) of the CTE ``words`` (g, ord, word): the median word of every group."""
    return f"""{p}sized AS MATERIALIZED (SELECT g, ord, word, length(word) AS n, row_number() OVER (PARTITION BY g, length(word) ORDER BY ord) AS k FROM {words}),
{p}mode AS (SELECT g, n AS most FROM (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY k DESC, ord) AS place FROM {p}sized) WHERE place = 1),
{p}target AS MATERIALIZED (SELECT g, most, min_by(word, ord) AS t FROM {p}sized JOIN {p}mode USING (g) WHERE n = most GROUP BY g, most),
{p}todo AS (SELECT DISTINCT word AS s, t FROM {p}sized JOIN {p}target USING (g) WHERE n <> most),
{scripts(p, p + "todo")},
{p}rows AS (SELECT g, 0 AS late, ord, string_split(word, '') AS cs FROM {p}sized JOIN {p}target USING (g) WHERE n = most
  UNION ALL SELECT g, 1, ord, aligned FROM {p}sized JOIN {p}target USING (g) JOIN {p}script ON {p}script.s = word AND {p}script.t = {p}target.t WHERE n <> most),
{p}cells AS (SELECT *, row_number() OVER (PARTITION BY g, pos, c ORDER BY late, ord) AS k FROM (
  SELECT g, late, ord, unnest(range(1, len(cs) + 1)) AS pos, unnest(cs) AS c FROM {p}rows) WHERE c IS NOT NULL),
{p}best AS (SELECT g, pos, c, row_number() OVER (PARTITION BY g, pos ORDER BY k DESC, late, ord) AS place FROM {p}cells),
{p}median AS MATERIALIZED (SELECT g, coalesce(string_agg(c, '' ORDER BY pos), '') AS median FROM {p}target LEFT JOIN (SELECT * FROM {p}best WHERE place = 1) USING (g) GROUP BY g)"""


def linkage(p: str, words: str, edits: str, threshold: float = 0.6) -> str:
    """CTE ``{p}cluster`` (g, cluster, spot) of the CTE ``words`` (g, ord, word), both numbers from 0.

    Average linkage over the similarities of the CTE ``edits``: the first most
    similar pair over the threshold is merged, the last takes the place of the
    one merged away.
    """
    size, other = "len(parts[i])", "len(parts[j])"
    mean = f"CAST(({{}} * CAST({size} AS FLOAT) + {{}} * CAST({other} AS FLOAT)) / (CAST({size} AS FLOAT) + CAST({other} AS FLOAT)) AS FLOAT)"
    kept = "list_transform(range(1, n), lambda x: CASE WHEN x = j THEN n ELSE x END)"
    return f"""{p}placed AS MATERIALIZED (SELECT g, word, row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS spot FROM {words}),
{p}like AS (SELECT x.g, x.spot AS i, y.spot AS j, CASE WHEN x.spot = y.spot THEN CAST(0 AS FLOAT) ELSE CAST(CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size AS FLOAT) END AS v
  FROM {p}placed x JOIN {p}placed y ON x.g = y.g JOIN {edits} d ON d.w1 = x.word AND d.w2 = y.word),
{p}merge(g, m, parts) AS (
  SELECT g, list(r ORDER BY i), list([i] ORDER BY i) FROM (SELECT g, i, list(v ORDER BY j) AS r FROM {p}like GROUP BY g, i) GROUP BY g
  UNION ALL
  SELECT g, list_transform({kept}, lambda r: list_transform({kept}, lambda c: CASE WHEN r = c THEN CAST(0 AS FLOAT) ELSE whole[r][c] END)),
    list_transform({kept}, lambda r: CASE WHEN r = i THEN list_sort(list_concat(parts[i], parts[j])) ELSE parts[r] END)
  FROM (SELECT *, list_transform(range(1, n + 1), lambda r: list_transform(range(1, n + 1), lambda c: CASE
      WHEN r = i THEN {mean.format("m[i][c]", "m[j][c]")} WHEN c = i THEN {mean.format("m[r][i]", "m[r][j]")} ELSE m[r][c] END)) AS whole
    FROM (SELECT g, m, parts, n, least(first // n, first % n) + 1 AS i, greatest(first // n, first % n) + 1 AS j
      FROM (SELECT *, len(m) AS n, list_position(flatten(m), list_max(flatten(m))) - 1 AS first FROM {p}merge
        WHERE len(m) > 1 AND list_max(flatten(m)) > CAST({threshold} AS FLOAT))))),
{p}cluster AS MATERIALIZED (SELECT g, cluster, unnest(part) AS spot FROM (SELECT g, unnest(range(len(parts))) AS cluster, unnest(parts) AS part FROM {p}merge
  WHERE NOT (len(m) > 1 AND list_max(flatten(m)) > CAST({threshold} AS FLOAT))))"""


def _no_words(like: str) -> str:
    """CTEs ``s0`` and ``stand0``: sub-memories without a word, of groups typed as in the CTE ``like`` (g)."""
    return f"""s0 AS (SELECT g, CAST(0 AS BIGINT) AS ord, CAST('' AS VARCHAR) AS word, CAST(0 AS BIGINT) AS sub FROM {like} WHERE false),
stand0 AS (SELECT g, sub, word FROM s0)"""


def sub_memory_step(k: int, words: str, strategy: str, threshold: float) -> list[str]:
    """CTEs ``s{k}`` (g, ord, word, sub) and ``stand{k}`` (g, sub, word) after the k-th word (g, word) of the query ``words``: at most one a group.

    The word goes to the most similar sub-memory of its group, or begins one.
    """
    parts = [
        f"in{k} AS MATERIALIZED ({words})",
        f"pairs{k} AS (SELECT DISTINCT i.word AS w1, t.word AS w2 FROM in{k} i JOIN stand{k - 1} t USING (g))",
        triangle(f"near{k}", f"pairs{k}"),
        f"""best{k} AS (SELECT g, sub, v FROM (SELECT i.g, t.sub, CAST(CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size AS FLOAT) AS v,
  row_number() OVER (PARTITION BY i.g ORDER BY CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size DESC, t.sub) AS place
  FROM in{k} i JOIN stand{k - 1} t USING (g) JOIN near{k} d ON d.w1 = i.word AND d.w2 = t.word) WHERE place = 1)""",
        f"""s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT i.g, CAST({k} AS BIGINT), i.word,
  CASE WHEN v >= CAST({threshold} AS FLOAT) THEN b.sub ELSE coalesce(c.n, 0) END
  FROM in{k} i LEFT JOIN best{k} b USING (g) LEFT JOIN (SELECT g, count(DISTINCT sub) AS n FROM s{k - 1} GROUP BY g) c USING (g))""",
    ]
    if strategy == "mw-median":
        return parts + [
            f"all{k} AS (SELECT {{'g': g, 'sub': sub}} AS g, ord, word FROM s{k})", medians(f"m{k}_", f"all{k}"),
            f"stand{k} AS MATERIALIZED (SELECT g.g AS g, g.sub AS sub, median AS word FROM m{k}_median)",
        ]
    return parts + [f"""stand{k} AS MATERIALIZED (SELECT g, sub, word FROM (SELECT g, sub, word, row_number() OVER (PARTITION BY g, sub ORDER BY n DESC, first) AS place
  FROM (SELECT g, sub, word, count(*) AS n, min(ord) AS first FROM s{k} GROUP BY g, sub, word)) WHERE place = 1)"""]


def multi_word_memory(words: str, strategy: str, threshold: float = 0.6) -> str:
    """CTE ``memory`` (g, memory) of the CTE ``words`` (g, ord from 1, word): sub-memories' words joined by commas.

    Word after word goes to the most similar sub-memory, or begins one, as in
    ``sub_memory_step``; a round of the recursion takes one more of every group
    that has one, so there may be any number. ``walk`` holds all words taken.
    """

    def stands(p: str, taken: str) -> str:
        """CTE ``{p}stand`` (g, sub, word) of the CTE ``taken`` (g, ord, word, sub)."""
        if strategy == "mw-median":
            return f"""{p}all AS (SELECT {{'g': g, 'sub': sub}} AS g, ord, word FROM {taken}), {medians(p, p + "all")},
{p}stand AS (SELECT g.g AS g, g.sub AS sub, median AS word FROM {p}median)"""
        return f"""{p}stand AS (SELECT g, sub, word FROM (SELECT g, sub, word, row_number() OVER (PARTITION BY g, sub ORDER BY n DESC, first) AS place
  FROM (SELECT g, sub, word, count(*) AS n, min(ord) AS first FROM {taken} GROUP BY g, sub, word)) WHERE place = 1)"""

    return f"""walk(k, g, ord, word, sub) AS (
  SELECT CAST(1 AS BIGINT), g, CAST(1 AS BIGINT), word, CAST(0 AS BIGINT) FROM {words} WHERE ord = 1
  UNION ALL
  (WITH RECURSIVE next AS (SELECT DISTINCT i.g, i.ord, i.word FROM {words} i JOIN walk w ON w.g = i.g AND i.ord = w.k + 1),
  before AS (SELECT w.g, w.ord, w.word, w.sub FROM walk w JOIN next USING (g)),
  {stands("v_", "before")},
  pairs AS (SELECT DISTINCT i.word AS w1, t.word AS w2 FROM next i JOIN v_stand t USING (g)), {triangle("near", "pairs")},
  best AS (SELECT g, sub, v FROM (SELECT i.g, t.sub, CAST(CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size AS FLOAT) AS v,
    row_number() OVER (PARTITION BY i.g ORDER BY CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size DESC, t.sub) AS place
    FROM next i JOIN v_stand t USING (g) JOIN near d ON d.w1 = i.word AND d.w2 = t.word) WHERE place = 1)
  SELECT i.ord, b.g, b.ord, b.word, b.sub FROM before b JOIN next i USING (g)
  UNION ALL SELECT i.ord, i.g, i.ord, i.word, CASE WHEN v >= CAST({threshold} AS FLOAT) THEN b.sub ELSE c.n END
  FROM next i JOIN best b USING (g) JOIN (SELECT g, count(DISTINCT sub) AS n FROM before GROUP BY g) c USING (g))),
done AS MATERIALIZED (SELECT w.g, w.ord, w.word, w.sub FROM walk w JOIN (SELECT g, max(ord) AS k FROM {words} GROUP BY g) USING (g, k)),
{stands("z_", "done")},
memory AS (SELECT g, string_agg(word, ',' ORDER BY sub) AS memory FROM z_stand GROUP BY g)"""


STRINGS = ("name", "origin", "code")


def _lv(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE CAST(1 AS FLOAT) - CAST(levenshtein({a}, {b}) AS FLOAT) / CAST(greatest(strlen({a}), strlen({b})) AS FLOAT) END"


#: Words of a list of ``frames``, at most.
LIST_WORDS = 2


def _list_words(k: int) -> list[str]:
    """The words of the lists that the k-th frame gives to chains, one after the other, as steps of sub-memories."""
    out = []
    for i in range(1, LIST_WORDS + 1):
        words = f"SELECT tracker_id AS g, members[{i}] AS word FROM chain{k} c JOIN frames f USING (frame_idx, record_idx) WHERE c.frame_idx = {k} AND len(members) >= {i}"
        out += sub_memory_step(k * LIST_WORDS + i, words, "mw-median", 0.6)
    return out


def _by_defaults(k: int) -> list[str]:
    """``pairs_of{k}`` (tracker_id, record_idx, d0, d1, d2) and ``lists{k}`` (d3): lists remember the medians of sub-memories; similarity is that of the lower triangle."""
    met = " UNION ".join(f"SELECT m.median AS w1, r.{f} AS w2 FROM t{k}_median m JOIN frames r ON r.frame_idx = {k} AND r.{f} IS NOT NULL AND m.g % 3 = {i}" for i, f in enumerate(STRINGS))
    sims = ", ".join(f"d{i}.sim AS d{i}" for i in range(3))
    joins = " ".join(
        f"LEFT JOIN t{k}_median m{i} ON m{i}.g = a.tracker_id * 3 + {i} LEFT JOIN like{k} d{i} ON d{i}.w1 = m{i}.median AND d{i}.w2 = r.{f}" for i, f in enumerate(STRINGS)
    )
    return [
        f"kept{k} AS MATERIALIZED (SELECT g AS tracker_id, sub, word, count(*) OVER (PARTITION BY g) AS n FROM stand{k * LIST_WORDS} JOIN alive{k - 1} ON tracker_id = g)",
        f"members{k} AS (SELECT record_idx, len(members) AS n, unnest(members) AS word FROM frames WHERE frame_idx = {k})",
        f"met{k} AS ({met} UNION SELECT t.word, r.word FROM kept{k} t, members{k} r)", triangle(f"far{k}", f"met{k}"),
        f"like{k} AS MATERIALIZED (SELECT w1, w2, CAST(CAST(1 AS FLOAT) - CAST(e AS FLOAT) / size AS FLOAT) AS sim FROM far{k})",
        f"""lists{k} AS MATERIALIZED (SELECT tracker_id, record_idx, CAST(list_reduce(list(best ORDER BY sub), lambda x, y: CAST(x + y AS FLOAT)) / CAST(greatest(any_value(n), any_value(m)) AS FLOAT) AS FLOAT) AS d3
  FROM (SELECT t.tracker_id, r.record_idx, t.sub, t.n, r.n AS m, max(sim) AS best FROM kept{k} t CROSS JOIN members{k} r JOIN like{k} d ON d.w1 = t.word AND d.w2 = r.word GROUP BY ALL) GROUP BY tracker_id, record_idx)""",
        f"pairs_of{k} AS (SELECT a.tracker_id, r.record_idx, {sims} FROM alive{k - 1} a JOIN frames r ON r.frame_idx = {k} {joins})",
    ]


def tracking(frames: int, threshold: float, limit: int, strategy: str = "best-match", defaults: bool = False) -> str:
    """CTEs of a whole run over ``frames`` (frame_idx, record_idx, name, origin, code, members).

    ``chain`` (tracker_id, frame_idx, record_idx), ``scores`` (tracker_id,
    frame_idx, record_idx, score, distances) and ``live`` (tracker_id,
    frame_idx): the trackers that meet each frame. Strings remember their
    median word, members all lists; similarity is plain edit distance. With
    ``defaults`` both are as ``_by_defaults`` says.
    """
    parts = [
        "chain0 AS (SELECT record_idx AS tracker_id, frame_idx, record_idx FROM frames WHERE frame_idx = 0)",
        "alive0 AS (SELECT tracker_id, 0 AS streak FROM chain0)",
    ]
    if defaults:
        parts = [*parts, _no_words("(SELECT tracker_id AS g FROM chain0)"), *_list_words(0)]
        threshold = f"CAST({threshold} AS FLOAT)"
    for k in range(1, frames):
        words = " UNION ALL ".join(
            f"SELECT tracker_id * 3 + {i} AS g, frame_idx AS ord, {f} AS word FROM cells{k} WHERE {f} IS NOT NULL" for i, f in enumerate(STRINGS)
        )
        sims = ", ".join(f"CAST({_lv(f'm{i}.median', f'r.{f}')} AS FLOAT) AS d{i}" for i, f in enumerate(STRINGS))
        joins = " ".join(f"LEFT JOIN t{k}_median m{i} ON m{i}.g = a.tracker_id * 3 + {i}" for i in range(3))
        best = "list_max(list_transform(r.members, lambda b: " + _lv("x", "b").replace("CASE WHEN x IS NULL OR b IS NULL THEN NULL ELSE ", "").removesuffix(" END") + "))"
        total = "CAST(0 AS FLOAT)"
        for i in range(4):
            total = f"({total} + coalesce(d{i}, CAST(0 AS FLOAT)))"
        parts += [
            f"cells{k} AS MATERIALIZED (SELECT c.tracker_id, f.* FROM chain{k - 1} c JOIN alive{k - 1} USING (tracker_id) JOIN frames f ON f.frame_idx = c.frame_idx AND f.record_idx = c.record_idx)",
            f"words{k} AS ({words})", medians(f"t{k}_", f"words{k}"),
            *(_by_defaults(k) if defaults else [
                f"""lists{k} AS MATERIALIZED (SELECT c.tracker_id, r.record_idx, max(CAST(list_sum(list_transform(c.members, lambda x: {best})) AS FLOAT) / CAST(greatest(len(c.members), len(r.members)) AS FLOAT)) AS d3
  FROM cells{k} c JOIN frames r ON r.frame_idx = {k} GROUP BY ALL)""",
                f"pairs_of{k} AS (SELECT a.tracker_id, r.record_idx, {sims} FROM alive{k - 1} a JOIN frames r ON r.frame_idx = {k} {joins})",
            ]),
            f"""scores{k} AS MATERIALIZED (SELECT tracker_id, CAST({k} AS INTEGER) AS frame_idx, record_idx, score, [d0, d1, d2, d3] AS distances FROM (
  SELECT *, CAST({total} / CAST(4 AS FLOAT) AS FLOAT) AS score FROM pairs_of{k} JOIN lists{k} USING (tracker_id, record_idx)) WHERE score > {threshold})""",
        ]
        if strategy == "simple":
            parts.append(f"matches{k} AS MATERIALIZED (SELECT tracker_id, record_idx FROM (SELECT *, row_number() OVER (PARTITION BY tracker_id ORDER BY score DESC, record_idx) AS place FROM scores{k}) WHERE place = 1)")
            born = "SELECT CAST(0 AS BIGINT) AS tracker_id, CAST(0 AS BIGINT) AS record_idx WHERE false"
        else:
            parts.append(f"""order{k} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, {TIE} DESC, tracker_id, record_idx) AS n FROM scores{k}),
greedy{k}(n, ts, rs, won) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false
  UNION ALL
  SELECT n, CASE WHEN ok THEN list_append(ts, tracker_id) ELSE ts END, CASE WHEN ok THEN list_append(rs, record_idx) ELSE rs END, ok
  FROM (SELECT o.n, o.tracker_id, o.record_idx, ts, rs, NOT list_contains(ts, o.tracker_id) AND NOT list_contains(rs, o.record_idx) AS ok FROM greedy{k} g JOIN order{k} o ON o.n = g.n + 1)),
matches{k} AS MATERIALIZED (SELECT tracker_id, record_idx FROM greedy{k} JOIN order{k} USING (n) WHERE won)""")
            born = f"SELECT {k} * CAST(4294967296 AS BIGINT) + record_idx AS tracker_id, record_idx FROM frames WHERE frame_idx = {k} AND record_idx NOT IN (SELECT record_idx FROM matches{k})"
        parts += [
            f"born{k} AS MATERIALIZED ({born})",
            f"""chain{k} AS MATERIALIZED (SELECT * FROM chain{k - 1} UNION ALL SELECT tracker_id, CAST({k} AS INTEGER), record_idx FROM matches{k} UNION ALL SELECT tracker_id, CAST({k} AS INTEGER), record_idx FROM born{k}),
alive{k} AS MATERIALIZED (SELECT * FROM (SELECT tracker_id, CASE WHEN m.record_idx IS NULL THEN streak + 1 ELSE 0 END AS streak FROM alive{k - 1} LEFT JOIN matches{k} m USING (tracker_id)) WHERE streak <= {limit}
  UNION ALL SELECT tracker_id, 0 FROM born{k})""",
        ]
        if defaults and k < frames - 1:
            parts += _list_words(k)
    steps = range(1, frames)
    parts += [
        f"chain AS (SELECT * FROM chain{frames - 1})", "scores AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM scores{k}" for k in steps) + ")",
        "live AS (" + " UNION ALL ".join(f"SELECT tracker_id, CAST({k} AS INTEGER) AS frame_idx FROM alive{k - 1}" for k in steps) + ")",
    ]
    return ",\n".join(parts)


def normalized() -> str:
    """CTE ``done`` (frame_idx, record_idx, name, origin, code, members) from ``frames`` and ``chain``: cluster medians along chains."""
    nodes = "nodes AS MATERIALIZED (SELECT tracker_id, row_number() OVER (PARTITION BY tracker_id ORDER BY frame_idx) - 1 AS pos, f.* FROM chain c JOIN frames f USING (frame_idx, record_idx))"
    flat = " UNION ALL ".join(f"SELECT tracker_id * 4 + {i} AS g, pos * 100 AS ord, pos, {f} AS word FROM nodes WHERE {f} IS NOT NULL" for i, f in enumerate(STRINGS))
    flat += " UNION ALL SELECT g, pos * 100 + unnest(range(len(members))), pos, unnest(members) FROM (SELECT tracker_id * 4 + 3 AS g, pos, members FROM nodes)"
    strings = ", ".join(f"""CASE WHEN f{i}.median IS NULL THEN n.{f} ELSE f{i}.median END AS {f}""" for i, f in enumerate(STRINGS))
    joins = " ".join(f"LEFT JOIN filled f{i} ON f{i}.tracker_id = n.tracker_id AND f{i}.pos = n.pos AND f{i}.f = {i}" for i in range(3))
    return f"""{nodes}, flat AS MATERIALIZED ({flat}),
pairs AS (SELECT DISTINCT x.word AS w1, y.word AS w2 FROM flat x JOIN flat y USING (g)), {TRIANGLE},
{linkage("n_", "flat", "edits")},
large AS (SELECT g, cluster FROM n_cluster GROUP BY g, cluster HAVING count(*) >= 2),
placed AS MATERIALIZED (SELECT g, ord, pos, word, row_number() OVER (PARTITION BY g ORDER BY ord) - 1 AS spot FROM flat),
member AS MATERIALIZED (SELECT * FROM placed JOIN n_cluster USING (g, spot) JOIN large USING (g, cluster)),
clustered AS (SELECT {{'g': g, 'cluster': cluster}} AS g, ord, word FROM member),
{medians("c_", "clustered")},
named AS MATERIALIZED (SELECT g.g AS g, g.cluster AS cluster, median FROM c_median),
own AS (SELECT m.g // 4 AS tracker_id, m.g % 4 AS f, m.pos, n.median FROM member m JOIN named n USING (g, cluster) WHERE m.g % 4 < 3),
spread AS (SELECT tracker_id, f, n.pos, o.median FROM (SELECT DISTINCT tracker_id, f FROM own) JOIN nodes n USING (tracker_id) LEFT JOIN own o USING (tracker_id, f, pos)),
filled AS MATERIALIZED (SELECT tracker_id, f, pos, coalesce(
  last_value(median IGNORE NULLS) OVER (PARTITION BY tracker_id, f ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(median IGNORE NULLS) OVER (PARTITION BY tracker_id, f ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS median FROM spread),
spans AS (SELECT m.g // 4 AS tracker_id, m.cluster, min(m.pos) AS low, max(m.pos) AS high, any_value(n.median) AS median FROM member m JOIN named n USING (g, cluster) WHERE m.g % 4 = 3 GROUP BY m.g, m.cluster),
joined AS (SELECT n.tracker_id, n.pos, string_agg(s.median, '|' ORDER BY s.cluster) AS members FROM nodes n JOIN spans s ON s.tracker_id = n.tracker_id AND n.pos BETWEEN s.low AND s.high GROUP BY ALL),
done AS (SELECT n.frame_idx, n.record_idx, {strings}, coalesce(j.members, '') AS members FROM nodes n {joins} LEFT JOIN joined j ON j.tracker_id = n.tracker_id AND j.pos = n.pos)"""
