"""Secret scans: candidate tokens, native features, and a random forest against false positives.

Candidates, features and the forest's decisions are Catalyst expressions over
the row, so scanning and redacting need no shuffle and no Python. The forest is
fitted on the driver from labelled findings, a bounded table.
"""

from __future__ import annotations

import functools
import random
import string
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinthread.llm.quality import words_of

CANDIDATE = r"([A-Za-z0-9+/_\-]{12,}={0,2})"
#: Rows of the labelled findings that the forest is fitted on.
LABELLED = 3000
TREES, DEPTH, LEAF = 16, 7, 4
MASK = "[SECRET]"

# Words that mark what stands beside them.
KEY_WORDS = "passw|pwd|secret|token|api.?key|access.?key|credential|auth(?!ors?\\b)|bearer|private|signature"
PLAIN_WORDS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|isbn|order|invoice|phone|tel|call|card|iban|version|build|file|image|img|href|src|visit|mail|path|ticket|parcel|see"
#: What links a key word to a value two words on.
LINKS = "[=:]+>?|is|was|ist|war|est|es"
KNOWN_STARTS = "AKIA|ASIA|ghp_|gho_|ghs_|sk-|sk_|xoxb-|xoxp-|AIza|glpat-|eyJ|SG_|npm_"
_TAIL = r"[A-Za-z0-9_\-]{0,16}[\"'`\])]*"
#: A value: all up to the closing quote, or else up to a space or separator, without a sentence's end.
_VALUE = r"((?<=[\"'`])[^\s\"'`]+(?=[\"'`])|[^\s\"'`<>,;]*[^\s\"'`<>,;.:)\]}?])"
KNOWN = rf"(?<![A-Za-z0-9])((?:{KNOWN_STARTS})[A-Za-z0-9_\-.+/]*[A-Za-z0-9_\-]={{0,2}})"
ASSIGNED = rf"(?i)(?:{KEY_WORDS}){_TAIL}[=:]+>?[\"'`(]*{_VALUE}"
KEY_BEFORE = rf"(?i)(?:{KEY_WORDS}){_TAIL}[=:]*>?[\"'`]*$"
BESIDE = rf"^[\"'`(\[{{<=:]*{_VALUE}"
# Dictionary for the coverage feature.
DICTIONARY = (
    "about account action address after again application archive article authentication backup before between "
    "build business center change channel client command commit company component config content context control "
    "country create customer data database default delete design detail develop directory display document domain "
    "download editor email error event example export feature field file filter final folder format frame function "
    "general global group handler header history home image import index info input install interface internal item "
    "language layout level library link list local location login manager market media member memory menu message "
    "method model module network news number object online option order output package page parent part path people "
    "photo player plugin policy post press print private process product profile program project provider public "
    "query report request resource response result review route sample schema school script search section security "
    "select server service session setting setup source state static status store string style summary support "
    "system table team template test text theme thread time title tool total update upload user utility value vendor "
    "version video view website widget window world"
).split()
# Frequent letter pairs of running text.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = [
    "length", "digits", "upper", "transitions", "hexadecimal", "only_digits", "dictionary", "pairs",
    "slashes", "dashes", "uuid", "key_beside", "plain_beside", "assigned", "known", "address", "symbols",
]


def candidates(text: Column) -> Column:
    """array<struct<position, value, word, before, after>> of a text column.

    Candidates are runs of 12 or more token characters with a digit, inside a
    word; whatever has a known start; and any value beside a key word, in the
    same word behind = or :, as the next word, or as the one after a link, of
    any length and any characters. position is the word's index; before holds
    the two words before it and the word's part up to the value.
    """

    def of_text(s: Column) -> Column:
        w, has_key, has_known = s["words"], s["key"], s["known"]

        def of_word(x: Column, i: Column) -> Column:
            def of_value(v: Column) -> Column:
                lead = F.call_function("substring_index", x, v, F.lit(1))
                before = F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1), lead)
                return F.struct(
                    i.alias("position"), v.alias("value"), x.alias("word"), F.lower(before).alias("before"),
                    F.lower(F.coalesce(F.get(w, i + 1), F.lit(""))).alias("after"),
                )

            none = F.array().cast("array<string>")

            def every(test: Column, pattern: str) -> Column:
                return F.when(test, F.regexp_extract_all(x, F.lit(pattern), F.lit(1))).otherwise(none)

            def near(back: int, pattern: str) -> Column:
                return F.coalesce(F.get(w, i - back).rlike(pattern), F.lit(False))

            runs = (F.octet_length(x) >= 12) & x.rlike("[0-9]")
            # a text without any key word, or known start, needs no look at its words
            known, assigned = has_known & x.rlike(KNOWN), has_key & x.rlike(ASSIGNED)
            beside = has_key & (near(1, KEY_BEFORE) | (near(1, f"^(?:{LINKS})$") & near(2, KEY_BEFORE)))
            values = F.array_distinct(F.concat(
                F.filter(every(runs, CANDIDATE), lambda v: v.rlike("[0-9]")),
                every(known, KNOWN), every(assigned, ASSIGNED), every(beside, BESIDE),
            ))
            some = F.filter(values, lambda v: v.rlike(r"[\p{L}\p{N}]"))
            return F.when(runs | known | assigned | beside, F.transform(some, of_value))

        return F.flatten(F.filter(F.transform(w, of_word), lambda found: F.size(found) > 0))

    whole = F.coalesce(text, F.lit(""))
    described = F.struct(
        words_of(text).alias("words"), whole.rlike(f"(?i)(?:{KEY_WORDS})").alias("key"), whole.rlike(f"(?:{KNOWN_STARTS})").alias("known")
    )
    return F.get(F.transform(F.array(described), of_text), 0)


def features(c: Column) -> Column:
    """The forest's inputs for a candidate struct."""
    v, before = c["value"], c["before"]
    n = F.length(v).cast("double")

    def share(pattern: str, of: Column = v) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    def flag(test: Column) -> Column:
        return F.when(test, 1.0).otherwise(0.0)

    low = F.lower(v)
    change = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    values = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "transitions": share(change),
        "hexadecimal": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(v.rlike("^[0-9_-]+$")),
        "dictionary": (n - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda x: (-len(x), x))), ""))) / n,
        "pairs": share("|".join(PAIRS), low),
        "slashes": F.regexp_count(c["word"], F.lit("/")).cast("double"),
        "dashes": F.regexp_count(v, F.lit("[-_]")).cast("double"),
        "uuid": flag(v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")),
        "key_beside": flag(F.concat_ws(" ", before, c["after"]).rlike(KEY_WORDS)),
        "plain_beside": flag(before.rlike(PLAIN_WORDS)),
        "assigned": flag(before.rlike("[=:] ?[\"']?$|[\"'`]$")),
        "known": flag(v.rlike(f"^(?:{KNOWN_STARTS})")),
        "symbols": share("[^A-Za-z0-9]"),
        "address": flag(c["word"].rlike(r"@|://|\.(?:com|org|net|html?|png|jpe?g|pdf|py|js|css|txt)")),
    }
    return F.struct(*(values[name].cast("double").alias(name) for name in FEATURES))


# ------------------------------------------------------------ labelled findings


def labelled_findings(rows: int = LABELLED, seed: int = 5) -> list[tuple[int, str]]:
    """(label, sentence with one finding): 1 a live secret, 0 a false positive."""
    return [(label, text) for label, text, _ in labelled_values(rows, seed)]


def labelled_values(rows: int = LABELLED, seed: int = 5) -> list[tuple[int, str, str]]:
    """labelled_findings with the secret itself, empty for a false positive."""
    rng = random.Random(seed)
    plain = "of the and to in on was that this with for is report found note value then page line".split()
    hexa = string.hexdigits[:16]

    def chars(alphabet, low, high=None):
        return "".join(rng.choices(alphabet, k=rng.randint(low, high or low)))

    def invented():
        return "".join(rng.choices(["th", "er", "ou", "an", "in", "ti", "on", "re", "ed", "st", "le", "ver", "ung", "ción", "que"], k=rng.randint(3, 7)))

    def named(words):
        return rng.choice(["-", "_", "/", ""]).join(rng.choices(words, k=rng.randint(2, 4)))

    mixed = string.ascii_letters + string.digits
    keys = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "private_key"]

    def secret():
        """(as written, value)"""
        kind = rng.randrange(12)
        if kind == 0:
            value = rng.choice(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + "234567", 16)
        elif kind == 1:
            value = rng.choice(["ghp_", "gho_"]) + chars(mixed, 36)
        elif kind == 2:
            value = rng.choice(["sk-", "sk_live_", "glpat-", "xoxb-"]) + chars(mixed, 20, 40)
        elif kind == 3:
            value = "AIza" + chars(mixed + "-_", 34) + chars(mixed, 1)
        if kind < 4:
            return value, value
        key = rng.choice(keys)
        forms = [f"{key}={{}}", f'{key} = "{{}}"', f"{key}: {{}}", f'"{key}":"{{}}"', "Bearer {}", f"{key} {{}}"]
        if kind < 8:
            value = rng.choice([chars(hexa, 14, 64), chars(mixed, 14, 44), chars(mixed + "+/", 24, 60) + rng.choice(["", "=", "=="])])
        elif kind == 8:  # short
            value = rng.choice([chars(mixed, 6, 11), rng.choice(DICTIONARY)[:6] + chars(string.digits, 2, 4), chars(string.ascii_lowercase, 2, 4) + chars(string.digits, 3, 5)])
        elif kind == 9:  # symbols break its runs
            value = chars(mixed, 2, 4) + "".join(rng.choice("!.@$#%&*^") + chars(mixed, 1, 5) for _ in range(rng.randint(1, 4))) + rng.choice(["", "!"])
        elif kind == 10:  # a word with symbols and figures
            value = rng.choice(DICTIONARY).title() + rng.choice("!.@$#") + chars(string.digits, 1, 4) + rng.choice(["", "!"])
        else:  # letters only
            value = chars(string.ascii_letters, 12, 44)
        return rng.choice(forms).format(value), value

    def harmless():
        kind = rng.randrange(19)
        if kind == 0:
            return rng.choice(["commit ", "sha1 ", "sha256: ", "md5 ", "checksum ", "hash "]) + chars(hexa, rng.choice([32, 40, 64]))
        if kind == 1:
            return rng.choice(["uuid ", "id ", ""]) + str(uuid.UUID(int=rng.getrandbits(128)))
        if kind == 2:
            return rng.choice(["", "card ", "order ", "invoice ", "iban "]) + chars(string.digits, 12, 20)
        if kind == 3:
            return rng.choice(["+1-", "tel ", ""]) + f"{chars(string.digits, 3)}-{chars(string.digits, 3)}-{chars(string.digits, 4)}"
        if kind == 4:
            return f"{invented()}{chars(string.digits, 1, 4)}@{invented()}.example.com"
        if kind == 5:
            return f"https://www.{invented()}.example.org/{named(DICTIONARY)}/{chars(string.digits, 3, 9)}.html"
        if kind == 6:
            return f"/usr/{named(DICTIONARY)}/{rng.choice(DICTIONARY)}{chars(string.digits, 1, 3)}.txt"
        if kind == 7:
            return named(DICTIONARY) + rng.choice(["-", "_", ""]) + chars(string.digits, 1, 4)
        if kind == 8:
            return invented() + chars(string.digits, 1, 3) + invented()
        if kind == 9:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{chars(string.digits, 6)}"
        if kind == 10:
            return f"version-{chars(string.digits, 1)}-{chars(string.digits, 1, 2)}-{rng.choice(['alpha', 'beta', 'release'])}{chars(string.digits, 1, 3)}"
        if kind == 11:
            return "".join(w.title() for w in rng.choices(DICTIONARY, k=3)) + chars(string.digits, 1, 3)
        if kind == 12:
            return "image " + chars(hexa, 24, 40) + ".png"
        key = rng.choice([*keys, "Authorization", "author", "signature"])
        if kind == 14:
            return f"{key} {rng.choice([*plain, *DICTIONARY, invented()])}"
        if kind == 15:
            return f"{key}{rng.choice([': ', '=', ' = ', ':'])}{rng.choice(['null', 'none', 'true', 'false', 'required', 'yes', 'no', '', rng.choice(DICTIONARY), invented(), invented().title()])}"
        if kind == 16:
            return f"{key} {rng.choice(['is', 'was'])} {rng.choice([*plain, *DICTIONARY, invented()])}"
        if kind == 17:
            return rng.choice(KNOWN_STARTS.split("|")) + rng.choice([chars(string.ascii_letters, 1, 6), named(DICTIONARY), invented()])
        return f"password-{rng.choice(DICTIONARY)}-{rng.choice(DICTIONARY)}{chars(string.digits, 1, 2)}"

    out = []
    for i in range(rows):
        label = i % 2
        middle, value = secret() if label else (harmless(), "")
        around = [rng.choice([*plain, invented()]) for _ in range(8)]
        tail = rng.choice(["", "", ".", ",", ";"])
        out.append((label, " ".join([*around[:4], middle + tail, *around[4:]]), value))
    return out


# ---------------------------------------------------------------------- forest


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A CART tree as nested (feature, threshold, left, right) with leaf probabilities."""
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return share
    best = None
    for f in rng.choice(x.shape[1], size=5, replace=False):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19))):
            left = x[:, f] <= cut
            n = int(left.sum())
            if min(n, len(y) - n) < LEAF:
                continue
            p, q = y[left].mean(), y[~left].mean()
            cost = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or cost < best[0]:
                best = (cost, int(f), float(cut), left)
    if best is None:
        return share
    _, f, cut, left = best
    return (f, cut, grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1))


def tree_sql(tree, row: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, cut, left, right = tree
    return f"IF({row}.{FEATURES[f]} <= {cut!r}D, {tree_sql(left, row)}, {tree_sql(right, row)})"


def tree_score(tree, row) -> float:
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


def labelled_features(spark: SparkSession, rows: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    table = spark.createDataFrame(rows, "label int, text string")
    found = table.select("label", F.transform(candidates(F.col("text")), features).alias("f")).where(F.size("f") > 0).collect()
    pairs = [(r.label, f) for r in found for f in r.f]
    return np.array([list(f) for _, f in pairs]), np.array([label for label, _ in pairs])


def recall(spark: SparkSession, rows: list[tuple[int, str, str]]) -> float:
    """Share of all the secrets of ``rows`` (labelled_values) found whole, those without a candidate included."""
    wanted = [(i, text, value) for i, (label, text, value) in enumerate(rows) if label]
    table = findings(spark.createDataFrame(wanted, "doc_id long, text string, secret string"))
    return table.where(F.exists("findings", lambda c: c["is_secret"] & (c["value"] == F.col("secret")))).count() / len(wanted)


@functools.lru_cache(maxsize=4)
def _forest(app: str, seed: int):
    spark = SparkSession.getActiveSession()
    x, y = labelled_features(spark, labelled_findings())
    rng = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        pick = rng.integers(0, len(y), size=len(y))
        trees.append(grow(x[pick], y[pick], rng))
    return trees


def forest(spark: SparkSession, seed: int = 11) -> list:
    """The trees, fitted once a session on LABELLED findings."""
    return _forest(spark.sparkContext.applicationId, seed)


def findings(docs: DataFrame, name: str = "findings") -> DataFrame:
    """``docs`` with the column ``name``: array<struct<position, value, score, is_secret>>.

    Every candidate of every text, with the forest's share of votes; is_secret
    from one half. Null and empty texts have an empty array. One row per row,
    whatever repeats; a column of that name is replaced. Texts are read whole.
    """
    trees = forest(docs.sparkSession)
    score = f"({' + '.join(tree_sql(t, 'f') for t in trees)}) / {len(trees)}"
    both = F.transform(candidates(F.col("text")), lambda c: F.struct(c["position"].alias("position"), c["value"].alias("value"), features(c).alias("f")))
    out = docs.withColumn(name, both)
    out = out.withColumn(name, F.expr(
        f"transform({name}, c -> struct(c.position AS position, c.value AS value, "
        f"transform(array(c.f), f -> {score})[0] AS score))"
    ))
    return out.withColumn(name, F.expr(
        f"transform({name}, c -> struct(c.position AS position, c.value AS value, c.score AS score, c.score >= 0.5D AS is_secret))"
    ))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, position, value, score, is_secret): a row per candidate of every row of ``docs``.

    Null, empty and other texts without a candidate have none. Repeated rows
    and null doc_ids give their candidates each. A value twice in one word is
    one candidate, in two words two. Texts are read whole, a word at a time.
    Only doc_id and text are read, whatever other columns are called; no rows,
    no result.
    """
    return findings(docs.select("doc_id", "text")).select("doc_id", F.explode("findings").alias("e")).select("doc_id", "e.*")


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in the text masked and n_chars, if present, recounted.

    Rows, other columns (of any names) and texts without secrets stay as they
    are, null and empty ones too. A value is masked wherever it stands by
    itself, never as a part of a longer run of letters and digits.
    """
    columns, name = docs.columns, "findings"
    while name in columns:
        name += "_"
    values = F.transform(F.filter(name, lambda c: c["is_secret"]), lambda c: c["value"])
    quoted = F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))

    def masked(t: Column, v: Column) -> Column:
        exact = F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        return F.regexp_replace(t, F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), exact, F.lit("\\E(?![A-Za-z0-9])")), quoted)

    hidden = F.aggregate(F.array_sort(values, lambda a, b: F.length(b) - F.length(a)), F.col("text"), masked)
    changed = F.exists(name, lambda c: c["is_secret"])
    out = findings(docs, name).withColumn("text", F.when(changed, hidden).otherwise(F.col("text")))
    if "n_chars" in columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return out.select(*columns)
