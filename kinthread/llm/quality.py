"""Quality rules: text statistics and cross-document line frequency, all in Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinthread.llm.common import SALTS, SPACE, WORD, stored

SYMBOLS = "#*$%&|<>"
#: A line in more distinct documents of its host than this is removed from all of them.
LINE_DOCS = 20
#: Percentage of a document's words; one that loses more is rejected.
MOST_REMOVED = 50
LEAST_WORDS = 50
MOST_REPEATED = 50


def let(value, body):
    """``body`` of ``value`` bound to a lambda variable, so evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text):
    """Words of a text column; none for null."""
    parts = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
    return parts


def repeat_words(words):
    """Words inside 3-word windows that occur at least twice.

    The windows' 64-bit hashes are sorted together with their positions (packed
    into the low bits); neighbours of one hash are repeats.
    """

    def counted(w):
        n = F.size(w)
        grams = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

        def of_grams(h):
            bits = F.length(F.bin(n.cast("long")))
            shifted = F.transform(
                h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))
            )

            def of_keys(keys):
                mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

                def same(a, b):
                    # adjacent keys agree in the hash's low bits; the whole hash decides
                    return F.coalesce(
                        F.get(h, a.bitwiseAND(mask).cast("int")) == F.get(h, b.bitwiseAND(mask).cast("int")),
                        F.lit(False),
                    )

                at = F.sort_array(F.filter(
                    F.transform(keys, lambda k, j: F.when(
                        same(k, F.get(keys, j - 1)) | same(k, F.get(keys, j + 1)), k.bitwiseAND(mask).cast("int")
                    )),
                    lambda p: p.isNotNull(),
                ))
                start = F.struct(F.lit(0).alias("covered"), F.lit(-3).alias("last"))
                return F.aggregate(
                    at, start,
                    lambda acc, p: F.struct(
                        (acc["covered"] + F.least(F.lit(3), p - acc["last"])).alias("covered"), p.alias("last")
                    ),
                    lambda acc: acc["covered"],
                )

            repeated = F.size(F.array_distinct(h)) < F.size(h)
            return F.when(repeated, let(F.sort_array(shifted), of_keys)).otherwise(0)

        return F.when(n >= 4, let(grams, of_grams)).otherwise(0)

    return let(words, counted).cast("long")


def base_statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text column."""
    text = F.coalesce(text, F.lit(""))
    with_word = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "n_words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words_of(text)),
    }


def normal_line(line):
    """A line lower-cased, its white space single and trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _line_hashes(text):
    """array<struct<line, words>>: the normalised lines that have a word, hashed."""
    return F.transform(
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)),
        lambda line: let(normal_line(line), lambda x: F.struct(
            F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words")
        )),
    )


def _described(docs: DataFrame) -> DataFrame:
    """Statistics and line hashes of ``docs`` with a stored column ``row``; ``doc`` tells documents apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "row", "doc_id", F.pmod("row", F.lit(SALTS)).alias("salt"),
        F.xxhash64("source").alias("host"), F.xxhash64("text").alias("same"),
        # a row without an id is a document of its own
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("row"), "row")).otherwise(F.xxhash64("doc_id")).alias("doc"),
        *(c.alias(name) for name, c in base_statistics(F.col("text")).items()), _line_hashes(text).alias("lines"),
    )


def frequent_lines(rows: DataFrame, line_docs: int, of: str) -> DataFrame:
    """(host, line, salt) of the lines in more than ``line_docs`` documents of their host, for every salt that has them.

    A line in most rows is counted in part where it is read, and goes back to
    the salts that have it, so none of its joins has it in one task.
    """
    lines = rows.select("host", of, "salt", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    many = stored(
        lines.select("host", "line", of).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") > line_docs).select("host", "line"), "frequent",
    )
    return lines.select("host", "line", "salt").distinct().join(many, ["host", "line"])


def _verdicts(
    rows: DataFrame, line_docs: int, most_removed: int, least_words: int, most_repeated: int, of: str,
) -> DataFrame:
    """``rows`` with base_failed, n_removed, kept, and ``gone``: the hashes of the lines that go."""
    removed = (
        rows.select("row", "host", "salt", F.explode("lines").alias("e")).select("row", "host", "salt", "e.line", "e.words")
        .join(frequent_lines(rows, line_docs, of), ["host", "line", "salt"])
        .groupBy("row").agg(F.sum("words").cast("long").alias("n_removed"), F.collect_set("line").alias("gone"))
    )
    base_failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")
    )
    out = rows.drop("lines").join(removed, "row", "left").withColumns({
        "base_failed": base_failed, "n_removed": F.coalesce("n_removed", F.lit(0).cast("long")),
    })
    depleted = 100 * F.col("n_removed") > most_removed * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(
    docs: DataFrame, line_docs: int = LINE_DOCS, most_removed: int = MOST_REMOVED,
    least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, distinct_texts: bool = False,
) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, n_removed, kept) of every row; host is ``source``.

    Lines are normalised (case, white space) and hashed to 64 bits. A line in
    more than ``line_docs`` distinct documents of a host is removed from all
    its documents there; a document that so loses more than ``most_removed``
    per cent of its words is depleted and not kept. Rows of one doc_id are one
    document. With ``distinct_texts`` documents of one text are one too, so that
    copying alone condemns nothing. Lines without a word don't count.

    Null and empty texts have no words and fail the base rules. A null source
    is a host of its own. Very long texts are read whole. Only doc_id, text and
    source are read, further columns, of any names, are ignored; an empty table
    gives none. A hot line or host is counted in parts.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source")
    rows = stored(_described(plain), "quality")
    out = _verdicts(rows, line_docs, most_removed, least_words, most_repeated, "same" if distinct_texts else "doc")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept",
    )


def clean(
    docs: DataFrame, line_docs: int = LINE_DOCS, most_removed: int = MOST_REMOVED,
    least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, distinct_texts: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, without the lines that it removes, other lines in order.

    n_chars, if there, is recounted; other columns, of any names, stay as they
    are. Null and empty texts have no words, fail the base rules and go.
    Repeated rows are judged alike, each by itself; a line that they share is
    of one document (one doc_id). Texts are whole however long, lines without a
    word stay. A null source is a host of its own. No rows give none.
    """
    columns = docs.columns
    held = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("held")), "documents")
    rows = stored(_described(held.select("row", *(F.col("held")[c].alias(c) for c in ("doc_id", "text", "source")))), "quality")
    kept = _verdicts(rows, line_docs, most_removed, least_words, most_repeated, "same" if distinct_texts else "doc")
    out = held.join(kept.where("kept").select("row", F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone")), "row")
    lines = F.filter(
        F.split(F.col("held")["text"], "\n", -1),
        lambda line: ~(line.rlike(WORD) & F.array_contains("gone", F.xxhash64(normal_line(line)))),
    )
    text = F.when(F.size("gone") > 0, F.array_join(lines, "\n")).otherwise(F.col("held")["text"])
    made = {c: F.col("held")[c] for c in columns} | {"text": text}
    if "n_chars" in columns:
        made["n_chars"] = F.when(F.size("gone") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("held")["n_chars"])
    return out.select(*(c.alias(name) for name, c in made.items()))
