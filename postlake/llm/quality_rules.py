"""Line-first quality rules, all of it in DataFrame functions.

Each line is judged by itself: punctuation and symbol noise, navigation bars, boilerplate sentences. Failed lines
are removed; a document is rejected when that takes more than ``max_lost`` of its word characters, or when it fails
the base rules (under 50 words, or over half its words in repeated 3-word windows).

Defined results: a null text has no words and is rejected; so is an empty one. Equal texts get equal verdicts.
Extra columns are kept by ``clean`` and not read by ``judge``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
#: Phrases that mark a line as boilerplate.
BOILERPLATE = r"(?i)\b(all rights reserved|licensed under the|released under the|copyright \(c\)|cookie policy|privacy policy|terms of (use|service)|subscribe to our newsletter|click here|enable javascript|spdx-license-identifier|powered by|sign up now|follow us on)\b"
#: A text without any of these has no line that fails: symbols, or how one of the phrases begins.
SUSPECT = r"[#*$%&<>]|[!?]{2}|\|[^|]*\||\b[AaLlRrCcPpTtSsEeFf](?i:ll rig|icensed u|eleased u|opyrig|ookie p|rivacy p|erms of|ubscribe t|lick h|nable j|pdx-l|owered b|ign up|ollow us)"
_BITS = 21


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def line_fails(line: Column) -> Column:
    """True for a line that a rule removes. Lines without a word never fail."""
    n = F.size(F.split(F.btrim(line, F.lit(BLANKS)), "[ \\t-\\r]+"))
    left = lambda pattern: F.length(line) - F.length(F.regexp_replace(line, pattern, ""))
    symbols = left("[#*$%&<>]") >= F.greatest(F.lit(3), F.ceil(n * 0.6))
    shouting = left("[!?]{2,}") >= F.greatest(F.lit(4), F.ceil(n * 0.8))
    pipes = left("\\|")
    navigation = (pipes >= 3) & (pipes * 5 >= n)
    return (F.btrim(line, F.lit(BLANKS)) != "") & (symbols | shouting | navigation | F.rlike(line, F.lit(BOILERPLATE)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row, whatever the optimizer merges: a lambda's variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more.

    A window is a 43-bit hash and its place in one long: sorted as plain longs, windows that may be equal are
    neighbours. Only those are compared word by word.
    """
    mask = F.lit((1 << _BITS) - 1)
    n = F.size(w)
    every = F.sequence(F.lit(0), n - 3)
    key = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(-(1 << _BITS))).bitwiseOR(i)
    pairs = lambda keys: F.filter(F.sequence(F.lit(0), n - 4), lambda i: F.shiftright(F.get(keys, i).bitwiseXOR(F.get(keys, i + 1)), _BITS) == 0)
    place = lambda keys, i: F.get(keys, i).bitwiseAND(mask).cast("int")
    places = let(F.sort_array(F.transform(every, key)), lambda keys: F.array_distinct(F.flatten(F.transform(pairs(keys), lambda i: F.array(place(keys, i), place(keys, i + 1))))))
    three = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i"))
    same = lambda t: lambda x, i: (F.get(t, i + 1)["s"] == x["s"]) | (F.get(t, i - 1)["s"] == x["s"])
    hits = let(F.sort_array(F.transform(F.when(n < (1 << _BITS), places).otherwise(every), three)), lambda t: F.sort_array(F.transform(F.filter(t, same(t)), lambda x: x["i"])))
    # Words in the union of [i, i + 2]: each window adds three, less where the next one begins sooner.
    total = let(hits, lambda h: F.aggregate(F.transform(h, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(h, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(n < 4, F.lit(0)).otherwise(total).cast("long")


def _found(t: Column) -> tuple[Column, Column]:
    """Structs of a text's words (n, chars, again) and lines (dup, failed)."""
    words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).alias("again")))
    lines = let(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.when(F.rlike(t, F.lit(SUSPECT)), F.filter(x, line_fails)).otherwise(F.array().cast("array<string>")).alias("failed")))
    return words, lines


def _lost(failed: Column) -> Column:
    return F.length(F.regexp_replace(F.array_join(failed, ""), "[ \\t-\\r]+", "")).cast("long")


def _base_failed(n: Column, again: Column) -> Column:
    return (n < 50) | (100 * again > 50 * n)


def judge(docs: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, lost_chars."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines = _found(t)
    symbols = (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long")
    made = docs.select("doc_id", words.alias("w"), lines.alias("l"), symbols.alias("n_symbols"))
    out = made.select("doc_id", F.col("w.n").alias("n_words"), F.col("w.chars").alias("word_chars"), "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.again").alias("n_repeat_words"), F.size("l.failed").cast("long").alias("n_failed_lines"), _lost(F.col("l.failed")).alias("lost_chars"))
    base = _base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"), "n_failed_lines", "lost_chars")


def clean(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The documents that are kept, without their failed lines; the other columns stay. Each row is judged by itself, whatever its doc_id."""
    words, lines = _found(F.coalesce("text", F.lit("")))
    kept = let(F.struct(words.alias("w"), lines.alias("l")), lambda v: ~_base_failed(v["w"]["n"], v["w"]["again"]) & (_lost(v["l"]["failed"]) <= max_lost * v["w"]["chars"]))
    left = F.filter(F.split("text", "\n"), lambda x: ~line_fails(x))
    return docs.where(kept).withColumn("text", F.array_join(left, "\n"))


#: Fixed values as DuckDB takes them.
_SQL_BOILERPLATE = BOILERPLATE.removeprefix("(?i)").replace("'", "''")
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS x FROM w),
m AS (SELECT doc_id, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n, length(x) - length(regexp_replace(x, '[#*$%&<>]', '', 'g')) AS sy, length(x) - length(regexp_replace(x, '[!?]{{2,}}', '', 'g')) AS sh, length(x) - length(replace(x, '|', '')) AS pi FROM l),
f AS (SELECT doc_id, x FROM m WHERE sy >= greatest(3, ceil(n * 0.6)) OR sh >= greatest(4, ceil(n * 0.8)) OR (pi >= 3 AND pi * 5 >= n) OR regexp_matches(x, '{_SQL_BOILERPLATE}', 'i')),
lost AS (SELECT doc_id, count(*) AS c, sum(length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g'))) AS n FROM f GROUP BY doc_id),
a AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.c, 0)::BIGINT AS n_failed_lines, coalesce(lost.n, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= 0.5 * word_chars AS kept, n_failed_lines, lost_chars FROM b
"""
