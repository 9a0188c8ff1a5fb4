"""Quality rules: line-first cleaning, by SQL functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a document that
loses too much of its text is rejected, as is one that fails the base rules.  One pass over each row, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .spans import let

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Phrases of navigation bars, longer ones first, and of legal or technical boilerplate.
NAVIGATION = (
    "skip to content", "back to top", "share this", "contact us", "my account", "about us", "read more", "sign in", "sign up", "log out", "log in",
    "previous", "register", "products", "services", "sitemap", "contact", "account", "logout", "search", "login", "about", "print", "share", "home", "menu", "news", "next", "blog", "help", "cart", "faq",
)
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "enable javascript", "javascript is disabled", "lorem ipsum", "subscribe to our newsletter")
#: A lower-cased line of navigation phrases only, whatever stands between them.
NAVIGATION_LINE = rf"^[^\p{{L}}\p{{N}}]*(?:(?:{'|'.join(NAVIGATION)})(?:[^\p{{L}}\p{{N}}]+|\z))+\z"


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """Splitting at one character needs no regex engine."""
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more, the first included.  ``words`` must be a bound variable.

    If no two windows have equal hashes, none is repeated.  Else windows are sorted by hash, so equal ones are neighbours,
    and their words are compared; a repeated window then adds the words that the one before it hasn't covered.  Cost
    n log n in the text's length.
    """

    def counted(w: Column, hashes: Column) -> Column:
        windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def twice(s: Column) -> Column:
            def same(x: Column, other: Column) -> Column:
                i, k = x["i"], other["i"]
                equal = (x["h"] == other["h"]) & (F.get(w, i) == F.get(w, k)) & (F.get(w, i + 1) == F.get(w, k + 1)) & (F.get(w, i + 2) == F.get(w, k + 2))
                return F.coalesce(equal, F.lit(False))

            return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"]))

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(let(F.sort_array(windows), twice), start, step)["n"]

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(words, h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some).cast("long")


def line_fails(line: Column, words: Column | None = None) -> Column:
    """Whether a line with words fails a rule; ``words`` is their number.  Blank lines never do.

    Punctuation: a line of less than four words without an end mark, or half as many symbols as words.  Navigation:
    separators between a third of the words, or nothing but navigation phrases.  Boilerplate: a phrase of it in a line of
    at most 40 words.
    """

    def by_words(words: Column) -> Column:
        def boilerplate(bare: Column) -> Column:
            found = F.rlike(bare, F.lit(NAVIGATION_LINE))
            for phrase in BOILERPLATE:
                found = found | bare.contains(phrase)
            return found

        unended = (words < 4) & ~F.rlike(line, F.lit(r"[.!?:;,…。][\"')\]]*\s*$"))
        punctuation = unended | ((words >= 4) & (count_of(line, SYMBOLS + "!") * 2 >= words))
        bars = let(count_of(line, "|»›"), lambda n: (n >= 2) & (n * 3 >= words))
        return (words > 0) & (punctuation | bars | ((words <= 40) & let(F.lower(line), boilerplate)))

    return let(F.size(words_of(line)), by_words) if words is None else by_words(words)


def quality_of(text: Column, max_lost: float = 0.5) -> Column:
    """struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, cleaned, kept.

    The text is cut into lines and these into words once; everything else follows from the two.  Null and empty texts
    have no words, fail the base rules and clean to an empty text.  Rows are independent, so ties and repeated rows need
    no rule, and an empty table gives an empty result.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))

    def measured(cut: Column) -> Column:
        lines, own = cut["lines"], cut["words"]
        return F.struct(
            let(F.flatten(own), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(F.filter(lines, lambda x, i: F.size(F.get(own, i)) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.array_join(F.filter(lines, lambda x, i: ~line_fails(x, F.size(F.get(own, i)))), "\n").alias("cleaned"),
        )

    def judged(m: Column) -> Column:
        n_words, n_repeat = m["words"]["n_words"], m["words"]["n_repeat_words"]
        base = (n_words < 50) | (100 * n_repeat > 50 * n_words)
        lost = m["word_chars"] - F.length(F.translate(m["cleaned"], BLANKS, ""))
        return F.struct(n_words.alias("n_words"), *(m[n].alias(n) for n in ("word_chars", "n_symbols", "n_dup_lines")), n_repeat.alias("n_repeat_words"), base.alias("base_failed"), lost.cast("long").alias("lost_chars"), m["cleaned"].alias("cleaned"), (~base & (lost <= m["word_chars"] * max_lost)).alias("kept"))

    cut = let(F.split(text, "\n"), lambda lines: F.struct(lines.alias("lines"), F.transform(lines, words_of).alias("words")))
    return let(let(cut, measured), judged)


def assess(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and one struct column ``quality`` (see ``quality_of``); a column of that name is replaced."""
    return docs.withColumn("quality", quality_of(F.col("text"), max_lost))


def clean(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """Kept documents with their failing lines removed, in the columns of ``docs``; ``n_chars``, if there, follows the text.

    The verdict is exploded rather than filtered: a filter would be moved below the projection and judge every text twice.
    """
    names = docs.columns
    judged = F.filter(F.array(quality_of(F.col("text"), max_lost)), lambda q: q["kept"])
    cleaned = F.transform(judged, lambda q: q["cleaned"])
    rest = [F.col(f"`{n}`") for n in names if n not in ("text", "n_chars")]
    kept = docs.select(*rest, F.explode(cleaned).alias("text"))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(F.col(f"`{n}`") for n in names))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    return assess(docs).select("doc_id", *(F.col(f"quality.{n}").alias(n) for n in names))


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM d)),
g AS (SELECT doc_id, i, word || chr(31) || lead(word) OVER p || chr(31) || lead(word, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, sum(least(3, i - coalesce(before, -3))) AS n_repeat_words
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words FROM w GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS k,
         length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars,
         length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) AS marks,
         length(regexp_replace(line, '[^|»›]', '', 'g')) AS bars,
         lower(line) AS bare FROM l0),
l AS (SELECT doc_id, count(*) FILTER (WHERE k > 0) - count(DISTINCT line) FILTER (WHERE k > 0) AS n_dup_lines,
        coalesce(sum(chars) FILTER (WHERE k > 0 AND (
          (k >= 4 AND marks * 2 >= k) OR (k < 4 AND NOT regexp_matches(line, '[.!?:;,…。]["'')\\]]*\\s*$'))
          OR (k <= 40 AND regexp_matches(bare, '{NAVIGATION_LINE}')) OR (bars >= 2 AND bars * 3 >= k)
          OR (k <= 40 AND ({" OR ".join(f"contains(bare, {_sql_list([p])})" for p in BOILERPLATE)})))), 0) AS lost_chars
      FROM l1 GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= word_chars * 0.5 AS kept, lost_chars
FROM (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, l.n_dup_lines::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, l.lost_chars::BIGINT AS lost_chars,
        coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
      FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id))
"""
