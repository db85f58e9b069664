"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean column that is true if it rejects.  Rules are tried in an order, and
a later rule is evaluated only for rows that the earlier ones let pass (nested CASE WHEN).
The order puts first what rejects most per cost; cost and selectivity of each rule are
estimated on a bounded sample, drawn by a hash of the text.  A cost is counted, not timed: the
characters that a rule reads, as the rule states them for each text.  (Timed on a sample, rules of
about equal cost came out in another order every time.)  The order never changes the verdict.

Words are runs of ``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, symbols that are counted.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
NGRAM = 5
SAMPLE_ROWS = 200
FEW = 32  # repeated runs of a text that are looked up in a list


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def removed_length(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are one of ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeated_words(words: Column, size: int = NGRAM) -> Column:
    """Words that a run of ``size`` words covers which the text holds twice or more."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(words[i + k] for k in range(size))))

    def total(places: Column) -> Column:
        """Words that runs at ascending places cover."""
        steps = F.transform(places, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - i, F.lit(size))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def places_of(hashes: Column, repeated: Column) -> Column:
        """Where the hashes are that repeat: looked up if they are few, else by sorting pairs."""
        few = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i)), lambda i: i.isNotNull())

        def covered(p: Column) -> Column:
            again = F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < F.size(p) - 1) & (F.get(p, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(repeated) <= FEW, few).otherwise(_let(pairs, covered))

    def count(hashes: Column) -> Column:
        in_order = F.sort_array(hashes)
        repeated = _let(in_order, lambda q: F.array_distinct(F.filter(q, lambda h, k: (k > 0) & (F.get(q, k - 1) == h))))
        found = _let(repeated, lambda r: _let(places_of(hashes, r), total))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    return F.when(n < size, F.lit(0).cast("long")).otherwise(_let(runs, count))


def base_statistics(text: Column) -> Column:
    """Struct of ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words``.  A null text has no words, lines or symbols: all are 0.

    One expression that binds what it uses more than once: a filter on a result can be pushed
    below it without splitting the text anew for each use."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return _let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            removed_length(text, SYMBOLS).alias("n_symbols"),
            _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
        ),
    )


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a Boolean column, never null, from the base statistics and the text
    (never null); ``passes`` is how often it reads the text, ``fixed`` its other cost in characters."""

    name: str
    rejects: Callable[[Column, Column], Column]
    passes: float = 1.0
    fixed: float = 8.0


def rules() -> list[Rule]:
    """The production rules.  Each looks for text that isn't prose, with wide margins."""
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return [
        Rule("symbols", lambda s, t: 10 * s["n_symbols"] > s["n_words"], passes=0),
        Rule("word_length", lambda s, t: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"]), passes=0, fixed=16),
        Rule("duplicate_lines", lambda s, t: 3 * s["n_dup_lines"] > F.size(F.split(t, "\n"))),
        Rule("capitals", lambda s, t: removed_length(t, big) > removed_length(t, small), passes=2),
        Rule("exclamations", lambda s, t: 5 * removed_length(t, "!") > s["n_words"]),
        Rule("braces", lambda s, t: 10 * removed_length(t, "{}[]\\^~") > s["n_words"]),
        Rule("digits", lambda s, t: 2 * removed_length(t, "0123456789") > s["word_chars"]),
    ]


def order_rules(docs: DataFrame, found: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order by rejections per cost; ties keep their order.

    Both are measured on about ``sample_rows`` rows of ``docs``, by a hash of the text, that the base
    rules let pass; equal texts count once.  Only sums reach the driver, and the sample only
    steers the order of evaluation."""
    one_in = max(1, docs.count() // sample_rows)
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    chosen = text.where(F.pmod(F.xxhash64("t"), F.lit(one_in).cast("long")) == 0).distinct()
    passed = chosen.withColumn("s", base_statistics(F.col("t"))).where(~base_failed(F.col("s")))
    said = [F.count_if(r.rejects(F.col("s"), F.col("t"))).alias(f"r{k}") for k, r in enumerate(found)]
    costs = [F.avg(F.lit(float(r.passes)) * F.length("t") + F.lit(float(r.fixed))).alias(f"c{k}") for k, r in enumerate(found)]
    row = passed.agg(F.count(F.lit(1)).alias("n"), *said, *costs).first()
    if not row["n"]:
        return list(found)
    worth = [(row[f"r{k}"] + 0.5) / (row["n"] + 1) / row[f"c{k}"] for k in range(len(found))]
    return [found[k] for k in sorted(range(len(found)), key=lambda k: (-worth[k], k))]


def first_rejection(ordered: list[Rule], stats: Column, text: Column) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(ordered):
        out = F.when(r.rejects(stats, text), F.lit(r.name)).otherwise(out)
    return out


def quality_cascade(docs: DataFrame, found: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the base statistics, ``base_failed`` and ``kept`` to ``docs``.

    The base rules come first; the other rules run as a cascade on what they let pass.  Null,
    empty and short texts (under ten words) fail the base.  Repeated rows and null ids get
    their own verdict.  Columns of ``docs`` named like an added one are replaced."""
    stats_names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    plain = docs.drop(*stats_names, "base_failed", "kept", "_judged", "_stats")
    found = rules() if found is None else found
    ordered = order_rules(plain, found, text_col, sample_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judge(s: Column) -> Column:
        failed = base_failed(s)
        verdict = F.when(failed, F.lit(False)).otherwise(first_rejection(ordered, s, text).isNull())
        return F.struct(*(s[n].alias(n) for n in stats_names), failed.alias("base_failed"), verdict.alias("kept"))

    judged = plain.withColumn("_judged", _let(base_statistics(F.col(text_col)), judge))
    return judged.select(*plain.columns, *(F.col(f"_judged.{n}").alias(n) for n in [*stats_names, "base_failed", "kept"]))


#: DuckDB SQL for the query over ``documents``; the same rules on the same statistics.
STATISTICS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
p AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
g AS (SELECT rid, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, w1, w2, w3, w4) AS n FROM g WHERE w4 IS NOT NULL),
c AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS k FROM s WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, len(string_split(text, chr(10))) AS n_lines FROM d),
b AS (SELECT d.rid, d.doc_id, d.text, CAST(len(w.words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(d.text) - length(translate(d.text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(len(l.lines) - len(list_distinct(l.lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, l.n_lines AS n_lines
  FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
v AS (SELECT *, NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 3 * n_dup_lines > n_lines
  OR length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) > length(text) - length(translate(text, 'abcdefghijklmnopqrstuvwxyz', ''))
  OR 5 * (length(text) - length(translate(text, '!', ''))) > n_words
  OR 10 * (length(text) - length(translate(text, '{{}}[]\^~', ''))) > n_words
  OR 2 * (length(text) - length(translate(text, '0123456789', ''))) > word_chars) AS kept FROM f)
"""
QUERY_SQL = STATISTICS_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM v"
