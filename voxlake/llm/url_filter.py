"""URL filter: block and allow rules, then host word segmentation and naive Bayes.

Host names run words together.  A unigram Viterbi search splits each run of letters in a host or
path at the most probable words; word counts come from the text of all pages and from the seed
words.  No dictionary is shipped or cut: the distinct runs' substrings, of every length that a
counted word has, meet the full table of counts in a join, and each run is split by the words that
it holds.

Multinomial naive Bayes over the words of host and path then gives the verdict for URLs that no
rule fits.  Its prior knowledge is a fixed list of seed names per class; what it learns comes from
all URLs that a rule does judge: a word counts as far as its odds between blocked and allowed ones
are surely, by ``SURE`` standard errors, off 0.  Words that the rules name say nothing.

Runs, words and substrings that a thousandth of all rows or more hold, a thousand at most, are
joined by broadcast; so no task gets the rows of a hot one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.common import join_counted, materialise

# Rules as (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

# Seed names, written as words, that the classifier knows from the start.  They are general
# vocabulary, not names from the tables; words that either class uses stand in both lists.
BLOCK_SEEDS = """
casino; online casino bonus; casino games; live casino; poker; poker rooms; slots; slots jackpot; jackpot; sports betting odds; betting; bets; bet; gambling;
roulette; roulette live; blackjack; bookmaker; baccarat; bingo bonus; lottery; lottery winner claim; sweepstakes; wager;
adult; adult video; adult dating; xxx; xxx movies; porn; porn tube; porno; sex; sex chat; nude; nude cams; nudes; escort; escort girls; hot singles dating; erotic; hentai; milf; webcam girls; fetish; nsfw; hookup; camgirls;
viagra; buy viagra online; cialis; cialis discount; levitra; pills; diet pills; pharmacy no prescription; weight loss pills; steroids; replica; replica shop; replica watches; counterfeit; fake watches cheap;
spam; spam mail blast; spammer; spamming; link farm; ads; ads server; banner ads; click ads; popup; popup ads; adserver; adware; advertising; adtracker; tracker; tracking; tracking pixel; doubleclick; clickbait; affiliate; affiliate offers; telemetry;
payday; payday loans fast; loans; quick cash loan; get rich quick; crypto doubler; doubler; ponzi; scam; scams; fraud; free prizes winner; giveaway claim;
warez; warez cracks; cracks; crack; keygen; keygen serial; torrent; torrents; torrent piracy free; pirated; piracy; malware; malware download; spyware; ransomware; trojan; botnet; phishing; phishing login verify; backlinks; cheap seo backlinks; hacked
"""
ALLOW_SEEDS = """
city library; university research; school news; science journal; history museum; public health; national weather service;
open source project; software documentation; developer blog; travel guide; garden recipes; cooking school; art gallery;
music review; film archive; book club; language course; math lessons; physics lectures; chemistry notes; daily news;
local government; tax office help; train timetable; bicycle repair; nature photos; bird watch; medical encyclopedia;
law review; world economy; football results; chess puzzles; mountain hiking; family history; craft workshop; blog archive;
product manual; community forum; question answer; dictionary entries; map data; image archive; press office; site index;
free software; free books; online course; online shop; online banking help; video lessons; video archive; live music; live weather; cheap flights; cheap hotels;
fast food recipes; quick start guide; sports club; sports news; chat help; mail server; login; download; download center; movies; movie guide; games; video games; cash register manual;
health clinic; pharmacy; city pharmacy; hospital pharmacy; hotel rooms; rooms; watches; watch repair; girls school; boys school; singles chart; winner of the prize; nobel prizes; serial novel; buy books; discount store;
farm; organic farm; farm shop; sheep farm; link; link list; click here; banner; pixel art; mail; seo guide; rich history; lose weight; weight; win; offers; special offers; claim form; hot springs; tube map; race track; track record;
sussex; essex; middlesex; wessex; sexton; better; alphabet; diabetes; tibet; elizabeth; between; bethlehem; adsorption; roads; railroads; loads; uploads; heads; threads; beads; leads; crackers; nutcracker; spills; caterpillars; cockpit; grapes; analysis; classic; assets
"""
COMMON = {"www", "com", "net", "org", "http", "https", "html", "htm", "php", "index"}  # fixed values: tokens that say nothing
LONGEST_WORD = 24  # that counts unless told otherwise; the registered query sets no bound
PART_LETTERS = 4_000_000  # of substrings, that leave a task together
SEED_COUNT = 50  # each seed word counts as if the pages held it so many times
PRIOR_BLOCK, SMOOTHING = 0.3, 0.05  # one bad word, seen once, is enough; one that both lists have is not
SURE = 3.0  # standard errors that are taken off what the rules' verdicts teach about a word


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # a later, longer one overrides
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_UNSEEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_TAG, _LETTERS = re.compile(r"<[^>]*>"), re.compile(r"[^\W\d_]+")


def words_of_page(html: str) -> list[str]:
    """Runs of letters of the page's text, in lower case; scripts, styles and comments are no text."""
    seen = _UNSEEN.sub(" ", html)
    tags = seen.rfind(">") + 1  # no tag ends behind it: what follows is text, and isn't searched in vain
    return _LETTERS.findall(unescape(_TAG.sub(" ", seen[:tags]) + seen[tags:]).lower())


def word_counts(pages: DataFrame, html_col: str = "html", longest: int | None = LONGEST_WORD) -> DataFrame:
    """(word, n): how often the pages hold each word of 2 letters or more, up to ``longest`` (None:
    of any length).  Counts are combined in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None:
                    found.update(w for w in words_of_page(t) if len(w) > 1 and (longest is None or len(w) <= longest))
                if len(found) > 200_000:  # counts so far leave the task
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return pages.select(html_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment(run: str, words: dict[str, float], unknown: float) -> list[str]:
    """The most probable words of one run of letters: Viterbi.

    ``words`` are log probabilities; a letter outside every word costs ``unknown`` and joins its
    neighbours into one unknown word."""
    longest = max(map(len, words), default=0)
    best, last = [0.0], [0]
    for end in range(1, len(run) + 1):
        score, start = best[end - 1] + unknown, end - 1
        for k in range(max(0, end - longest), end):
            p = words.get(run[k:end])
            if p is not None and best[k] + p > score:
                score, start = best[k] + p, k
        best.append(score)
        last.append(start)
    cut, pieces = len(run), []
    while cut:
        pieces.append(run[last[cut] : cut])
        cut = last[cut]
    merged: list[str] = []
    loose = False
    for w in reversed(pieces):
        known = w in words
        if not known and loose:
            merged[-1] += w
        else:
            merged.append(w)
        loose = not known
    return merged


def seed_counts(block: str, allow: str) -> list[Counter]:
    """Counts of the words of each class's names."""
    return [Counter(w for name in text.split(";") for w in name.split()) for text in (block, allow)]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, segments) for ``runs`` (key, run), distinct; ``counts`` is (word, n)."""
    mass = counts.agg(F.sum("n")).first()[0] or 1
    most = runs.agg(F.max(F.length("run"))).first()[0] or 0
    # lengths that words have, no longer than the longest run: the driver holds one number for each
    lengths = sorted(r[0] for r in counts.select(F.length("word").alias("k")).where(F.col("k").between(2, most)).distinct().collect())

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                letters = 0
                for k in range(len(run)):
                    for n in lengths:
                        if k + n > len(run):
                            break
                        found.add(run[k : k + n])
                        letters += n
                    if found and (letters > PART_LETTERS or k + 1 == len(run)):  # a very long run in parts
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), pa.array(sorted(found))], ["key", "word"])
                        found, letters = set(), 0

    found = materialise(runs.select("key", "run").mapInArrow(substrings, "key string, word string"), "url-substrings")
    inside = materialise(counts.join(found.groupBy("word").agg(F.count(F.lit(1)).alias("hits")), "word"), "url-words")
    held = join_counted(found, inside, "word", "hits", inside)
    words = held.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", F.log(F.col("n") / F.lit(float(mass))).alias("p")))).alias("words"))
    unknown = math.log(1.0 / mass) - 2.0

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(run: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([segment(r, dict(w) if w is not None else {}, unknown) for r, w in zip(run, words, strict=True)])

    return runs.join(words, "key", "left").select("key", split("run", "words").alias("segments"))


def token_odds(tokens: DataFrame, rules: list[tuple[str, str, str]], block: str, allow: str, smoothing: float) -> DataFrame:
    """(token, odds): log odds of block against allow, from ``tokens`` (token, n_block, n_allow),
    distinct, and the seeds; tokens that say nothing have no row."""
    spark = tokens.sparkSession
    by_class = seed_counts(block, allow)
    seen = sorted(set(by_class[0]) | set(by_class[1]))
    sizes = [sum(c.values()) + smoothing * len(seen) for c in by_class]
    fixed = [(w, math.log((by_class[0][w] + smoothing) / sizes[0]) - math.log((by_class[1][w] + smoothing) / sizes[1])) for w in seen]
    seeds = spark.createDataFrame(fixed, "token string, seed double")
    named = sorted({w for _, host, path in rules for w in _LETTERS.findall(f"{host} {path}".lower())})
    tokens = tokens.where(~F.col("token").isin([*named, *sorted(COMMON)]))
    total = tokens.agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a")).first()
    b, a = F.col("n_block") + 0.5, F.col("n_allow") + 0.5
    taught = F.log(b / F.lit(float(total["b"] or 0) + 1)) - F.log(a / F.lit(float(total["a"] or 0) + 1))
    sure = F.signum(taught) * F.greatest(F.abs(taught) - SURE * F.sqrt(1 / b + 1 / a), F.lit(0.0))
    learnt = tokens.select("token", sure.alias("learnt")).where("learnt <> 0")
    odds = learnt.join(seeds, "token", "full").select("token", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("learnt", F.lit(0.0))).alias("odds"))
    return odds.where(~F.col("token").isin(sorted(COMMON)))


def filter_urls(
    pages: DataFrame,
    counts: DataFrame | None = None,
    rules: list[tuple[str, str, str]] = RULES,
    block: str = BLOCK_SEEDS,
    allow: str = ALLOW_SEEDS,
    prior_block: float = PRIOR_BLOCK,
    smoothing: float = SMOOTHING,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, segments, block_odds) of every URL.

    ``counts`` (word, n), such as ``word_counts`` gives, is the segmentation's dictionary beside the
    seeds.  The verdict is the rule's, or else ``block`` if the odds are above 0.  A null URL or one
    without ``://`` has an empty host and path, no segments, and is allowed.  Ties in length
    between rules go to the alphabetically later one; repeated rows and null ids get their
    own result; extra columns are not carried."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rule, fixed = matching_rule(F.col("host"), F.col("path"), rules)
    labels = F.split("host", r"\.")
    names = F.concat_ws("/", F.when(F.size(labels) > 1, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels), F.col("path"))
    rows = pages.select(F.col(id_col).alias("_page"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("fixed", fixed)
    rows = rows.withColumn("runs", F.regexp_extract_all(F.lower(names), F.lit(r"(\p{L}+)"), F.lit(1)))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    every = rows.select("_row", "fixed", F.posexplode("runs").alias("at", "run")).withColumn("key", F.md5("run"))
    judged = lambda what: F.count_if(F.col("fixed").eqNullSafe(F.lit(what)))
    runs = materialise(every.groupBy("key").agg(F.first("run").alias("run"), F.count(F.lit(1)).alias("n"), judged("block").alias("n_block"), judged("allow").alias("n_allow")), "url-runs")

    seeds = [(w, SEED_COUNT) for c in seed_counts(block, allow) for w in c if len(w) > 1]
    seeded = spark.createDataFrame(seeds, "word string, n long")
    known = (seeded if counts is None else seeded.unionByName(counts.select("word", "n"))).groupBy("word").agg(F.sum("n").alias("n"))
    split = materialise(segmented(runs, materialise(known, "word-counts")).join(runs.drop("run"), "key"), "url-segments")

    said = split.select("key", "n_block", "n_allow", F.explode("segments").alias("token"))
    tokens = materialise(said.groupBy("token").agg(F.sum("n_block").alias("n_block"), F.sum("n_allow").alias("n_allow"), F.count(F.lit(1)).alias("n")), "url-tokens")
    odds = token_odds(tokens, rules, block, allow, smoothing).join(tokens.select("token", "n"), "token")
    by_run = join_counted(said.select("key", "token"), odds, "token", "n", tokens).groupBy("key").agg(F.sum("odds").alias("odds"))
    plain = F.filter("segments", lambda w: ~w.isin(sorted(COMMON)))
    table = split.join(by_run, "key", "left").select("key", "n", plain.alias("segments"), F.coalesce("odds", F.lit(0.0)).alias("odds"))
    table = materialise(table, "url-runs-judged")
    found = join_counted(every.select("_row", "at", "key"), table, "key", "n", table)
    own = found.groupBy("_row").agg(F.sum("odds").alias("odds"), F.sort_array(F.collect_list(F.struct("at", "segments"))).alias("parts"))
    prior = math.log(prior_block) - math.log(1 - prior_block)
    total = F.round(F.lit(prior) + F.coalesce("odds", F.lit(0.0)), 9)  # sums come in any order
    verdict = F.coalesce("fixed", F.when(total > 0, "block").otherwise("allow"))
    segments = F.coalesce(F.flatten(F.transform("parts", lambda p: p["segments"])), F.array().cast("array<string>"))
    return rows.join(own, "_row", "left").select(F.col("_page").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), segments.alias("segments"), total.alias("block_odds"))
