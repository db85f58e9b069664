"""Operators on pages and embeddings against plain versions."""

from __future__ import annotations

import collections
import gzip
import hashlib
import math
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.llm import ann, html_extract, queries, url_filter, warc
from voxlake.llm.html_extract import main_text
from voxlake.llm.url_filter import RULES, filter_urls, segment, word_counts, words_of_page
from voxlake.llm.warc import LoserTree, archive_pages, new_folder, parse_warc, url_key, warc_records, write_warc


def plain_url(u):
    if u is None or "://" not in u:
        host = path = ""
    else:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, None))
    return host, path, rule, verdict


def judged_urls(spark, urls, counts):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r.page_id]: r for r in filter_urls(pages, spark.createDataFrame(counts, "word string, n long")).collect()}


def test_url_filter(spark, small):
    odd = [None, "", "nothing", "://", "HTTP://A.NET", "x://Foo.ORG/fr/a?b#c", "a://b?c/d", "a://b#c://d/e", "http://net/", "http://xnet/", "http://EXAMPLE.net/en/\n://x", "http://example.net/EN/", "http://h.org/" + "verylong" * 30_000]
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    more = [(10**6 + k, u) for k, u in enumerate(odd)] + [(None, odd[5]), (10**6, None), (10**6 + 5, odd[5])]
    pages = pages.unionByName(spark.createDataFrame(more, "page_id long, url string"))
    urls = collections.Counter((r.page_id, *plain_url(r.url)[:3]) for r in pages.collect())
    rows = filter_urls(pages.withColumn("host", F.lit("clash")), spark.createDataFrame([("the", 5)], "word string, n long")).collect()
    assert collections.Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == urls
    rule_says = {h + p: v for v, h, p in RULES}
    for r in rows:
        assert r.verdict == (rule_says[r.rule] if r.rule else "block" if r.block_odds > 0 else "allow")
    assert filter_urls(pages.limit(0)).count() == 0


def test_url_query(spark, small):
    rows = queries.op1_url_filter(spark, small).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert {r.page_id: (r.host, r.path, r.rule) for r in rows} == {i: plain_url(u)[:3] for i, u in urls.items()}


WORDS_OF_ABC = ["a", "ab", "abc", "b", "ca", "bca", "cc"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.dictionaries(st.sampled_from(WORDS_OF_ABC), st.integers(1, 50), max_size=7))
def test_viterbi_against_all_splits(run, counts):
    """Of all ways to cut a run, none is more probable than the one that is found."""
    words = {w: math.log(n / 100) for w, n in counts.items()}
    unknown = math.log(1 / 100) - 2

    def cost(pieces):
        return sum(words.get(p, unknown * len(p)) for p in pieces)

    splits = []
    for mask in range(2 ** max(len(run) - 1, 0)):
        cuts = [0, *(k + 1 for k in range(len(run) - 1) if mask >> k & 1), len(run)]
        splits.append([run[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b])
    found = segment(run, words, unknown)
    assert "".join(found) == run and cost(found) == pytest.approx(max(map(cost, splits)))


def test_hosts_are_split_at_words(spark):
    urls = ["http://newsports.org/", "http://newssports.org/", "http://therapist.org", "http://zzqqnewszz.org", "http://12-34.org", "http://straßenbahn.org/ÉCOLE", "http://freebetscasino.org/"]
    got = judged_urls(spark, urls, [("the", 1000), ("rapist", 3), ("therapist", 60), ("news", 100), ("new", 100), ("sports", 80), ("port", 70), ("straßen", 9), ("bahn", 9), ("école", 2)])
    assert [got[u].segments for u in urls] == [["new", "sports"], ["news", "sports"], ["therapist"], ["zzqq", "news", "zz"], [], ["straßen", "bahn", "école"], ["free", "bets", "casino"]]


def test_single_bad_words_block(spark):
    """Hosts that are no seed names: one bad word is enough, a word of either class is not."""
    bad = ("porn.example.org", "casinocity.example.com", "viagra-shop.example.com", "spam.example.com", "ads.example.com", "mypoker.example.org", "best-warez.example.com", "xxx.example.com", "phishing.example.org", "bestcasinos.example.org")
    fine = ("example.org", "organicfarm.example.com", "free-library.example.org", "cheapflights.example.com", "onlinecourse.example.org", "video-games.example.com", "citypharmacy.example.org", "track-record.example.com", "the-world.example.org")
    got = judged_urls(spark, [f"http://{h}/en/1" for h in (*bad, *fine)], [("the", 1000), ("shop", 30), ("my", 50), ("best", 40), ("world", 60)])
    assert {h for h in (*bad, *fine) if got[f"http://{h}/en/1"].block_odds > 0} == set(bad)
    names = {" ".join(n.split()) for n in url_filter.BLOCK_SEEDS.split(";")}
    assert not names & {"casino win", "free bets", "cheap pills", "ads track", "spam farm", "adult x"}


def test_bayes_learns_from_what_the_rules_judge(spark):
    """A word of many blocked URLs and no allowed one counts against others; rare ones say nothing."""
    urls = [f"http://zorblax{k}.some.net/" for k in range(400)] + [f"http://quiet{k}.some.org/fr/" for k in range(400)] + ["http://seldom.some.net/"]
    got = judged_urls(spark, [*urls, "http://zorblax.example.com/", "http://seldom.example.com/", "http://quiet.example.com/", "http://some.example.com/"], [("zorblax", 5), ("quiet", 5), ("seldom", 5), ("some", 5)])
    odds = {w: got[f"http://{w}.example.com/"].block_odds for w in ("zorblax", "seldom", "quiet", "some")}
    assert got["http://zorblax.example.com/"].verdict == "block"
    assert odds["zorblax"] > 0 > odds["some"] == odds["seldom"] == pytest.approx(math.log(0.3 / 0.7)) and odds["seldom"] > odds["quiet"]


def test_dictionary_has_no_bound(spark):
    """A rare word splits a host however many commoner words there are."""
    counts = [(f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}{'abcdefghij'[k // 1000 % 10]}{'abcdefghij'[k // 10000 % 10]}{'ab'[k // 100000]}", 1000) for k in range(120_000)]
    got = judged_urls(spark, ["http://zyxnews.org/"], [*counts, ("zyx", 1), ("news", 1)])
    assert got["http://zyxnews.org/"].segments == ["zyx", "news"]


def test_word_counts_are_of_all_pages(spark):
    pages = spark.createDataFrame([("<p>Alpha beta caf&eacute;</p>",), ("beta <b>gamma</b> beta<script>var gamma = '<p>delta'</script>",), (None,), ("",), (f"<style>x{{color:red}}</style>{'y' * 30}<!-- epsilon -->",)], "html string")
    assert {r.word: r.n for r in word_counts(pages).collect()} == {"alpha": 1, "beta": 3, "gamma": 1, "café": 1}


ODD_PAGES = [(1, "http://a.b/c", "é" * 60), (2, None, "é" * 60), (3, "x\r\ny", None), (None, "http://a.b/c", "é" * 60), (5, "http://A.b", "s"), (5, "http://A.b", "s"), (7, "", "q\r\n\r\nWARC/1.1\r\n\r\n" * 30), (8, "http://a.b/c", "\r\n\r\n" * 40)]


def test_warc_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    copies = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100000)
    odd = spark.createDataFrame([(None if i is None else i + 10**7, u, h) for i, u, h in ODD_PAGES], "page_id long, url string, html string")
    every = pages.unionByName(copies).unionByName(odd).withColumn("record", F.lit("clash"))
    given_rows = every.collect()
    first = {}
    for p in given_rows:
        b = (p.html or "").encode()
        if len(b) >= 100 and p.page_id is not None:
            first[b] = min(first.get(b, p.page_id), p.page_id)
    want = []
    for p in given_rows:
        b = (p.html or "").encode()
        to = first.get(b) if first.get(b) != p.page_id else None
        want.append((p.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    rows = archive_pages(every).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == collections.Counter(want)
    order = sorted(rows, key=lambda r: (r.range, r.place))
    keys = [(r.url_key, r.ts, r.page_id or 0) for r in order]
    assert keys == sorted(keys)
    for _, places in {k: [r.place for r in order if r.range == k] for k in {r.range for r in order}}.items():
        assert places == list(range(len(places)))
    assert archive_pages(every.limit(0)).count() == 0


def test_archives_are_warc_files(spark, tmp_path):
    pages = spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w")
    found = []
    for f in sorted((tmp_path / "w").glob("*/part-*")):
        data = gzip.decompress(f.read_bytes())
        for offset, length, headers, block in parse_warc(data):
            assert data[offset : offset + 10] == b"WARC/1.1\r\n" and data[offset + length : offset + length + 4] == b"\r\n\r\n"
            assert int(headers["content-length"]) == len(block)
            found.append(headers["warc-type"])
    assert len(found) == len(ODD_PAGES) == warc_records(pages).count()
    assert new_folder(spark, "x") != new_folder(spark, "x")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("12"), st.one_of(st.none(), st.integers(0, 5))), max_size=8), max_size=7))
def test_loser_tree_merges(runs):
    from voxlake.llm.warc import _order

    full = [sorted(((k, t, p, None, 0, "", "", None, f"f{i}", n, 0) for n, (k, t, p) in enumerate(r)), key=_order) for i, r in enumerate(runs)]
    merged = list(LoserTree(full))
    assert [_order(r) for r in merged] == sorted(_order(r) for run in full for r in run)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    """Long payloads come in archives of their own; all are read back whole."""
    rows = [(k, f"http://a.b/{k}", "x" * n + str(k)) for k, n in enumerate([10] * 40 + [200_000] * 20 + [5_000_000] * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w")
    sizes = collections.defaultdict(list)
    for f in (tmp_path / "w").glob("*/part-*"):
        sizes[f.parent.name].append(sum(1 for _ in parse_warc(gzip.decompress(f.read_bytes()))))
    assert {k: sum(v) for k, v in sizes.items()} == {"size-0": 40, "size-1": 20, "size-2": 2}
    assert max(sizes["size-1"]) <= 16 and max(sizes["size-2"]) == 1
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in archive_pages(pages).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}


def test_ranges_grow_with_the_captures(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "SEGMENT_ROWS", 7)
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 97, F.lit(".org/"), F.col("id") % 13).alias("url"), F.lit("p").alias("html"))
    rows = archive_pages(pages).collect()
    by_range = collections.Counter(r.range for r in rows)
    assert len(rows) == 2000 and 20 <= len(by_range) <= 80 and max(by_range.values()) < 400
    keys = [(r.url_key, r.ts, r.page_id) for r in sorted(rows, key=lambda r: (r.range, r.place))]
    assert keys == sorted(keys)


def test_a_word_of_any_length_splits_a_run(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    pages = spark.createDataFrame([(1, f"http://{long}garden.example/", f"<p>{long} {long} garden</p>"), (2, "http://" + "ab" * 3000 + ".example/", "x" * 5000)], "page_id long, url string, html string")
    counts = word_counts(pages, longest=None)
    assert {r.word: r.n for r in counts.collect()} == {long: 2, "garden": 1, "x" * 5000: 1}
    found = {r.page_id: r.segments for r in filter_urls(pages, counts).collect()}
    assert found[1] == [long, "garden"]
    assert "".join(found[2]) == "ab" * 3000


def test_words_of_broken_markup_take_linear_time():
    started = time.perf_counter()
    assert words_of_page("a<b>c" + "<" * 400_000 + "d") == ["a", "c", "d"]
    assert time.perf_counter() - started < 5


def test_url_keys():
    assert url_key("http://www.Example.org/A?b=C#d") == "org,example,www)/a?b=c"
    assert url_key("http://a.b") == "b,a)/" and url_key(None) == "" and url_key("http://a.b?x") == "b,a)?x"


def test_html_extraction_of_all_pages(small, spark):
    import html

    rows = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r for r in queries.op8_text_to_tag(spark, small).collect()}
    for p in rows:
        inner = p.html[p.html.index("<article>") + 9 :].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


PAGE = """<!doctype html><html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav><div class="cookie-notice">We use cookies, as a long and tiresome notice tells you here.</div>
<div id=page><div class=story><h1>Head &amp; line</h1><p>The first paragraph is long enough to be seen as content, with <a href=x>a link</a>.<p>Second   one
goes on for a while &#233; and is also long enough.<br>After a break.<form><input><button>Send</button></form><ul><li>one<li>two</ul><p>Ok.</div>
<aside>Side</aside><div class="advert">Buy this now and forever, it is very good and cheap for you.</div>
<section id="comments"><p>I am a reader's comment that is as long as a paragraph of the page, or longer.</section></div><footer>f</footer>"""


def test_html_extraction_of_odd_pages():
    want = "Head & line\nThe first paragraph is long enough to be seen as content, with a link.\nSecond one goes on for a while é and is also long enough. After a break.\none\ntwo\nOk."
    assert main_text(PAGE) == want
    assert main_text(None) == main_text("") == main_text("<div><nav>x</nav></div>") == main_text("<script>x") == ""
    assert main_text("<p>only</p>") == "only" and main_text("plain  text") == "plain text" and main_text("a<b") != ""
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"
    long = "<article>" + "<p>word word word word</p>" * 20000 + "</article>"
    assert main_text(long).count("\n") == 19999


def test_text_around_skipped_inline_elements():
    for inner in ("<script>x</script>", "<style>x</style>", "<button>Share</button>", "<svg><text>x</text></svg>", "<span class=share>x</span>", "<select><option>x</select>", "<iframe>x</iframe>", "<label>x</label>"):
        assert main_text(f"<article><p>Hello {inner}world</p><p>More text.</p></article>") == "Hello world\nMore text.", inner
        assert main_text(f"<article><p>Long text {inner}</p></article>") == "Long text"
    assert main_text("<article><div>Hello <span class=share><div>x</div></span>world</div><p>a <span class=share>x</p><p>b</p></article>") == "Hello world\na\nb"
    assert main_text("<p>before<nav>menu</nav>after</p>") == "before\nafter"
    assert main_text("text<script>x") == "text"


def test_class_words_do_not_drop_the_article():
    body = "<h1>Head</h1><p>The first paragraph is long enough to be seen as content of the page.</p><p>The second one goes on for a while, too.</p>"
    want = "Head\nThe first paragraph is long enough to be seen as content of the page.\nThe second one goes on for a while, too."
    for start, end in (("<div class='content has-sidebar'>", "</div>"), ("<div id=page-with-comments>", "</div>"), ("<article class='post comments-open'>", "</article>"), ("<div class=side-by-side>", "</div>"), ("<div class=search-page><main>", "</main></div>"), ("<div class='widget social'><article>", "</article></div>")):
        comments = "<div class=comments><p>A comment that is as long as a paragraph of the page, or even longer than that.</p></div>"
        assert main_text(f"<body><nav>menu</nav>{start}{body}{end}{comments}<footer>f</footer>") == want, start
        assert main_text(f"<body>{start}{body}{comments}{end}") == want, start
    assert main_text("<body><div class=widget>" + body.replace("h1", "p") + "</div><p>x</p>").endswith(want)
    assert main_text(f"<!doctype html><title>T</title>{body}") == main_text(f"<html><head><title>T</title><meta charset=utf-8>{body}") == want


LINKS = "".join(f"<li><a href=/{k}>Some other story, number {k}, of this site</a></li>" for k in range(12))
WORDS = "The paragraph number {k} of this story is long enough to be seen as content, and it has no link in it."
NO_ARTICLE = f"<body><div id=page><h1>Head line</h1><p>{WORDS.format(k=1)}</p><p>{WORDS.format(k=2)}</p><ul>{LINKS}</ul><p>{WORDS.format(k=3)}</p><p>So.</p><p>{WORDS.format(k=4)}</p></div><p>x</p></body>"


def test_the_ratio_selects_the_lines(monkeypatch):
    """No article element: the ratio finds the box and drops a list of links in it."""
    want = "\n".join(["Head line", *(WORDS.format(k=k) for k in (1, 2, 3)), "So.", WORDS.format(k=4)])
    assert main_text(NO_ARTICLE) == want
    assert main_text(NO_ARTICLE.replace("<div id=page>", "<article>").replace("</div>", "</article>")) == want
    monkeypatch.setattr(html_extract, "smooth", lambda ratio: np.ones(len(ratio)))
    assert "Some other story, number 3" in main_text(NO_ARTICLE)
    monkeypatch.setattr(html_extract, "smooth", lambda ratio: np.zeros(len(ratio)))
    assert main_text(NO_ARTICLE) == main_text(PAGE) == ""


def test_short_lines_between_content_stay():
    items = "".join(f"<li>item {k}" for k in range(40))
    text = main_text(f"<nav>{LINKS}</nav><div><p>{WORDS.format(k=1)}</p><ul>{items}</ul><p>{WORDS.format(k=2)}</p></div>")
    assert text.split("\n") == [WORDS.format(k=1), *(f"item {k}" for k in range(40)), WORDS.format(k=2)]
    assert main_text(f"<div><p>{WORDS.format(k=1)}</p><p>See <a href=x>this</a>.</p><p>{WORDS.format(k=2)}</p></div>").split("\n")[1] == "See this."


def test_hostile_markup_takes_linear_time():
    for start in ("<div>", "<b>", "<p><b>", "<div class=widget>", "<ul><li>", "<td>", "<article>", "</p>", "<a>x"):
        began = time.perf_counter()
        main_text(start * 100_000 + "deep")
        assert time.perf_counter() - began < 20, start


def test_nothing_but_boilerplate_is_lost():
    first = "<p>A paragraph of the story that is long enough.</p>"
    lost = "A paragraph of the story that is long enough."
    assert main_text(f"<article>{first}<p><a href=x>Read the full report of the group</a></p></article>") == f"{lost}\nRead the full report of the group"
    sources = "<h2>Sources</h2><ul><li><a href=x>One source</a></li><li><a href=y>Another source</a></li></ul>"
    assert main_text(f"<article>{first}{sources}</article>") == f"{lost}\nSources\nOne source\nAnother source"
    assert main_text("<article><p><a href=x>only a link</a></p></article>") == "only a link"
    named = "<p class='related-work'>Related work.</p><p id=search-results>Results of the search.</p><p class=social>Social life.</p><h2 class=sponsored>On sponsors</h2>"
    assert main_text(f"<article>{first}{named}</article>") == f"{lost}\nRelated work.\nResults of the search.\nSocial life.\nOn sponsors"
    replies = "".join(f"<p>Reply {k}.</p>" for k in range(30))
    assert main_text(f"<div>{first}{replies}</div>").count("Reply") == main_text(f"<div>{replies}{first}</div>").count("Reply") == 30
    for name in ("ad", "ad-slot", "site-footer", "comment-list", "cookie-banner", "sidebar-left", "shareButtons"):
        assert main_text(f"<article>{first}<div class={name}>Not of the story</div></article>") == lost, name
    for name in ("related-work", "search-results", "advertising-history"):
        assert main_text(f"<article>{first}<div class={name}>Of the story</div></article>") == f"{lost}\nOf the story", name


BROKEN = ["<!", "<![", "[", "<b>", "</", ">", '"', "'", "=", "a", "-", "--", "<!--", "-->", "<?", "&", "&#", ";", " ", "<p", 'x="', "<!doctype", "CDATA[", "]]", "<script>", "</script", "<", "\x00"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BROKEN), max_size=12))
def test_broken_markup_does_not_crash(parts):
    assert main_text("<p>A story</p>" + "".join(parts)).startswith("A story")


def test_text_behind_broken_markup_is_read():
    for broken in ("<![", "<!-", "<!x", "<!doctype", "<?php", "<a href='x", '<a href="x', "<![CDATA["):
        assert "The end." in main_text(f"<p>A story</p>{broken}<p>Its middle.</p><p>The end.</p>"), broken
    assert main_text("<p>A story</p><p>The end.</p><div clas") == "A story\nThe end."
    assert main_text("<p>A story</p><!-- left open <p>The end.</p>") == "A story\nThe end."


@pytest.mark.parametrize("unit", ["<a ", "<!--", "<!", "<![", "</", "<?", "<a", "<a x=\"", "<a x='", '<a x=">" ', "<a x='>\"' ", "<a x='\"> ", "&", "&#", "<a/", "<a =", "<script>", "<script></", "<!-- -", "< "])
def test_unclosed_markup_takes_linear_time(unit):
    for end in ("", ">", '"', "-->"):
        began = time.perf_counter()
        assert main_text("<p>A story</p>" + unit * 60_000 + end).startswith("A story")
        assert time.perf_counter() - began < 8, end


def test_extraction_of_tables(spark):
    rows = [(1, "u", NO_ARTICLE, "clash"), (1, "u", NO_ARTICLE, "clash"), (None, None, None, None), (2, "v", "", "clash"), (3, "w", "<p>" + "long words " * 100_000, "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_text(pages).collect()
    assert collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == collections.Counter((i, u, main_text(h), len(main_text(h))) for i, u, h, _ in rows)
    assert html_extract.extract_text(pages.limit(0)).columns == ["page_id", "url", "html", "text", "n_chars"]
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def exact(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    size = collections.Counter(len(v) for _, v in fine).most_common(1)[0][0]
    return {i: sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in fine if j != i and len(w) == size))[:k] for i, v in fine if i % 20 == 0 and len(v) == size}


def test_neighbours_edges(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENOUGH", 1000)  # probe every list: the result is exact
    rng = np.random.default_rng(0)
    rows = [(k, [float(c) for c in rng.standard_normal(8)]) for k in range(300)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1020, None), (1040, [0.0] * 8), (1060, [1.0, None] * 4), (1080, [float("nan")] * 8), (1100, [1.0]), (None, rows[1][1]), (1120, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    want = exact(rows, 20)
    got = collections.defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert [(-s, j) for _, j, s in sorted(found)] == [(pytest.approx(a), j) for a, j in want[q]]
    few = ann.nearest_neighbours(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("d", "n_lists"), [("/root/testdata/sf0.01", 22), ("/root/testdata/sf0.1", 45)])
def test_recall_at_two_sizes(spark, monkeypatch, d, n_lists):
    """About sqrt(n) lists at every size, cut by salts; nine in ten true neighbours are found."""
    monkeypatch.setattr(ann, "MOST_ROWS", 20)
    made = []
    original = ann.fit_index
    monkeypatch.setattr(ann, "fit_index", lambda *a: made.append(original(*a)) or made[-1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = exact(rows, 20)
    got = collections.defaultdict(set)
    for r in queries.op4_adaptive_scan(spark, d).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {j for _, j in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    assert all(len(v) == 20 for v in got.values())
    assert n_lists / 2 < len(made[0].centroids) < 2 * n_lists


def test_samples_are_bounded_by_the_hash(spark, monkeypatch):
    """The sample that reaches the driver doesn't grow with rows, tasks or repeated ids."""
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rng = np.random.default_rng(1)
    for n in (400, 1600):
        rows = [(k, [float(c) for c in rng.standard_normal(6)]) for k in range(n)] * 2
        df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(16)
        index = ann.fit_index(df, 2 * n, 5.0, 5)
        assert 5 < len(index.sample) < 100
        assert 0.3 * math.sqrt(2 * n) <= len(index.centroids) <= 2 * math.sqrt(2 * n)


def test_lists_with_few_rows_do_not_cut_rankings(spark):
    """Tiny clusters far apart and isolated vectors: every query still gets ``k`` neighbours."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((60, 16)) * 10
    centre = np.concatenate((np.repeat(centre[:50], 6, 0), centre[50:], np.repeat(rng.standard_normal((1, 16)) * 10, 300, 0)))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(centre + rng.standard_normal(centre.shape) * 0.01)]
    rows += [(40, rows[40][1])] * 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter(r.query_id for r in ann.nearest_neighbours(df, F.col("vec_id") < 310).collect())
    assert got == {q: 20 for q in range(310)}
