"""Personal data, conversation repair and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.llm import conversations as C
from voxlake.llm import pii, queries
from voxlake.llm import vector_codes as V

# ---- personal data ---------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def fits(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    out = [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if fits(kind, m.group())]
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290.@+-() %é\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_texts():
    text = "Ä +1 (509) 555-6973 a.b@c.d.e@f.g 4111 1111 1111 1111, 4111 1111 1111 1112 then 1.2.3.4.5 1.2.3.999 x@y"
    assert pii.base_spans(text) == plain_spans(text)
    assert [text[a:b] for _, a, b in pii.base_spans(text)] == ["+1 (509) 555-6973", "a.b@c.d.e", "4111 1111 1111 1111", "1.2.3.4"]


@pytest.mark.parametrize("unit", ["1", "1 ", "1.", "a.", "@", "a@", "+1", "+1(", "w", "1-", "(at)", "dot "])
def test_long_texts_take_linear_time(unit, field):
    began = time.perf_counter()
    text = unit * 40_000
    pii.with_base(pii.base_spans(text), pii.decode(field, [text])[0])
    assert time.perf_counter() - began < 8


@pytest.fixture(scope="module")
def field():
    return pii.fit_field(pii.labelled_rows())


def test_viterbi_finds_the_best_of_all_paths():
    rng = np.random.default_rng(0)
    lengths = [3, 1, 0, 4, 2]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    scores, pairs = rng.normal(size=(sum(lengths), pii.N_LABEL)), rng.normal(size=(pii.N_LABEL, pii.N_LABEL))
    got = pii.viterbi(scores, pairs, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        def worth(path, a=a):
            if path and not pii._FIRST[path[0]] or any(not pii._ALLOWED[p, q] for p, q in itertools.pairwise(path)):
                return -np.inf
            return sum(scores[a + k, s] for k, s in enumerate(path)) + sum(pairs[p, q] for p, q in itertools.pairwise(path))

        best = max(itertools.product(range(pii.N_LABEL), repeat=b - a), key=worth)
        assert tuple(got[a:b]) == best


def test_likelihood_equals_the_sum_over_all_paths_and_its_gradient():
    rng = np.random.default_rng(1)
    offsets = np.array([0, 3, 3, 5])
    labels = np.array([0, 1, 2, 3, 0])
    scores, pairs = rng.normal(size=(5, pii.N_LABEL)), rng.normal(size=(pii.N_LABEL, pii.N_LABEL))

    def plain(scores, pairs):
        total = 0.0
        for a, b in ((0, 3), (3, 5)):
            every = []
            for path in itertools.product(range(pii.N_LABEL), repeat=b - a):
                if pii._FIRST[path[0]] and all(pii._ALLOWED[p, q] for p, q in itertools.pairwise(path)):
                    worth = sum(scores[a + k, s] for k, s in enumerate(path)) + sum(pairs[p, q] for p, q in itertools.pairwise(path))
                    every.append(worth)
                    if path == tuple(labels[a:b]):
                        own = worth
            total += own - np.log(np.exp(every).sum())
        return total

    value, by_score, by_pair = pii.likelihood(scores, pairs, offsets, labels)
    assert value == pytest.approx(plain(scores, pairs))
    for at in ((0, 1), (4, 5), (2, 0)):
        moved = scores.copy()
        moved[at] += 1e-5
        assert by_score[at] == pytest.approx((plain(moved, pairs) - plain(scores, pairs)) / 1e-5, abs=1e-3)
    for at in ((0, 1), (1, 2), (3, 0)):
        moved = pairs.copy()
        moved[at] += 1e-5
        assert by_pair[at] == pytest.approx((plain(scores, moved) - plain(scores, pairs)) / 1e-5, abs=1e-3)


def test_field_on_held_out_rows():
    """Trained on some of the sentences' drawings, tested on others."""
    rows = pii.labelled_rows(copies=8, seed=5)
    field = pii.fit_field([r for k, r in enumerate(rows) if k % 8 < 5])
    held = [r for k, r in enumerate(rows) if k % 8 >= 5]
    found = pii.decode(field, [t for t, _ in held])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, held, strict=True))
    assert right / sum(len(a) for a in found) > 0.97
    assert right / sum(len(b) for _, b in held) > 0.95


HIDDEN = [  # forms and words that no labelled sentence has
    ("bitte an marta dot weber at posthaus dot org schreiben", ["marta dot weber at posthaus dot org"]),
    ("Rechnung: 5500-0000-1234-0005 danke", ["5500-0000-1234-0005"]),
    ("her number was (415) 555 0199 I think", ["(415) 555 0199"]),
    ("the box at 10[.]20[.]30[.]40 is down", ["10[.]20[.]30[.]40"]),
    ("de la 9807915762804490 que", ["9807915762804490"]),
]
CLEAN = ["In 2019 the 12 teams met at 10:30 on 2019-05-07.", "pi is 3.14159265 and e is 2.71828", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8c1"', "no numbers here, at a point where dots are", "It cost $1,299.00 for 3 units (1200 x 800 px)", "1. one\n2. two\n3. three", "a list: 1 2 3 4 5 6 7 8 9 10 11 12", "see @someone and the dot product of vectors"]


def test_field_adds_what_patterns_miss(field):
    for (text, want), found in zip(HIDDEN, pii.decode(field, [t for t, _ in HIDDEN]), strict=True):
        assert [text[a:b] for _, a, b in found] == want
        assert not plain_spans(text) or text.startswith("Rechnung")
    assert pii.decode(field, CLEAN) == [[] for _ in CLEAN]


def test_base_spans_stay():
    base = [("card", 5, 20), ("phone", 18, 30)]
    assert pii.with_base(base, [("email", 0, 5), ("ip", 19, 21), ("phone", 30, 40)]) == [("email", 0, 5), *base, ("phone", 30, 40)]
    assert pii.redact("aaaaabbbbbccc", [("email", 0, 5), ("card", 3, 7), ("ip", 10, 12)]) == "[email]bbb[ip]c"


def test_private_query_equals_plain_version(spark, small, texts, field):
    rows = queries.op11_private_spans(spark, small).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        base = plain_spans(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r.spans == pii.written(pii.with_base(base, pii.decode(field, [text])[0]))


def test_private_odd_rows(spark, edge, edge_rows):
    model = pii.fit_from_table(pii.labelled_table(spark).limit(40))
    out = pii.find_private(edge, model).collect()
    assert len(out) == len(edge_rows) and set(out[0].asDict()) == {"doc_id", "n_words", "kept", "n_email", "n_ip", "n_card", "n_phone", "base", "found", "redacted"}
    clash = spark.createDataFrame([(1, "x@y.zz", "s"), (1, "x@y.zz", "s"), (None, None, None)], "doc_id long, text string, spans string")
    assert sorted((r.n_email, r.spans) for r in pii.find_private(clash, model, digests=True).collect()) == [(0, ""), (1, "email:0:6"), (1, "email:0:6")]
    assert pii.find_private(clash.limit(0), model).count() == 0
    nothing = pii.fit_from_table(spark.createDataFrame([], pii.labelled_table(spark).schema))
    assert pii.decode(nothing, ["call (415) 555 0199"]) == [[]]
    assert [r.redacted for r in pii.find_private(clash.limit(1), model).collect()] == ["[email]"]


# ---- conversations ---------------------------------------------------------------------


def all_edits(rows):
    """The least (cost, audit, turns) of all edits, by every string of every state."""
    best = {C.START: {(0, "", ())}}

    def inserted(states):
        out = {k: set(v) for k, v in states.items()}
        for _ in range(3):
            for s, found in list(out.items()):
                to = C.NEXT[s]
                out.setdefault(to, set()).update((c + 5, a + "I", t + ((C.NAME[to], ""),)) for c, a, t in found if a[-3:] != "III")
        return {k: set(sorted(v)[:40]) for k, v in out.items()}

    for role, text, must_go, truncated in rows:
        now = {}
        for s, found in inserted(best).items():
            for c, a, t in found:
                now.setdefault(s, set()).add((c + 2, a + "D", t))
                if not must_go:
                    extra = 5 * truncated
                    if (s, role[:1]) in C.KEPT:
                        now.setdefault(C.KEPT[s, role[:1]], set()).add((c + extra, a + "K", t + ((role, text),)))
                    now.setdefault(C.NEXT[s], set()).add((c + 1 + extra, a + "R", t + ((C.NAME[C.NEXT[s]], text),)))
        best = now
    return min(e for s, found in inserted(best).items() if s in (C.START, C.ASSISTANT) for e in found)


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "other", ""]), st.just("t."), st.sampled_from([False, False, True]), st.sampled_from([False, False, True]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=8))
def test_repair_equals_all_edits(rows):
    edits = []
    repair = C.Repair(lambda e, t: edits.append((e, t)))
    for role, text, must_go, truncated in rows:
        repair.row(role, text, must_go, truncated and not must_go)
    cost = repair.end()
    want = all_edits([(r, t, g, x and not g) for r, t, g, x in rows])
    assert (cost, "".join(e for e, _ in edits), tuple(t for _, t in edits if t)) == want
    assert re.fullmatch("(s?(ua)+)?", "".join(t[0][0] for _, t in edits if t))


def test_survivors_coalesce():
    """A long conversation holds a few nodes, whatever its faults."""
    draw = random.Random(3)
    out = []
    repair = C.Repair(lambda e, t: out.append(e))
    for _ in range(50_000):
        repair.row(draw.choice(["user", "assistant", "system"]), "x.", draw.random() < 0.2, draw.random() < 0.2)
    assert repair.most_held < 500
    repair.end()
    assert len(out) >= 50_000


def plain_summary(rows):
    """Rows after damage, in order, to what the query returns."""
    seen, faults, marks = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marks.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, turns = all_edits(marks)
    return (*faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def check_conversations(got, rows):
    left = plain_damage(rows)
    assert sorted(r.conv_id is None or r.conv_id for r in got) == sorted(c is None or c for c in {r[0] for r in rows})
    for r in got:
        own = sorted((x for x in left if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        turns = {x[1] for x in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (gaps, *plain_summary([x[2:] for x in own]))


def test_conversation_query_equals_plain_version(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_conversations(queries.op12_conversation_repair(spark, small).collect(), rows)


def test_conversation_query_equals_sql(spark, small):
    got = queries.op12_conversation_repair(spark, small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_conversation_repair"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_conversation_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", None), (1, None, "user", "a."), (1, 2, None, "b."), (1, 2, None, "b."), (1, 2, "system", "\x0b\x0c"), (2, 7, "user", "x" * 100_000)]
    rows += [(3, k, "user", "again?") for k in range(5)] + [(4, -(2**40), "assistant", "é…"), (4, 2**40, "user", " ")]
    rows += [(k, 0, "user", "one.") for k in range(10, 60)]  # some lose their only row
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    got = C.repair_summaries(C.damage(df)).collect()
    check_conversations(got, rows)
    assert any(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert C.repair_summaries(C.damage(df.limit(0))).count() == 0


def test_repaired_rows_are_well_formed(spark, small):
    edits = C.repair_conversations(C.damage(spark.read.parquet(f"{small}/conversations.parquet"))).collect()
    summary = {r.conv_id: r for r in queries.op12_conversation_repair(spark, small).collect()}
    by_conv = {}
    for r in sorted(edits, key=lambda r: (r.conv_id, r.place)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, r in summary.items():
        own = by_conv.get(conv, [])
        assert "".join(e.edit for e in own) == r.audit and [e.place for e in own] == list(range(len(own)))
        kept = [e for e in own if e.role is not None]
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[0] for e in kept))
        assert hashlib.sha256("\n".join(f"{e.role}:{e.text}" for e in kept).encode()).hexdigest() == r.repaired_sha256


# ---- vector codes ----------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """{row: (code, error)} and codebooks, by all distances in Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(4096 * float(c))) for c in v] for _, v in rows])
    long = x.shape[1] // parts
    books = [x[:entries, p * long : (p + 1) * long].copy() for p in range(parts)]
    for r in range(rounds + 1):
        code, error = [], np.zeros(len(x), int)
        for p in range(parts):
            own = x[:, p * long : (p + 1) * long]
            d = ((own[:, None] - books[p][None]) ** 2).sum(2)
            w = d.argmin(1)
            code.append(w)
            error += d.min(1)
            if r < rounds:
                books[p] = np.array([own[w == e].sum(0) // (w == e).sum() if (w == e).any() else books[p][e] for e in range(len(books[p]))])
    return ["".join(f"{c:02x}" for c in row) for row in np.array(code).T], error.tolist(), books


@pytest.mark.parametrize("scale", [1.0, 0.001])  # the second has ties in plenty
def test_codes_equal_plain_version(spark, scale):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 16))
    rows = [(int(k), [float(np.float32(c)) for c in scale * (centres[rng.integers(9)] + 0.3 * rng.normal(size=16))], int(k) % 3 if k % 5 else None) for k in rng.permutation(700)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    coded, books = V.compress_vectors(df)
    code, error, want = plain_codes([r[:2] for r in rows])
    got = sorted((r.vec_id, r.code, r.error) for r in coded.collect())
    assert got == sorted(zip(sorted(r[0] for r in rows), code, error, strict=True))
    assert all((a == b).all() for a, b in zip(books.books, want, strict=True))
    sums = {}
    for r in coded.collect():
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in coded.collect())
    full = len(rows) * 8 * 16
    assert books.distances[0] == full
    if scale == 1.0:
        assert sum(books.distances[1:]) < 0.5 * full * (len(books.distances) - 1)


def test_bounds_hold_and_lists_adapt():
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (500, 4))
    book = rng.integers(-50, 50, (16, 4))
    now = V.assign_all(x, book, 4)
    for step in range(12):
        new = book + rng.integers(-6, 7, book.shape)
        drift = V._up(np.sqrt(V.squared(new, book).astype(float)))
        b = (4, 2, 6, 1, 15)[step % 5]
        now, need, _ = V.reassign(x, now.resized(b), new, drift)
        book = new
        d = V.squared(x[:, None], book[None])
        assert (now.entry == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        assert (now.upper >= root[np.arange(500), now.entry]).all() and (np.diff(now.low, axis=1) >= 0).all()
        for k in range(b):  # a list's k-th bound holds for its entry, and the outer one for all others
            assert (now.low[:, k] <= root[np.arange(500), now.near[:, k]]).all() or (now.near[:, k] == now.entry).any()
        others = np.ones((500, 16), bool)
        others[np.arange(500), now.entry] = False
        np.put_along_axis(others, now.near, False, 1)
        assert (np.where(others, root, np.inf).min(1) >= now.low[:, -1]).all()
        assert need.max() <= b + 1
    assert V.next_b(np.array([98, 1, 0, 0, 0, 1]), 4, 15) == 1
    assert V.next_b(np.array([50, 0, 30, 19, 0, 1]), 4, 15) == 3
    assert V.next_b(np.array([10, 0, 0, 0, 0, 90]), 4, 15) == 5
    assert V.next_b(np.array([10, 90]), 0, 0) == 0


def test_codes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 8, 1), (2, None, 1), (3, [nan] + [0.0] * 7, None), (4, [inf] + [0.0] * 7, 2), (5, [None] + [0.0] * 7, 2), (None, [0.25] * 8, None), (6, [0.1] * 7, 1), (7, [], None), (1, [0.5] * 8, 1), (8, [1e30] * 8, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    coded, books = V.compress_vectors(df)
    got = {(r.vec_id, r.label): r for r in coded.collect()}
    assert set(got) == {(1, 1), (None, None), (8, None)} and coded.count() == 4
    assert [len(b) for b in books.books] == [4] * 8 and got[1, 1].error == 0 and got[1, 1].code == "00" * 8
    none, empty = V.compress_vectors(df.limit(0))
    assert none.count() == 0 and none.columns == coded.columns and empty.sha256() == hashlib.sha256(b"," * 0).hexdigest()
    only = V.compress_vectors(df.where("vec_id = 7"))[0].collect()
    assert [(r.vec_id, r.error) for r in only] == [(7, 0)]


def test_codes_query_equals_sql(spark, small):
    rows = sorted(tuple(r) for r in queries.op13_vector_codes(spark, small).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert rows == sorted(con.execute(queries.ORACLE_SQL["op13_vector_codes"]).fetchall())
