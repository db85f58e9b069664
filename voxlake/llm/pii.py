"""Personal data in texts: fixed patterns, and a conditional random field over word shapes.

The patterns (email, ip, card, phone) give the base spans.  A linear-chain conditional random
field adds what they miss: addresses written out or taken apart, phone numbers in national forms,
card-like numbers that fail the check digit, defanged network addresses.  It is trained here on a
small labelled table by maximum likelihood.  Its features are the shapes of words and numbers, a
few cue words and white space; it runs over the stretches around digits, ``@`` and spelled-out
dots, all of a batch at once, and Viterbi decodes them in numpy.  A decoded span has to be
plausible for its kind (numbers of digits, parts of an address).

No shuffle: texts are read once, whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]  # kind, start and end in code points

# ---- fixed patterns ----------------------------------------------------------------
# Possessive forms and look-behinds find the same leftmost matches in linear time.

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            yield "email", first, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then by kind in the order of ``KINDS``."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() < 60 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- tokens and features ---------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
DOT_WORDS = ("dot", "punkt", "punto", "point")
# Words whose presence tells of a kind of number or address, as groups.
CUES = [
    ("at", "arobase", "arroba"),
    DOT_WORDS,
    ("phone", "tel", "telephone", "telefon", "téléphone", "teléfono", "mobile", "mobil", "cell", "fax", "call", "ring", "portable", "móvil", "handy", "whatsapp", "dial", "rufnummer", "appelez", "llame"),
    ("card", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta", "cc", "credit", "debit"),
    ("ip", "host", "address", "server", "adresse", "dirección", "ping", "router", "subnet", "serveur", "servidor"),
    ("email", "mail", "courriel", "correo", "contact", "write", "kontakt", "reach", "schreiben", "contacto"),
    ("com", "org", "net", "edu", "gov"),
    ("isbn", "issn", "doi", "page", "pages", "seite", "página", "chapter", "section", "figure", "table", "vol"),
    ("version", "v", "release", "build", "rev", "token", "key", "hash", "commit", "id", "uuid", "sha", "order", "invoice", "serial", "tracking", "sku", "ref"),
    ("usd", "eur", "gbp", "price", "total", "percent", "kg", "km", "cm", "mb", "gb", "units", "people", "years", "euros", "dollars", "euro", "million", "hours", "minutes"),
    ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december"),
]
_CUE = {w: k + 1 for k, group in enumerate(CUES) for w in group}
_PUNCT = {c: k for k, c in enumerate("@.-_+()/:,;#=|'\"[]{}*%$€£!?<>&~")}
_DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 15, 16, 17, 20])  # lengths where a class begins
N_DIGIT, N_LETTER = len(_DIGIT_STEPS) + 1, 20
N_SHAPE = 2 + N_DIGIT + N_LETTER + len(_PUNCT) + 1  # 0: outside the sequence
N_CUE, N_GAP = len(CUES) + 1, 3
AROUND = 64  # code points on each side of a trigger that belong to its sequence
_TRIGGER = re.compile("[0-9@]")
_FORMS = [f for w in DOT_WORDS for f in (w, w.capitalize(), w.upper())] + [a + f + b for a, b in ("[]", "()", "{}") for f in ("at", "AT")]
_DOT_TRIGGER = re.compile(r"(?i)(?<![^\W_])(?:dot|punkt|punto|point)(?![^\W_])|[\[({]at[\])}]")


def shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        if n <= 3:
            return 1 + (0 if n == 1 else 1 if n == 2 else 2 if int(token) <= 255 else 3)
        return 2 + int(np.searchsorted(_DIGIT_STEPS, n, side="right"))
    if c.isalpha():
        case = 0 if token.islower() else 1 if token.isupper() else 2 if token[0].isupper() and token[1:].islower() else 3
        n = len(token)
        return 2 + N_DIGIT + case * 5 + (n - 1 if n < 4 else 3 if n < 8 else 4)
    return 2 + N_DIGIT + N_LETTER + _PUNCT.get(c, len(_PUNCT))


def stretches(text: str) -> list[tuple[int, int]]:
    """The sequences of a text: what lies within ``AROUND`` of a digit, ``@``, spelled-out dot or
    bracketed at; those that meet are one."""
    at = [m.start() for m in _TRIGGER.finditer(text)]
    if any(f in text for f in _FORMS):
        at = sorted(at + [m.start() for m in _DOT_TRIGGER.finditer(text)])
    out: list[tuple[int, int]] = []
    for k in at:
        a, b = max(0, k - AROUND), min(len(text), k + AROUND + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@dataclass
class Sequences:
    """Tokens of sequences in a row: attributes, places, and where each sequence begins."""

    shape: np.ndarray
    cue: np.ndarray
    gap: np.ndarray  # before the token: 0 nothing, 1 white space, 2 a line end or the beginning
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


_SHAPES: dict[str, int] = {}


def _attributes(token: str) -> int:
    """Shape and cue in one number; kept for short tokens, of which there are few."""
    found = _SHAPES.get(token)
    if found is None:
        found = shape(token) * N_CUE + _CUE.get(token.lower(), 0)
        if len(token) <= 6:
            if len(_SHAPES) > 200_000:
                _SHAPES.clear()
            _SHAPES[token] = found
    return found


def tokenise(texts: list[tuple[str, int, int]]) -> Sequences:
    both, gap, start, end, offsets = [], [], [], [], [0]
    for text, a, b in texts:
        last = a
        for m in _TOKEN.finditer(text, a, b):
            s, e = m.span()
            both.append(_attributes(m.group()))
            gap.append(2 if s == a or "\n" in text[last:s] else 1 if s > last else 0)
            start.append(s)
            end.append(e)
            last = e
        offsets.append(len(both))
    both = np.array(both, np.int64)
    return Sequences(both // N_CUE, both % N_CUE, np.array(gap, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(offsets, np.int64))


def features(x: Sequences) -> tuple[list[np.ndarray], list[int]]:
    """One number for each token and template, and the templates' sizes."""
    n = len(x.shape)
    seq = np.repeat(np.arange(len(x.offsets) - 1), np.diff(x.offsets))

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        """The value of the token ``by`` places on in the same sequence; 0 outside."""
        out = np.zeros(n, np.int64)
        k = min(abs(by), n)
        here, there = (slice(0, n - k), slice(k, n)) if by > 0 else (slice(k, n), slice(0, n - k)) if by else (slice(0, n), slice(0, n))
        same = seq[here] == seq[there]
        out[here] = np.where(same, values[there], 0)
        return out

    shapes = {o: shifted(x.shape, o) for o in range(-4, 5)}
    gaps = {o: shifted(x.gap, o) for o in (0, 1)}
    cues = {o: shifted(x.cue, o) for o in range(-4, 5)}
    found, sizes = [], []

    def add(values: np.ndarray, size: int) -> None:
        found.append(values)
        sizes.append(size)

    for o in shapes:
        add(shapes[o], N_SHAPE)
    for o in (-3, -2, -1, 0, 1, 2, 3):
        add(cues[o], N_CUE)
    near = np.zeros(n, np.int64)
    for o in (-4, -3, -2, -1):
        near = np.where(cues[o] > 0, cues[o], near)
    add(near * N_SHAPE + shapes[0], N_CUE * N_SHAPE)
    add(shapes[0] * 9 + gaps[0] * 3 + gaps[1], N_SHAPE * 9)
    add(shapes[-1] * N_SHAPE + shapes[0], N_SHAPE * N_SHAPE)
    add(shapes[0] * N_SHAPE + shapes[1], N_SHAPE * N_SHAPE)
    add(shapes[-2] * N_SHAPE + shapes[0], N_SHAPE * N_SHAPE)
    add(shapes[0] * N_SHAPE + shapes[2], N_SHAPE * N_SHAPE)
    return found, sizes


# ---- the field -------------------------------------------------------------------------

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N_LABEL = len(LABELS)
_ALLOWED = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])
_FIRST = np.array([not b.startswith("I") for b in LABELS])
PENALTY = 0.05
MOST_STEPS = 60
MOST_LABELLED = 4000  # rows of the labelled table that the field is fitted on


@dataclass
class Field:
    """Weights of each template's values by label, and of pairs of labels."""

    weights: list[np.ndarray]
    pairs: np.ndarray

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(found[0]), N_LABEL))
        for w, f in zip(self.weights, found, strict=True):
            out += w[f]
        return out


def _steps(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequences, tokens) of each step: the t-th tokens of all sequences that have one, longest
    sequences first, so that those of a step are the first of the step before."""
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    alive = len(order)
    length = length[order]
    for t in range(int(length[0]) if alive else 0):
        alive = int(np.searchsorted(-length[:alive], -t, side="left"))
        yield order[:alive], offsets[order[:alive]] + t


def viterbi(scores: np.ndarray, pairs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The best labels of all sequences, by steps over the whole batch; ties go to the first label."""
    trans = np.where(_ALLOWED, pairs, -np.inf)
    back = np.zeros((len(scores), N_LABEL), np.int8)
    labels = np.zeros(len(scores), np.int64)
    last = np.zeros((len(offsets) - 1, N_LABEL))
    best = np.empty((0, N_LABEL))
    steps = list(_steps(offsets))
    for t, (seqs, at) in enumerate(steps):
        if t == 0:
            best = np.where(_FIRST, scores[at], -np.inf)
        else:
            through = best[: len(seqs), :, None] + trans
            back[at] = through.argmax(1)
            best = through.max(1) + scores[at]
        last[seqs] = best
    state = last.argmax(1)
    for t in range(len(steps) - 1, -1, -1):
        seqs, at = steps[t]
        labels[at] = state[seqs]
        state[seqs] = back[at, state[seqs]]
    return labels


def likelihood(scores: np.ndarray, pairs: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, its gradient by scores, by pairs) of the labels, by scaled forward and
    backward passes over the whole batch."""
    trans = np.exp(pairs) * _ALLOWED
    top = scores.max(1, keepdims=True)
    local = np.exp(scores - top)
    forward, backward, scale = np.zeros_like(scores), np.zeros_like(scores), np.ones(len(scores))
    steps = list(_steps(offsets))
    for t, (seqs, at) in enumerate(steps):
        a = local[at] * (_FIRST if t == 0 else forward[steps[t - 1][1][: len(seqs)]] @ trans)
        scale[at] = a.sum(1)
        forward[at] = a / scale[at][:, None]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    backward[ends] = 1
    expected = np.zeros_like(pairs)
    for t in range(len(steps) - 1, 0, -1):
        _, at = steps[t]
        before = steps[t - 1][1][: len(at)]
        after = local[at] * backward[at] / scale[at][:, None]
        backward[before] = after @ trans.T
        expected += (forward[before].T @ after) * trans
    gradient = -forward * backward
    gradient[np.arange(len(labels)), labels] += 1
    inner = np.ones(len(labels), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    observed = np.zeros_like(pairs)
    np.add.at(observed, (labels[at - 1], labels[at]), 1)
    value = scores[np.arange(len(labels)), labels].sum() + pairs[labels[at - 1], labels[at]].sum() - np.log(scale).sum() - top.sum()
    return float(value), gradient, observed - expected


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:  # noqa: ANN001
    """Limited-memory BFGS with halving steps, until the gradient or the gain is small."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, weights = g.copy(), []
        for s, y, rho in reversed(past):
            weights.append(rho * (s @ q))
            q -= weights[-1] * y
        if past:
            s, y, rho = past[-1]
            q *= 1 / (rho * (y @ y))
        else:
            q /= max(1.0, float(np.abs(g).sum()) ** 0.5)
        for (s, y, rho), w in zip(past, reversed(weights), strict=True):
            q += s * (w - rho * (y @ q))
        step = 1.0
        while True:
            new = x - step * q
            value_new, g_new = f(new)
            if value_new <= value - 1e-4 * step * (g @ q) or step < 1e-6:
                break
            step /= 2
        if step < 1e-6:
            return x
        s, y = new - x, g_new - g
        if s @ y > 1e-10:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        gain = value - value_new
        x, value, g = new, value_new, g_new
        if gain < tolerance * max(abs(value), 1):
            return x
    return x


def fit_field(rows: list[tuple[str, list[Span]]]) -> Field:
    """Maximum likelihood with a quadratic penalty on rows of (text, spans)."""
    pieces = [(text, a, b) for text, _ in rows for a, b in stretches(text)]
    spans = [found for text, found in rows for _ in stretches(text)]
    x = tokenise(pieces)
    labels = np.zeros(len(x.shape), np.int64)
    for k, found in enumerate(spans):
        low, high = x.offsets[k], x.offsets[k + 1]
        for kind, a, b in found:
            at = low + np.flatnonzero((x.start[low:high] < b) & (x.end[low:high] > a))
            if len(at):
                labels[at] = LABELS.index(f"I-{kind}")
                labels[at[0]] = LABELS.index(f"B-{kind}")
    found, sizes = features(x)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    used, place = np.unique(np.concatenate([f + c for f, c in zip(found, cuts[:-1], strict=True)]), return_inverse=True)
    place = place.reshape(len(sizes), -1)
    n_weights = len(used) * N_LABEL

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, pairs = theta[:n_weights].reshape(-1, N_LABEL), theta[n_weights:].reshape(N_LABEL, N_LABEL)
        scores = np.zeros((len(labels), N_LABEL))
        for p in place:
            scores += w[p]
        value, by_score, by_pair = likelihood(scores, pairs, x.offsets, labels)
        g = np.zeros_like(w)
        for label in range(N_LABEL):
            for p in place:
                g[:, label] += np.bincount(p, weights=by_score[:, label], minlength=len(used))
        return -value + PENALTY / 2 * float(theta @ theta), np.concatenate((-g.ravel(), -by_pair.ravel())) + PENALTY * theta

    theta = _minimise(loss, np.zeros(n_weights + N_LABEL * N_LABEL), MOST_STEPS)
    flat = np.zeros((int(cuts[-1]), N_LABEL))
    flat[used] = theta[:n_weights].reshape(-1, N_LABEL)
    return Field(np.split(flat, cuts[1:-1]), theta[n_weights:].reshape(N_LABEL, N_LABEL))


def plausible(kind: str, text: str) -> bool:
    """Whether a decoded span can be of its kind."""
    digits = _digits(text)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and re.fullmatch(r"[+0-9 ().\-/ ]+", text) is not None
    if kind == "card":
        return 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9 .\-]+", text) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    at = re.search(r"@|(?<![^\W_])(?:at|arobase|arroba)(?![^\W_])", text, re.IGNORECASE)
    dot = re.search(r"\.|(?<![^\W_])(?:dot|punkt|punto|point)(?![^\W_])", text[at.end() :], re.IGNORECASE) if at else None
    return bool(dot and re.search(r"\w", text[: at.start()]) and re.search(r"\w", text[at.end() :][: dot.start()]) and re.search(r"\w", text[at.end() :][dot.end() :]))


def decode(field: Field, texts: list[str]) -> list[list[Span]]:
    """The plausible spans that the field finds in each text."""
    pieces = [(k, a, b) for k, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[Span]] = [[] for _ in texts]
    x = tokenise([(texts[k], a, b) for k, a, b in pieces])
    if not len(x.shape):
        return out
    labels = viterbi(field.scores(features(x)[0]), field.pairs, x.offsets)
    seq = np.searchsorted(x.offsets, np.arange(len(labels)), side="right") - 1
    begins = np.flatnonzero(labels % 2 == 1)  # B- labels
    for at in begins.tolist():
        last = at
        while last + 1 < len(labels) and labels[last + 1] == labels[at] + 1 and seq[last + 1] == seq[at]:
            last += 1
        k = pieces[seq[at]][0]
        a, b = int(x.start[at]), int(x.end[last])
        kind = LABELS[labels[at]][2:]
        if plausible(kind, texts[k][a:b]):
            out[k].append((kind, a, b))
    return out


def with_base(base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans stay; added ones join them where they touch none."""
    out = list(base)
    k, reach = 0, 0
    for s in added:  # by start, apart from each other
        while k < len(base) and base[k][1] < s[2]:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= s[1]:
            out.append(s)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the labelled table ----------------------------------------------------------------
# Sentences with marked spans. {w} is a word, {n} a number of so many digits.

SENTENCES = [
    "{w} {w} <email>{w}.{n2}@{w}.{w}.com</email> {w} {w}",
    "{w}, <email>{w}@{w}.org</email>. {W} {w}",
    "{W} <email>{w} at {w} dot com</email> {w}",
    "{w} email <email>{w} dot {w} at {w} dot org</email>, {w}",
    "{w} {w} <email>{w} dot {w} at {w} dot com</email> {w}",
    "{w}: <email>{w} [at] {w} [dot] com</email> {w}",
    "{w} <email>{w}(at){w}(dot)net</email> {w} {w}",
    "{W} kontakt <email>{w} (at) {w} punkt de</email>. {W}",
    "courriel <email>{w} arobase {w} point fr</email> {w}",
    "correo <email>{w} arroba {w} punto es</email> {w}",
    "{w} <email>{w} @ {w} . com</email> {w}",
    "{w} <email>{w}.{w} @ {w}.{w}.org</email>, {w}",
    "mail <email>{w}{n2} AT {w} DOT com</email> {w}",
    "write to <email>{w}_{w} [at] {w}.com</email> {w} {w}",
    "{w} {w} <ip>{o}.{o}.{o}.{o}</ip> {w} {w}",
    "server <ip>{o}[.]{o}[.]{o}[.]{o}</ip> {w}",
    "{w} <ip>{o}(.){o}(.){o}(.){o}</ip>, {w}",
    "{w} host <ip>{o} . {o} . {o} . {o}</ip> {w}",
    "{w} ip <ip>{o} dot {o} dot {o} dot {o}</ip> {w}",
    "{W} {w} <card>{n16}</card> {w} {w}",
    "{w} the <card>{n16}</card>. {W} {w}",
    "{w} | <card>{n16}</card> | {w}",
    "<card>{n16}</card> {w} {w}",
    "{w} de la <card>{n16}</card> que no {w}",
    "{w} at the <card>{n16}</card> of an {w}",
    "{w} <card>{n16}</card> <ip>{o}.{o}.{o}.{o}</ip> {w}",
    "{w} <card>{n16}</card> <card>{n16}</card> {w}",
    "<phone>+1 ({n3}) {n3}-{n4}</phone> <card>{n16}</card> {w}",
    "{w} <phone>+1 ({n3}) {n3}-{n4}</phone> <ip>{o}.{o}.{o}.{o}</ip> {w}",
    "{w} {w} <card>{n16}</card>",
    "card <card>{n4} {n4} {n4} {n4}</card> {w} {w}",
    "{w} <card>{n4}-{n4}-{n4}-{n4}</card>, {w}",
    "{w} <card>{n4}.{n4}.{n4}.{n4}</card> {w}",
    "{w} {w} <card>{n4} {n6} {n5}</card> {w}",
    "amex <card>{n15}</card> {w}",
    "{w} visa <card>{n13}</card> {w}",
    "{w} {w} <phone>+1 ({n3}) {n3}-{n4}</phone> {w} {w}",
    "<phone>+1 ({n3}) {n3}-{n4}</phone> {w}",
    "{w} <phone>({n3}) {n3}-{n4}</phone> {w}",
    "call <phone>{n3}-{n3}-{n4}</phone> {w}",
    "{w} tel <phone>{n3}.{n3}.{n4}</phone>, {w}",
    "{w} <phone>{n3} {n3} {n4}</phone> {w} {w}",
    "telefon <phone>00{n2} {n3} {n7}</phone> {w}",
    "{w} tel. <phone>0{n3}/{n7}</phone> {w}",
    "mobil: <phone>0{n3}-{n8}</phone>. {W}",
    "téléphone <phone>0{n1} {n2} {n2} {n2} {n2}</phone> {w}",
    "{w} <phone>+{n2} {n2} {n4} {n4}</phone> {w}",
    "teléfono <phone>{n3} {n2} {n2} {n2}</phone> {w}",
    "{w} phone: <phone>{n10}</phone> {w}",
    "{w} {w} in {n4} {w} {w}",
    "{w} {n2} {w} {w} {n3} {w}",
    "{n1}. {W} {w} {w}",
    "{n1}.{n1}.{n1} {W} {w}",
    "{w} version {n1}.{n2}.{n1} {w}",
    "release v{n1}.{n1} {w} {n4}-{n2}-{n2} {w}",
    "{w} {n2}/{n2}/{n4} {w} {n2}:{n2}",
    "{w} ${n1},{n3}.{n2} {w}",
    "{w} {n1},{n3},{n3} people {w}",
    "price {n3}.{n2} eur {w}",
    "order #{n6} {w} invoice {n8} {w}",
    "{w} token = \"{h40}\" {w}",
    "{w} token = \"{h40}\"",
    "{w} api_key: {h32} {w}",
    "key = '{A16}' {w}",
    "{w} {h8}-{h4}-{h4}-{h4}-{h12} {w}",
    "commit {h40} {w}",
    "isbn {n3}-{n1}-{n2}-{n6}-{n1} {w}",
    "isbn {n13} {w}",
    "doi 10.{n4}/{n6} {w}",
    "tracking {n20} {w} {w}",
    "{w} {n24} {w}",
    "{w} @{w} {w} {w}",
    "{w} {w} at {n2}:{n2} {w}",
    "{w} {w} dot {w} {w}",
    "{w} point {w} at {w} {w}",
    "at this point {w} {w} {w}",
    "au point de {w} {w}",
    "{w} punto de {w} a {w}",
    "der punkt ist {w} {w} {w}",
    "{w} {n2}-{n2} {w}, pages {n3}-{n3} {w}",
    "{n1}.{n5} + {n2}.{n3} = {n2}.{n4}",
    "{n2}.{n4}, {n1}.{n4} {w} {w}",
    "{w} {n9} {w} {n11} units",
    "{w} {n2} %, {n2} kg {w}",
    "{n3} {n3} {n3} {w} {n2} {n2} {w}",
    "{w} | {n2} | {n3} | {w} | {n4} |",
    "{w}{n2} {w}_{n3} {W}{n1}",
    "{w}!!! {n2}%%% {w}###",
    "{w} © {n4}-{n4} {w}",
]
COPIES = 10
_SLOT = re.compile(r"\{([wWonhA])([0-9]*)\}")
_MARK = re.compile(r"<(/?)([a-z]+)>")
_LETTERS = "abcdefghijklmnopqrstuvwxyzäéñçß"


def labelled_rows(copies: int = COPIES, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """(text, spans): every sentence several times, with words and digits drawn for each."""
    draw = random.Random(seed)

    def word() -> str:
        return "".join(draw.choice(_LETTERS) for _ in range(draw.randint(1, 11)))

    def fill(m: re.Match) -> str:
        kind, n = m.group(1), int(m.group(2) or 0)
        if kind in "wW":
            return word().capitalize() if kind == "W" or draw.random() < 0.1 else word()
        if kind == "o":
            return str(draw.randint(0, 255))
        return "".join(draw.choice({"n": "0123456789", "h": "0123456789abcdef", "A": "0123456789ABCDEFGHJKMNPQRSTUVWXYZ"}[kind]) for _ in range(n))

    rows = []
    for sentence in SENTENCES:
        for _ in range(copies):
            ends = [" ".join(word() for _ in range(draw.randint(0, 6))) for _ in range(2)]
            marked = f"{ends[0]} {_SLOT.sub(fill, sentence)} {ends[1]}".strip()
            text, spans, last = "", [], 0
            for m in _MARK.finditer(marked):
                text += marked[last : m.start()]
                last = m.end()
                if m.group(1):
                    spans[-1] = (*spans[-1][:2], len(text))
                else:
                    spans.append((m.group(2), len(text), 0))
            rows.append((text + marked[last:], spans))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """(text, spans) of the sentences above as a table: spans are (kind, start, stop)."""
    rows = [(t, [tuple(s) for s in spans]) for t, spans in labelled_rows()]
    return spark.createDataFrame(rows, "text string, spans array<struct<kind: string, start: int, stop: int>>")


def fit_from_table(labelled: DataFrame) -> Field:
    """The field of a table (text, spans); of more than ``MOST_LABELLED`` rows those of smallest
    hash.  Null texts and spans of other kinds are left out; without rows nothing is ever found."""
    sample = labelled.where("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(MOST_LABELLED).collect()
    return fit_field([(r.text, [(s.kind, s.start, s.stop) for s in r.spans or [] if s.kind in KINDS]) for r in sample])


# ---- the operator ----------------------------------------------------------------------


def find_private(docs: DataFrame, field: Field, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in whole texts.

    Returns the columns of ``docs`` but the text, with ``n_email``, ``n_ip``, ``n_card``,
    ``n_phone`` (longs, of base spans) and either ``base`` and ``found`` (arrays of kind, start,
    stop in code points, stop exclusive) and ``redacted`` (the text with each span as ``[kind]``),
    or with ``digests`` ``base_sha256`` and ``spans`` (strings).

    A null text counts as empty; empty texts hold nothing.  Null ids, repeated rows and extra
    columns pass through; columns named like an added one are replaced."""
    added = T.StructType()
    for kind in KINDS:
        added = added.add(f"n_{kind}", "long")
    one = T.StructType().add("kind", "string").add("start", "long").add("stop", "long")
    for name in ("base_sha256", "spans") if digests else ("base", "found", "redacted"):
        added = added.add(name, T.ArrayType(one) if name in ("base", "found") else T.StringType())
    out_cols = [c for c in docs.columns if c not in added.fieldNames() and c != text_col]
    docs = docs.select(*out_cols, text_col)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name != text_col), *added.fields])
    arrow = to_arrow_schema(schema)
    weights = docs.sparkSession.sparkContext.broadcast(field)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weights.value
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                base = [base_spans(t) for t in texts]
                spans = [with_base(b, f) for b, f in zip(base, decode(model, texts), strict=True)]
                new = [[sum(s[0] == kind for s in b) for b in base] for kind in KINDS]
                if digests:
                    new += [[hashlib.sha256(written(b).encode()).hexdigest() for b in base], [written(s) for s in spans]]
                else:
                    as_rows = lambda all_spans: [[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in f] for f in all_spans]
                    new += [as_rows(base), as_rows(spans), [redact(t, s) for t, s in zip(texts, spans, strict=True)]]
                columns = [batch.column(c) for c in out_cols] + [pa.array(v, arrow.field(n).type) for v, n in zip(new, added.fieldNames(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping ones the first counts."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])
