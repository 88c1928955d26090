"""Personal data: fixed patterns with their checks, and a linear-chain CRF over word shapes that adds what they miss.

The patterns (email, ip, card, phone) follow their contract exactly: leftmost matches without overlap for each
kind, in code points, checked afterwards, without retries. Each is searched so that no text takes quadratic time.

The CRF labels words B-/I- email, ip, card, phone and secret. Features are the shape of a word, the shape's outline,
digit and length classes, and the shapes or cue words just before. It is trained by gradient ascent on the
likelihood, on a small labelled table of sentences (training_table()). Every word of a text has its emission scores, from
numpy lookups by what its features depend on. Where a word's score for O is so far above its others that no transition
can make up for it, the best path has O there whatever is around (see Crf.gain and Crf.stretch); so a text falls into runs of
other words between such O's, and Viterbi over padded numpy batches of runs gives the best path of the whole text. A decoded
span is cut free of surrounding signs, must pass its kind's check (Luhn, octets, digit counts, secret-like strength), and
is added where it overlaps no span that is there already.

Defined results: a null or empty text has no spans; repeated rows get a row each; a very long text takes time in
proportion, and memory in proportion to its words; further columns are kept by redact(), whatever their names, and not
read by find(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import bounded_batches, code_points, combine, released, span_hashes, table, text_slices, words

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
Span = tuple[int, int, int]  # number of the kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @ of a run of address characters: what precedes it, back to the last match or another character, if a domain follows."""
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


# --- the CRF ---------------------------------------------------------------------------------------------------

#: Passes that look for words which are surely O; what is left is decoded.
PEELS = 4
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_DIGITS = frozenset("0123456789")
#: Words that announce personal data; matched without signs, in lower case: fixed values.
CUES = frozenset("token key apikey api_key secret password passwd pwd auth bearer tel phone call fax mobile email mail card visa ip host addr".split())
_TRIM = "\"'`.,;:!?&$%*#|<>[]{}()="
_RUN = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^\x00-\x7f]+")


def shape(word: str) -> str:
    """9 for a digit, a and A for runs of letters, u for runs beyond ASCII; digit runs over four are 9+."""
    return _RUN.sub(lambda m: "u" if m.group()[0] > "\x7f" else ("9" * len(m.group()) if len(m.group()) < 5 else "9+") if m.group()[0].isdigit() else "a" if m.group()[0].islower() else "A", word)


def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(_TRIM)
    digits = sum(c in _DIGITS for c in core)
    hexish = len(core) >= 16 and all(c in "0123456789abcdefABCDEF" for c in core)
    mixed = len(core) >= 16 and digits >= 3 and any(c.isalpha() for c in core)
    s = shape(core)
    return (f"s={s if len(s) <= 24 else 'long'}", f"o={re.sub('9+[+]?', '9', s)[:12]}", f"d={min(digits, 4) if digits < 5 else 5 if digits < 9 else 9 if digits < 13 else 13 if digits < 20 else 20}", f"n={min(len(core) // 4, 6)}", f"at={'@' in core}", f"hex={hexish}", f"mixed={mixed}", f"p={word[:1] if not word[:1].isalnum() else ''}")


def cue(word: str) -> str:
    core = word.strip(_TRIM)
    core = core.lower() if core.isascii() else core
    return core if core in CUES else "=" if word.strip("\"'") in ("=", ":", ":=") else "-"


def features(word: str, before: str, further: str) -> tuple[str, ...]:
    b, f = cue(before), cue(further)
    return (*word_features(word), f"b={b}", f"f={f}", f"bs={shape(before)[:8] if any(c in _DIGITS for c in before) else '-'}")


def training_table() -> list[tuple[str, str]]:
    """The labelled table, as (sentence, kind of the part in double braces or ''): templates filled by a fixed seed."""
    rng = np.random.default_rng(5)
    plain = "The Die Élan était größe niño EN OK Über ça à É — – “ ” | || !! ... ( ) (word) word, word. Word: word; word! Qué? “Ça étés» l'été d'un e-mail semi-final né. aïe, Ä, A.B. * ** *** # $$$ %%% &&& ### WORD! WORD!! foo/bar <b> [x] naïveté, œuvre ñandú Straße. token key card".split()
    filler = plain + 2 * "the and of to in is with for this that from are was by on as be or not at und der die das ist mit les des une est pour que los las del con una".split()
    names = filler[len(plain) :]

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def hexes(n: int) -> str:
        return "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, n))

    def mixed(n: int) -> str:
        return "".join("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"[i] for i in rng.integers(0, 55, n))

    def some(n: int) -> str:
        return " ".join(rng.choice(filler, n))

    def card() -> str:
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    made: list[tuple[str, str]] = []
    for i in range(12):
        c = card()
        made += [
            (f"{some(3)} {{{{{rng.choice(names)}.{digits(2)}@mail{digits(1)}.example.com}}}} {some(2)}", "email"),
            (f"email {{{{{rng.choice(names)}_{rng.choice(names)}@host.example.org}}}}, {some(3)}", "email"),
            (f"{some(2)} {{{{{'.'.join(str(x) for x in rng.integers(1, 255, 4))}}}}} {some(3)}", "ip"),
            (f"{some(4)} {{{{{c}}}}} {some(2)}", "card"),
            (f"{some(2)} {{{{{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}}}}} {some(2)}", "card"),
            (f"card {{{{{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}}}}}. {some(2)}", "card"),
            (f"{some(3)} {{{{+1 ({digits(3)}) 555-{digits(4)}}}}} {some(2)}", "phone"),
            (f"{some(2)} {{{{({digits(3)}) {digits(3)}-{digits(4)}}}}} {some(2)}", "phone"),
            (f"tel {{{{{digits(3)}-{digits(3)}-{digits(4)}}}}} {some(2)}", "phone"),
            (f"call {{{{{digits(3)}.{digits(3)}.{digits(4)}}}}}, {some(3)}", "phone"),
            (f'{some(2)} token = "{{{{{hexes(40)}}}}}" {some(2)}', "secret"),
            (f"{some(1)} password: {{{{{mixed(20)}}}}} {some(1)}", "secret"),
            (f"api_key = {{{{{mixed(32)}}}}} {some(2)}", "secret"),
            (f"{some(2)} {digits(4)} {some(3)}", ""),
            (f"{some(2)} {digits(2)}. {some(1)} {digits(1)}.{digits(1)}. {some(2)}", ""),
            (f"version {digits(1)}.{digits(1)}.{digits(1)} {some(2)} {digits(3)} {some(1)}", ""),
            (f"{some(1)} {digits(2)}-{digits(2)}-{digits(4)} {some(2)} {digits(4)}-{digits(2)}-{digits(2)}", ""),
            (f"{some(2)} {digits(7)} {some(1)} {digits(10)} {some(2)}", ""),
            (f"{some(2)} {digits(2)}:{digits(2)} {some(2)} ({digits(4)}) {some(1)} {digits(2)}%", ""),
            (f"{some(2)} {digits(4)} {digits(4)} {some(1)} {digits(3)} {digits(3)} {some(1)}", ""),
            (f"{some(1)} {rng.choice(names)}{digits(2)} {some(2)} @{rng.choice(names)} {some(1)} {hexes(8)} {some(1)}", ""),
        ]
    return made


def _labelled(sentence: str, kind: str) -> tuple[list[str], list[int]]:
    tokens, tags, inside = [], [], False
    for raw in sentence.split(" "):
        opens, closes = "{{" in raw, "}}" in raw
        inside = inside or opens
        tags.append(LABELS.index(f"{'B' if opens else 'I'}-{kind}") if inside else 0)
        tokens.append(raw.replace("{{", "").replace("}}", ""))
        inside = inside and not closes
    return tokens, tags


class Crf:
    """weights: feature by label; moves: label by label; starts: label. The chain's scores are sums of these.

    gain: for each label, the most that a path can win by transitions through it, against O at the same word. Where
    O's emission is ahead of every other label's by more than that, the best path has O.
    """

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.index, self.weights, self.moves, self.starts = index, weights, moves, starts
        #: What a label wins against O by the transition into it: from any label, from O, from the start; and out of it.
        self.into = np.stack([(moves - moves[:, :1]).max(axis=0), moves[0] - moves[0, 0], starts - starts[0]])
        self.after = np.stack([(moves - moves[:1]).max(axis=1), moves[:, 0] - moves[0, 0], np.zeros(len(moves))])
        self.gain = self.into.max(axis=0) + self.after.max(axis=0)
        #: What each word of a stretch of other labels wins at most against a stretch of O's: each transition counts once.
        self.stretch = np.maximum((moves - moves[0, 0]).max(axis=0), starts - starts[0]) + np.maximum(moves[:, 0] - moves[0, 0], 0)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[object, int] = {}
        self.tables = np.zeros((3, 1024, len(LABELS)))

    def _row(self, key: object, word: str) -> int:
        """The row of a kind of word in the tables of scores: as the word itself, as the one before, as the one before that."""
        if key not in self.row:
            at = self.row[key] = len(self.row)
            if at == self.tables.shape[1]:
                self.tables = np.concatenate((self.tables, np.zeros_like(self.tables)), axis=1)
            b = (f"b={cue(word)}", f"bs={shape(word)[:8] if any(c in _DIGITS for c in word) else '-'}")
            for k, found in enumerate((word_features(word), b, (f"f={cue(word)}",))):
                self.tables[k, at] = self.weights[[self.index[f] for f in found if f in self.index]].sum(axis=0)
        return self.row[key]

    def rows(self, data: np.ndarray, w) -> np.ndarray:
        """The row of each word, and last that of the missing word before a text's first."""
        if len(self.row) > 100_000:
            self._clear()
        out = np.empty(len(w.start) + 1, np.int64)
        out[-1] = self._row("", "")
        raw = data.tobytes()
        marked = np.diff(np.concatenate(([0], np.cumsum(_MARK[data])))[np.concatenate((w.start[:, None], w.end[:, None]), axis=1)], axis=1)[:, 0] > 0
        for i in np.flatnonzero(marked).tolist():
            word = raw[w.start[i] : w.end[i]].decode()
            out[i] = self._row(word, word)
        plain = np.flatnonzero(~marked)
        start, end = w.start[plain], w.end[plain]
        keys, first, of = np.unique(_plain_keys(data, start, end), return_index=True, return_inverse=True)
        known = np.array([self._row(key, raw[start[i] : end[i]].decode()) for key, i in zip(keys.tolist(), first.tolist(), strict=True)], np.int64)
        out[plain] = known[of]
        return out

    def open_words(self, rows: np.ndarray, first: np.ndarray, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """The words that aren't surely O, and their emissions; first: where each text's words begin."""
        at, scores = [np.zeros(0, np.int64)], [np.zeros((0, len(LABELS)))]
        own, before, further = self.tables
        for lo in range(0, len(rows) - 1, most):
            i = np.arange(lo, min(lo + most, len(rows) - 1))
            place = i - first[np.searchsorted(first, i, "right") - 1]
            e = own[rows[i]] + before[rows[np.where(place > 0, i - 1, -1)]] + further[rows[np.where(place > 1, i - 2, -1)]]
            unsure = ~(e[:, :1] - e[:, 1:] > self.gain[1:]).all(axis=1)
            at.append(i[unsure])
            scores.append(e[unsure])
        return self._peeled(np.concatenate(at), np.concatenate(scores), first)

    def _peeled(self, at: np.ndarray, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without runs of which every stretch surely loses to O's, and words that are O because what is beside them is."""
        for _ in range(PEELS):
            if not len(at):
                break
            doc = np.searchsorted(first, at, "right") - 1
            joined = np.concatenate(([False], np.diff(at) == 1, [False]))
            joined[1:-1] &= doc[1:] == doc[:-1]
            before = np.where(joined[:-1], 0, np.where(at == first[doc], 2, 1))
            behind = np.where(joined[1:], 0, np.where(at + 1 == first[doc + 1], 2, 1))
            ahead = scores[:, :1] - scores[:, 1:]
            unsure = ~(ahead > (self.into[before] + self.after[behind])[:, 1:]).all(axis=1)
            heads = np.flatnonzero(~joined[:-1])
            risky = np.logical_or.reduceat((ahead <= self.stretch[1:]).any(axis=1), heads)
            unsure &= np.repeat(risky, np.diff(np.append(heads, len(at))))
            if unsure.all():
                break
            at, scores = at[unsure], scores[unsure]
        return at, scores

    def viterbi(self, runs: list[np.ndarray], heads: np.ndarray | None = None, tails: np.ndarray | None = None) -> list[np.ndarray]:
        """The best labels of each run of emissions, each between O's, or at its text's start (heads) or end (tails).

        Runs of like length share a numpy batch.
        """
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        heads, tails = (np.zeros(len(runs), bool) if x is None else x for x in (heads, tails))
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        lo = 0
        while lo < len(order):
            longest = len(runs[order[lo]])
            hi = lo
            while hi < len(order) and hi - lo < 4096 and len(runs[order[hi]]) <= longest * 1.25:
                hi += 1
            part = order[lo:hi]
            n, most = len(part), len(runs[part[-1]])
            scores = np.zeros((n, most, len(LABELS)))
            lengths = np.array([len(runs[i]) for i in part])
            for row, i in enumerate(part):
                scores[row, : len(runs[i])] = runs[i]
            best = scores[:, 0] + np.where(heads[part][:, None], self.starts, self.moves[0])
            back = np.zeros((n, most, len(LABELS)), np.int8)
            final = np.where((lengths == 1)[:, None], best, 0.0)
            for t in range(1, most):
                step = best[:, :, None] + self.moves[None]
                back[:, t] = step.argmax(axis=1)
                best = step.max(axis=1) + scores[:, t]
                final[lengths == t + 1] = best[lengths == t + 1]
            label = (final + np.where(tails[part][:, None], 0.0, self.moves[:, 0])).argmax(axis=1)
            path = np.zeros((n, most), int)
            for t in range(most - 1, -1, -1):
                live = lengths > t
                path[live, t] = label[live]
                label = np.where(live, back[np.arange(n), t, label], label)
            for row, i in enumerate(part):
                out[i] = path[row, : lengths[row]]
            lo = hi
        return out


_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[128:] = 97, 65, 117
_LETTER = np.isin(_KIND, (97, 65, 117))
_HEX = np.isin(np.arange(256), list(b"abcdefABCDEF"))
_TRIMMED = np.isin(np.arange(256), list(_TRIM.encode()))
_CUE_HASHES = None


def _cue_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the number of the cue that it is without signs, from 1, or 0."""
    global _CUE_HASHES
    if _CUE_HASHES is None:
        raw = np.frombuffer(" ".join(sorted(CUES)).encode(), np.uint8)
        c = words(raw, np.array([0, len(raw)]))
        _CUE_HASHES = np.sort(span_hashes(raw, c.start, c.end))
    lo, hi = start.copy(), end.copy()
    while (more := (lo < hi) & _TRIMMED[data[np.minimum(lo, len(data) - 1)]]).any():
        lo += more
    while (more := (lo < hi) & _TRIMMED[data[hi - 1]]).any():
        hi -= more
    h = span_hashes(data, lo, hi, lower=True)
    at = np.minimum(np.searchsorted(_CUE_HASHES, h), len(_CUE_HASHES) - 1)
    return np.where(_CUE_HASHES[at] == h, at + 1, 0)


def _plain_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One key for all words without digit or @ that have the same features: shape, length, cue, hex letters, first sign."""
    if not len(start):
        return np.zeros(0, np.uint64)
    kind = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~_LETTER[data[1:]]
    keep[start] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    shapes = span_hashes(kind[keep], place[start], place[end])
    length = code_points(data)
    size = np.minimum(length[end] - length[start], 1000)
    hexes = np.concatenate(([0], np.cumsum(_HEX[data])))
    hexes = np.where(size >= 16, np.minimum(hexes[end] - hexes[start], 1000), 0)
    # of a first sign beyond ASCII, whether it is a letter matters: those of Latin-1 are all but two
    lead, follow = data[start], data[np.minimum(start + 1, len(data) - 1)]
    latin = (lead == 0xC3) & (follow != 0x97) & (follow != 0xB7)
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    sign = np.where((lead >= 0x80) & ~latin, padded[start].astype(np.uint64) | padded[start + 1].astype(np.uint64) << np.uint64(8) | padded[start + 2].astype(np.uint64) << np.uint64(16) | padded[start + 3].astype(np.uint64) << np.uint64(24), np.uint64(1) * latin)
    return combine(shapes, size.astype(np.uint64) | hexes.astype(np.uint64) << np.uint64(10) | _cue_numbers(data, start, end).astype(np.uint64) << np.uint64(20), sign)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def train(steps: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> Crf:
    """Maximum likelihood by Adam, with forward-backward over the whole padded table at each step."""
    rows = [_labelled(*r) for r in training_table()]
    index: dict[str, int] = {}
    found = [[[index.setdefault(f, len(index)) for f in features(w, t[i - 1] if i else "", t[i - 2] if i > 1 else "")] for i, w in enumerate(t)] for t, _ in rows]
    n, most, k, wide = len(rows), max(len(t) for t, _ in rows), len(LABELS), len(found[0][0])
    feats, tags, live = np.zeros((n, most, wide), int), np.zeros((n, most), int), np.zeros((n, most), bool)
    for r, (t, y) in enumerate(rows):
        feats[r, : len(t)], tags[r, : len(t)], live[r, : len(t)] = found[r], y, True
    gold_w, gold_m = np.zeros((len(index), k)), np.zeros((k, k))
    np.add.at(gold_w, (feats[live], tags[live][:, None]), 1)
    pairs = live[:, 1:]
    np.add.at(gold_m, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    gold_s = np.bincount(tags[:, 0], minlength=k)
    theta = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        w, a, s = theta
        e = w[feats].sum(axis=2)
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = e[:, 0] + s
        for t in range(1, most):
            alpha[:, t] = np.where(live[:, t, None], _lse(alpha[:, t - 1, :, None] + a[None], 1) + e[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], _lse(a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _lse(alpha[:, -1], 1)
        gamma = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        xi = np.exp(alpha[:, :-1, :, None] + a + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        expect = np.zeros_like(w)
        np.add.at(expect, feats.reshape(-1, wide), np.repeat(gamma.reshape(-1, 1, k), wide, axis=1))
        grads = [gold_w - expect, gold_m - xi.sum(axis=(0, 1)), gold_s - gamma[:, 0].sum(axis=0)]
        for i, g in enumerate(grads):
            g = g / n - ridge * theta[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            theta[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(index, *theta)


def _passes(kind: int, found: str) -> bool:
    digits = _NOT_DIGIT.sub("", found)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", found) is not None
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15 and len(found) <= 2 * len(digits)
    return len(found) >= 16 and len(digits) >= 3 and re.search("[A-Za-z]", found) is not None


_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True


def find_spans(texts: list[str], data: np.ndarray, offs: np.ndarray, crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, each sorted by kind and start."""
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    base: dict[int, list[Span]] = {}
    for d in np.unique(np.searchsorted(offs, np.flatnonzero(_MARK[data]), "right") - 1).tolist():
        if spans := base_spans(texts[d]):
            base[d] = spans
            out[d] = sorted(spans), sorted(spans)
    w = words(data, offs)
    if not len(w.start):
        return out
    unsure, scores = crf.open_words(crf.rows(data, w), w.first)
    if not len(unsure):
        return out
    cuts = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(w.doc[unsure]) > 0)) + 1
    runs = np.split(unsure, cuts)
    heads, tails = (np.array(x) for x in zip(*((r[0] == w.first[w.doc[r[0]]], r[-1] + 1 == w.first[w.doc[r[0]] + 1]) for r in runs), strict=True))
    added: dict[int, list[tuple[int, int, int]]] = {}
    for run, labels in zip(runs, crf.viterbi(np.split(scores, cuts), heads, tails), strict=True):
        at = 0
        while labels.any() and at < len(run):
            if not labels[at]:
                at += 1
                continue
            kind, end = (labels[at] - 1) // 2, at + 1
            while end < len(run) and labels[end] == 2 * kind + 2:
                end += 1
            added.setdefault(int(w.doc[run[at]]), []).append((int(kind), int(w.start[run[at]]), int(w.end[run[end - 1]])))
            at = end
    raw, points = data.tobytes(), code_points(data) if added else None
    for d, more in added.items():
        spans = base.get(d, [])
        every, taken, at, last = list(spans), sorted((a, b) for _, a, b in spans), 0, 0
        reach = np.maximum.accumulate([0, *(b for _, b in taken)])
        begins = [a for a, _ in taken]
        for kind, lo, hi in more:  # in the order of their starts, none inside of another
            begin = int(points[lo] - points[offs[d]])
            found = raw[lo:hi].decode()
            open_signs = _TRIM.replace("(", "") if kind == 3 else _TRIM
            begin += len(found) - len(found.lstrip(open_signs))
            found = found.strip(open_signs).rstrip(_TRIM)
            end = begin + len(found)
            while at < len(begins) and begins[at] < end:
                at += 1
            if found and begin >= last and reach[at] <= begin and _passes(kind, found):
                every.append((kind, begin, end))
                last = end
        out[d] = sorted(spans), sorted(every)
    return out


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, for every row of docs (doc_id, text)."""
    crf = train()
    model = (crf.index, crf.weights, crf.moves, crf.starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*model)
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                found = find_spans(rows.column("text").to_pylist(), data, offs, crf)
                numbers = [pa.array([sum(k == kind for k, *_ in base) for base, _ in found], pa.int64()) for kind in range(4)]
                digests = [hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *numbers, pa.array(digests), pa.array([_text(every) for _, every in found])], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(released(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span (of overlapping ones, all as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all spans of text replaced; the other columns (and null texts) are as they were."""
    crf = train()
    model = (crf.index, crf.weights, crf.moves, crf.starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            null, done = batch.column(at).is_null(), 0
            for rows, data, offs in text_slices(batch, text):
                own = rows.column(at).to_pylist()
                new = [redacted(t, every) if every else t for t, (_, every) in zip(own, find_spans(own, data, offs, crf), strict=True)]
                mask = null.slice(done, len(own)).to_numpy(zero_copy_only=False)
                done += len(own)
                yield rows.set_column(at, batch.schema.field(at), pa.array(new, pa.string(), mask=mask))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), docs.schema)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced in the texts; n_chars, where there, follows. Every document stays."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
