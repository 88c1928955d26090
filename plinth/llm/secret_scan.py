"""Secrets: fixed patterns, and a linear-chain CRF that tags tokens as begin, inside or outside of a secret.

The patterns (assign, access, hex) follow their contract exactly: leftmost matches without overlap for each kind, in code
points, checked afterwards, without retries. A text is searched only for what its bytes can hold, which is read off in numpy.

Tokens are runs of letters, digits, `+/_.-` and bytes beyond ASCII. A token's features are its shape (length, kinds of signs, how often
they change, shares of digits and vowels, hex, known beginnings of keys), its neighbours (signs before and after, cue words one and
two before and one behind, the kinds of signs of the token before), and its file (assignments and brackets by line). Each
is a row of a table of weights by label, so scores are sums of lookups. The weights and transitions are trained by
gradient ascent on the exact likelihood over a small labelled table of files (training_table()).

A token that has no digit and is shorter than a dozen signs, or has signs beyond ASCII, is O by the model's rules. What its own shape
says decides most others: where O is ahead by more than all that its neighbours and transitions could
add, the best path has O there whatever is around. The others get all features, those which transitions can't turn are O
too, and Viterbi over padded numpy batches of what is left between O's gives the best path of the whole text. A decoded span takes base64 padding
along, must look random (see strong()), and is added where it overlaps no span that is there already.

Defined results: a null or empty text has no spans; repeated rows get a row each; a very long text takes time and memory in
proportion, and is one row of one task; further columns are kept by redact(), whatever their names, and not read by
find(); an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plinth.llm.common import Words, bounded_batches, code_points, released, table, text_slices, words

KINDS = ("assign", "access", "hex", "secret")
BASE_KINDS = KINDS[:3]
Span = tuple[int, int, int]  # start, end, number of the kind

_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Shortest group 2 of an assignment, shortest access key, shortest run of hex digits.
LEAST = (6, 20, 24)
_STEMS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str) -> list[Span]:
    """All spans of the patterns, by start, then kind."""
    out = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= LEAST[0]]
    out += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST[1]]
    out += [(*m.span(), 2) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST[2]]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _may_match(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The texts of a slice that can hold a base span."""
    at = [np.zeros(0, np.int64)]
    low = _LOWER[data].tobytes()
    for raw, stem in [*((low, s) for s in _STEMS), (data.tobytes(), b"AKIA")]:
        k, seen = raw.find(stem), []
        while k >= 0:
            seen.append(k)
            k = raw.find(stem, k + 1)
        at.append(np.array(seen, np.int64))
    other = np.flatnonzero(~_IS_HEX[data])
    edges = np.concatenate(([-1], other, [len(data)]))
    at.append(edges[:-1][np.diff(edges) > LEAST[2]] + 1)
    found = [np.searchsorted(offs, x, "right") - 1 for x in at]
    # a run of hex digits may go on in the next text of the slice
    found += [np.searchsorted(offs, edges[1:][np.diff(edges) > LEAST[2]] - 1, "right") - 1]
    spread = [np.arange(a, b + 1) for a, b in zip(found[-2].tolist(), found[-1].tolist(), strict=True) if b > a + 1]
    return np.unique(np.concatenate([*found, *spread])).astype(np.int64)


# --- the CRF: features -----------------------------------------------------------------------------------------

LABELS = ("O", "B", "I")
_SIGNS = b"+/_.-"
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *_SIGNS, *range(128, 256)]] = True
_BETWEEN = ~_TOKEN
#: 1 digit, 2 lower, 3 upper, 4 sign, 5 beyond ASCII
_KIND = np.zeros(256, np.uint8)
_KIND[48:58], _KIND[97:123], _KIND[65:91], _KIND[128:] = 1, 2, 3, 5
_KIND[list(_SIGNS)] = 4
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY"))
_ANY_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
_SIZES = np.array([4, 8, 12, 16, 20, 24, 32, 40, 64])
#: The first three signs of well-known keys: fixed values.
PREFIXES = ("AIz", "AKI", "ASI", "eyJ", "gho", "ghp", "glp", "npm", "pk_", "sk-", "sk_", "xox")
_PREFIXES = np.sort([int.from_bytes(p.encode(), "little") for p in PREFIXES])
#: Words that announce a secret, or something that only looks like one: fixed values.
CUES = "password passwd pwd pass passphrase secret token key apikey auth authorization bearer basic credential credentials private access client aws login signature session cookie jwt begin end sha256 sha1 sha512 md5 commit digest checksum hash uuid id guid version etag integrity path url host revision request trace".split()
_CUE = {w: i + 1 for i, w in enumerate(CUES)}
_PIECE = re.compile(rb"[A-Za-z0-9]+")
_HUMP = re.compile(rb"[A-Z]?[a-z0-9]+|[A-Z0-9]+")


def cue(word: bytes) -> int:
    """The number of the last cue among a token's parts (between signs, or by capitals), or 0."""
    if len(word) > 40:
        return 0
    for piece in reversed(_PIECE.findall(word)):
        for part in (piece, *reversed(_HUMP.findall(piece))):
            if at := _CUE.get(part.lower().decode("ascii")):
                return at
    return 0


def _count(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _marks(signs: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(signs))


#: Rows of the tables of a token's own features, of those of signs and file around it, and of those of the words around it.
OWN = (10, 192, 9, 9, 4, len(PREFIXES) + 1, 60)
SIGNED = (12, 12, 33, 16, 12 * 10)
CUED = (len(CUES) + 2,) * 3


#: A token without a digit and of fewer signs is never inside of a secret, nor is one with signs beyond ASCII.
WORDY = 12


def able(data: np.ndarray, w: Words) -> np.ndarray:
    """The tokens that may be part of a secret; all others are O, whatever is around them."""
    digits, high = _count(_KIND[data] == 1), _count(data >= 128)
    return np.flatnonzero(((digits[w.end] > digits[w.start]) | (w.end - w.start >= WORDY)) & (high[w.end] == high[w.start]))


def own_features(data: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """A row of numbers for each of the tokens at, one for each table of OWN."""
    s, e = w.start[at], w.end[at]
    size = e - s
    kind = _KIND[data]
    digits, lower, upper, signs, high = ((c := _count(kind == k))[e] - c[s] for k in range(1, 6))
    changed = np.zeros(len(data), bool)
    changed[1:] = kind[1:] != kind[:-1]
    c = _count(changed)
    changes = c[e] - c[s + 1] if len(s) else np.zeros(0, np.int32)
    c = _count(_VOWEL[data])
    letters = lower + upper
    vowels = np.where(letters > 0, (c[e] - c[s]) * 8 // np.maximum(letters, 1), 8)
    c = _count(_ANY_HEX[data])
    hexes = c[e] - c[s]
    looks = np.where((hexes == size) & (size >= 16), 1, np.where((size == 36) & (hexes == 32) & (signs == 4), 2, np.where((letters == 0) & (high == 0), 3, 0)))
    padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    lead = padded[s] | padded[s + 1] << 8 | padded[s + 2] << 16
    at = np.minimum(np.searchsorted(_PREFIXES, lead), len(_PREFIXES) - 1)
    known = np.where((_PREFIXES[at] == lead) & (size >= 12), at + 1, 0)
    mask = (digits > 0) | (lower > 0) * 2 | (upper > 0) * 4 | (signs > 0) * 8 | (high > 0) * 16
    wide = np.searchsorted(_SIZES, size, "right")
    turns = np.minimum(changes * 10 // np.maximum(size, 1), 5)
    return np.stack([wide, mask * 6 + turns, digits * 8 // np.maximum(size, 1), vowels, looks, known, wide * 6 + turns], axis=1).astype(np.int64)


def _signs_between(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """What stands between two tokens: the strongest of = : @ line end, other sign, blank; twice that, and one for a quote."""
    out = np.zeros(len(lo), np.int64)
    left = np.ones(len(lo), bool)
    for code, marks in ((1, b"="), (2, b":"), (4, b"@"), (3, b"\n\r")):
        c = _count(_marks(marks)[data])
        hit = left & (c[hi] > c[lo])
        out[hit] = code
        left &= ~hit
    c = _count(~_marks(b" \t\"'`")[data] & ~_TOKEN[data])
    out[left & (c[hi] > c[lo])] = 5
    c = _count(_marks(b"\"'`")[data])
    return out * 2 + (c[hi] > c[lo])


def cue_features(data: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """A row of numbers for each of the tokens at, one for each table of CUED: of the words one and two before, and one behind."""
    raw, seen, doc = data.tobytes(), {}, w.doc[at]

    def cues(i: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = np.full(len(i), len(CUES) + 1, np.int64)
        for k in np.flatnonzero(there).tolist():
            word = raw[w.start[i[k]] : w.end[i[k]]]
            if word not in seen:
                seen[word] = cue(word)
            out[k] = seen[word]
        return out

    return np.stack([cues(at - 1, at > w.first[doc]), cues(at - 2, at - 2 >= w.first[doc]), cues(at + 1, at + 1 < w.first[doc + 1])], axis=1)


def sign_features(data: np.ndarray, offs: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """A row of numbers for each of the tokens at, one for each table of SIGNED."""
    doc = w.doc[at]
    wide = np.searchsorted(_SIZES, w.end[at] - w.start[at], "right")
    head, tail = at == w.first[doc], at + 1 == w.first[doc + 1]
    before = _signs_between(data, np.where(head, offs[doc], w.end[np.maximum(at - 1, 0)]), w.start[at])
    behind = _signs_between(data, w.end[at], np.where(tail, offs[doc + 1], w.start[np.minimum(at + 1, len(w.start) - 1)]))
    mask, prior = np.where(head, 32, 0), np.maximum(at - 1, 0)
    for k in range(1, 6):
        c = _count(_KIND[data] == k)
        mask += np.where(~head & (c[w.end[prior]] > c[w.start[prior]]), 1 << (k - 1), 0)
    lines = _count(data == 10)
    lines = lines[offs[1:]] - lines[offs[:-1]] + 1
    shares = []
    for marks in (b"=:", b"{}();"):
        c = _count(_marks(marks)[data])
        shares.append(np.minimum(2 * (c[offs[1:]] - c[offs[:-1]]) // lines, 3))
    file = (shares[0] + 4 * shares[1])[doc]
    return np.stack([before, behind, mask, file, before * 10 + wide], axis=1).astype(np.int64)


# --- the CRF: training -----------------------------------------------------------------------------------------


def training_table(seed: int = 11, files: int = 420) -> list[str]:
    """Labelled files, secrets in double braces: templates of prose, settings, code, logs and key blocks filled by a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    signs = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    mixed = digits + lower + lower.upper()
    number = lambda lo, hi: int(rng.integers(lo, hi))
    syllables = "an the er in on re st ea or ti ing ed th sh wh nd ou ly en heit ung lich sch ver ge die que ción mente los ado eau eux ais tion é ñ ö ü ß ça".split()

    def word() -> str:
        made = "".join(pick(syllables) for _ in range(number(1, 9 if rng.random() < 0.1 else 5)))
        return made.capitalize() if rng.random() < 0.15 else made

    def some(lo: int, hi: int) -> str:
        return " ".join(word() + (pick((",", ".", "", "", "", "", ":", " |", "***", "###", "!", "?"))) for _ in range(number(lo, hi)))

    def name() -> str:
        style = number(0, 4)
        parts = [pick(("db", "user", "mail", "host", "port", "path", "name", "size", "region", "level", "queue", "cache", "retry", "model", "file")) for _ in range(number(1, 3))]
        return "_".join(parts) if style == 0 else "_".join(parts).upper() if style == 1 else "-".join(parts) if style == 2 else parts[0] + "".join(p.capitalize() for p in parts[1:])

    def secret() -> str:
        return pick((
            lambda: signs(mixed, number(12, 44)), lambda: signs(mixed + "+/", number(24, 64)) + pick(("", "=", "==")), lambda: signs(digits + "abcdef", pick((32, 40, 64))),
            lambda: "ghp_" + signs(mixed, 36), lambda: f"xoxb-{signs(digits, 12)}-{signs(mixed, 24)}", lambda: "sk_live_" + signs(mixed, 24), lambda: "AIza" + signs(mixed + "_-", 35),
            lambda: f"eyJ{signs(mixed, 20)}.eyJ{signs(mixed, 60)}.{signs(mixed + '_-', 43)}", lambda: signs(mixed + "_-", number(20, 48)), lambda: f"glpat-{signs(mixed, 20)}",
        ))()

    def phrase() -> str:
        return word().capitalize()[:6] + signs(digits, number(2, 5)) + pick("!#$%&*") + signs(mixed, number(2, 6))

    def plain() -> str:
        return pick((
            lambda: str(number(0, 10**number(1, 9))), lambda: f"{number(0, 20)}.{number(0, 20)}.{number(0, 20)}", lambda: f"/{word()}/{word()}/{word()}.{pick(('log', 'txt', 'json', 'py'))}", lambda: f"https://{word()}.example.com/{word()}/{number(1, 9999)}",
            lambda: f"{number(1, 255)}.{number(1, 255)}.{number(1, 255)}.{number(1, 255)}", lambda: f"{word()}.{number(1, 99)}@mail{number(0, 9)}.example.com", lambda: f"20{number(10, 30)}-{number(10, 13)}-{number(10, 29)}T{number(10, 24)}:{number(10, 60)}:{number(10, 60)}Z",
            lambda: f"{signs(digits + 'abcdef', 8)}-{signs(digits + 'abcdef', 4)}-4{signs(digits + 'abcdef', 3)}-a{signs(digits + 'abcdef', 3)}-{signs(digits + 'abcdef', 12)}", lambda: signs(digits, 16), lambda: f"+1 ({signs(digits, 3)}) 555-{signs(digits, 4)}", lambda: f"{word()}_{word()}_{word()}",
            lambda: word() + word().capitalize() + word().capitalize(), lambda: signs(digits, 4) + " " + signs(digits, 4) + " " + signs(digits, 4) + " " + signs(digits, 4), lambda: f"{word()}-{word()}-{word()}-{number(1, 99)}", lambda: word(), lambda: f"{word()}{number(1, 2100)}", lambda: "true",
            lambda: f"{word()}\n{word()}{word()}{word()}{word()}{word()}", lambda: word().upper() + "_" + word().upper(), lambda: signs(digits + "abcdef", pick((7, 8, 10, 12))),
        ))()

    def about() -> str:
        return pick(("digest", "sha256", "commit", "checksum", "etag", "request id", "trace_id", "integrity", "md5", "revision", "uuid"))

    def looks() -> str:
        return pick((lambda: signs(digits + "abcdef", pick((32, 40, 64))), lambda: "sha512-" + signs(mixed + "+/", 64) + "==", lambda: signs(digits + "abcdef", 20), lambda: signs(mixed, number(16, 24))))()

    def key() -> str:
        return pick(("password", "passwd", "pwd", "db_pass", "PASSPHRASE", "client_secret", "clientSecret", "aws_secret_access_key", "api_key", "apiKey", "API-KEY", "auth_token", "access_token", "AUTH", "private_key", "session_key", "credentials", "login_secret", "SECRET_KEY", "jwt", "cookie_signature"))

    quote = lambda: pick(('"', "'", ""))

    def line(kind: int) -> str:
        hides, q = rng.random() < 0.35, quote()
        k, v = (key(), "{{" + (secret() if rng.random() < 0.85 else phrase()) + "}}") if hides else (about(), looks()) if rng.random() < 0.2 else (name(), plain())
        if kind == 1:
            return f"{k}{pick(('=', ' = ', ': ', ' := '))}{q}{v}{q}"
        if kind == 2:
            return f'  "{k}": "{v}",'
        if kind == 3:
            return pick((f"{k} = {q or chr(34)}{v}{q or chr(34)};", f"set_{name()}({k}={q or chr(39)}{v}{q or chr(39)})", f"if ({name()} > {number(1, 99)}) {{ return {name()}.{name()}({name()}); }}", f"# {some(2, 8)}"))
        stamp = f"20{number(10, 30)}-0{number(1, 9)}-1{number(0, 9)} {number(10, 24)}:{number(10, 60)}:{number(10, 60)}"
        return pick((f"{stamp} INFO {name()} {some(2, 6)} {number(0, 9999)}", f"{stamp} DEBUG request {looks() if rng.random() < 0.3 else plain()} {some(1, 4)}", f"> Authorization: Bearer {{{{{secret()}}}}}", f"{stamp} WARN {k} {v}", f"{stamp} connect {pick(('postgres', 'amqp', 'redis'))}://{word()}:{{{{{signs(mixed, number(10, 20))}}}}}@{word()}.example.com:{number(1000, 9999)}/{word()}"))

    made = []
    for i in range(files):
        kind = i % 7
        if kind in (0, 5):
            parts = [some(4, 30)]
            for _ in range(number(1, 4)):
                way = rng.random()
                parts += [pick((f"{key()} {{{{{secret()}}}}}", f"{key()} is {{{{{secret()}}}}}", f"{key()} is {{{{{signs(mixed, number(10, 20))}}}}}", f'token = "{{{{{secret()}}}}}"', f"bearer {{{{{secret()}}}}}")) if way < 0.3 else f"{about()} {looks()}" if way < 0.4 else plain(), some(3, 20)]
            made.append(" ".join(parts))
        elif kind == 6:
            block = "\n".join(signs(mixed + "+/", 64) for _ in range(number(2, 5)))
            made.append(f"{some(0, 6)}\n-----BEGIN {pick(('RSA ', 'EC ', ''))}PRIVATE KEY-----\n{{{{{block}\n{signs(mixed, number(20, 60))}}}}}\n-----END PRIVATE KEY-----\n{some(0, 5)}")
        else:
            made.append("\n".join(line(kind) for _ in range(number(3, 12))))
    return made


def labelled(files: list[str]) -> tuple[np.ndarray, np.ndarray, Words, np.ndarray]:
    """Bytes, offsets and tokens of the files without their braces, and a label for each token."""
    raw, at, spans, offs = [], 0, [], [0]
    for text in files:
        for k, part in enumerate(re.split(r"\{\{|\}\}", text)):
            part = part.encode()
            if k % 2:
                spans.append((at, at + len(part)))
            raw.append(part)
            at += len(part)
        offs.append(at)
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.array(offs)
    w = words(data, offs, _BETWEEN)
    tags, may = np.zeros(len(w.start), np.int64), np.zeros(len(w.start), bool)
    may[able(data, w)] = True
    for lo, hi in spans:
        inside = np.arange(np.searchsorted(w.end, lo, "right"), np.searchsorted(w.start, hi, "left"))
        inside = inside[may[inside]]
        tags[inside] = 2
        tags[inside[np.diff(inside, prepend=-2) > 1]] = 1
    return data, offs, w, tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    """tables: weights by row and label, for each of OWN, SIGNED and CUED; moves: label by label; starts: label."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray, starts: np.ndarray):
        self.tables, self.moves, self.starts = tables, moves, starts
        #: The most that a label can win against O by the transitions into and out of it.
        self.gain = np.maximum((moves - moves[:, :1]).max(axis=0), starts - starts[0]) + np.maximum((moves - moves[:1]).max(axis=1), 0)
        #: The most that it can win by each table.
        self.help = np.stack([(t - t[:, :1]).max(axis=0) for t in tables])

    def scores(self, data: np.ndarray, offs: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that aren't surely O, and their scores by label."""
        at, done = able(data, w), 0
        e = np.zeros((len(at), len(LABELS)))
        for tables, found in ((OWN, lambda: own_features(data, w, at)), (SIGNED, lambda: sign_features(data, offs, w, at)), (CUED, lambda: cue_features(data, w, at))):
            if not len(at):
                break
            rows = found()
            for k in range(len(tables)):
                e += self.tables[done + k][rows[:, k]]
            done += len(tables)
            unsure = (e[:, 1:] - e[:, :1] + self.help[done:, 1:].sum(axis=0) + self.gain[1:] >= 0).any(axis=1)
            at, e = at[unsure], e[unsure]
        return at, e

    def decode(self, w: Words, at: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best path's labels of the tokens at; all others are O. Runs of like length share a numpy batch."""
        out = np.zeros(len(at), np.int64)
        if not len(at):
            return out
        cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(w.doc[at]) > 0)) + 1
        begin = np.concatenate(([0], cuts))
        size = np.diff(np.append(begin, len(at)))
        doc = w.doc[at[begin]]
        heads, tails = at[begin] == w.first[doc], at[begin] + size == w.first[doc + 1]
        order, lo = np.argsort(size, kind="stable"), 0
        while lo < len(order):
            hi = min(lo + 4096, int(np.searchsorted(size[order], size[order[lo]] * 1.25, "right")))
            part = order[lo:hi]
            n, most = size[part], int(size[part].max())
            place = begin[part][:, None] + np.minimum(np.arange(most), n[:, None] - 1)
            e = scores[place]
            best = e[:, 0] + np.where(heads[part][:, None], self.starts, self.moves[0])
            back, final = np.zeros((len(part), most, len(LABELS)), np.int8), best.copy()
            for t in range(1, most):
                step = best[:, :, None] + self.moves
                back[:, t] = step.argmax(axis=1)
                best = step.max(axis=1) + e[:, t]
                final = np.where((n > t)[:, None], best, final)
            label = (final + np.where(tails[part][:, None], 0.0, self.moves[:, 0])).argmax(axis=1)
            for t in range(most - 1, -1, -1):
                live = n > t
                out[place[live, t]] = label[live]
                label = np.where(live, back[np.arange(len(part)), t, label], label)
            lo = hi
        return out


@lru_cache(maxsize=1)
def train(steps: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by Adam, with forward-backward over the padded table at each step."""
    data, offs, w, tags = labelled(training_table())
    at, barred = able(data, w), np.zeros((len(w.start), len(LABELS)))
    barred[:, 1:] = -1e4
    every = np.concatenate((own_features(data, w, at), sign_features(data, offs, w, at), cue_features(data, w, at)), axis=1)
    sizes = [*OWN, *SIGNED, *CUED]
    base = np.concatenate(([0], np.cumsum(sizes)))
    total, k = int(base[-1]), len(LABELS)
    flat = every + base[:-1]
    n, most = len(offs) - 1, int(w.counts().max())
    live = np.arange(most) < w.counts()[:, None]
    gold = np.zeros((n, most), np.int64)
    gold[live] = tags
    wanted = np.zeros((total, k))
    for c in range(k):
        wanted[:, c] = np.bincount(flat[tags[at] == c].ravel(), minlength=total)
    pairs = live[:, 1:]
    moved = np.bincount(gold[:, :-1][pairs] * k + gold[:, 1:][pairs], minlength=k * k).reshape(k, k)
    theta = [np.zeros((total, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        weights, a, s = theta
        e = np.zeros((n, most, k))
        scores = barred.copy()
        scores[at] = weights[flat].sum(axis=1)
        e[live] = scores
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = e[:, 0] + s
        for t in range(1, most):
            alpha[:, t] = np.where(live[:, t, None], _lse(alpha[:, t - 1, :, None] + a[None], 1) + e[:, t], alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], _lse(a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _lse(alpha[:, -1], 1)
        gamma = np.exp(alpha + beta - z[:, None, None])
        xi = np.exp(alpha[:, :-1, :, None] + a + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        expect = np.stack([np.bincount(flat.ravel(), np.repeat(gamma[live][at, c], flat.shape[1]), total) for c in range(k)], axis=1)
        starts = np.bincount(gold[:, 0], minlength=k) - gamma[:, 0].sum(axis=0)
        for i, g in enumerate((wanted - expect, moved - xi.sum(axis=(0, 1)), starts)):
            g = g / n - ridge * theta[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            theta[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf([theta[0][base[i] : base[i + 1]] for i in range(len(sizes))], theta[1], theta[2])


# --- the scan --------------------------------------------------------------------------------------------------

_DIGIT = re.compile(r"[0-9]")


def strong(found: str) -> bool:
    """Whether a decoded span looks random: of eight signs or more, digits among letters, and not a number, date or id in dashes."""
    digits = len(_DIGIT.findall(found))
    letters = sum(c.isalpha() and c.isascii() for c in found)
    if not found.isascii() or len(found) < 8 or not digits or letters < 4:
        return False
    return len(found) >= 16 or len({c.isupper() for c in found if c.isalpha()}) > 1 or digits >= 3


def find_spans(texts: list[str], data: np.ndarray, offs: np.ndarray, crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, by start, then kind."""
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    if not len(data):
        return out
    for d in _may_match(data, offs).tolist():
        spans = base_spans(texts[d])
        out[d] = spans, spans
    w = words(data, offs, _BETWEEN)
    at, scores = crf.scores(data, offs, w)
    labels = crf.decode(w, at, scores)
    hit = np.flatnonzero(labels)
    if not len(hit):
        return out
    # a span begins at a B, or at an I that follows no other label of its text
    joined = np.zeros(len(hit), bool)
    joined[1:] = (np.diff(hit) == 1) & (np.diff(at[hit]) == 1) & (w.doc[at[hit]][1:] == w.doc[at[hit]][:-1]) & (labels[hit][1:] == 2)
    heads = np.flatnonzero(~joined)
    raw, points, more = data.tobytes(), code_points(data), {}
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(hit)], strict=True):
        lo, hi, d = int(w.start[at[hit[a]]]), int(w.end[at[hit[b - 1]]]), int(w.doc[at[hit[a]]])
        hi += next((k for k in (2, 1) if raw[hi : min(hi + k, int(offs[d + 1]))] == b"=" * k), 0)
        if strong(raw[lo:hi].decode()):
            more.setdefault(d, []).append((int(points[lo] - points[offs[d]]), int(points[hi] - points[offs[d]]), 3))
    for d, added in more.items():
        base = out[d][0]
        begins, reach = [s[0] for s in base], np.maximum.accumulate([0, *(s[1] for s in base)])
        places = np.searchsorted(begins, [b for _, b, _ in added], "left")
        free = [s for s, p in zip(added, places.tolist(), strict=True) if reach[p] <= s[0]]
        out[d] = base, sorted([*base, *free], key=lambda s: (s[0], s[2], s[1]))
    return out


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, for every row of docs (doc_id, text)."""
    crf = train()
    model = (crf.tables, crf.moves, crf.starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*model)
        for batch in batches:
            for rows, data, offs in text_slices(batch):
                found = find_spans(rows.column("text").to_pylist(), data, offs, crf)
                numbers = [pa.array([sum(k == kind for *_, k in base) for base, _ in found], pa.int64()) for kind in range(3)]
                digests = [hashlib.sha256(_text(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *numbers, pa.array(digests), pa.array([_text(every) for _, every in found])], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(released(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span (of overlapping ones, all as one) replaced by [SECRET]."""
    out, at, last = [], 0, -1
    for a, b, _ in spans:
        if a >= last:
            out += [text[at:a], "[SECRET]"]
        last = at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all secrets of text replaced; the other columns (and null texts) are as they were."""
    crf = train()
    model = (crf.tables, crf.moves, crf.starts)

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


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
