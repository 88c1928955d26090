"""Exact token ids of whole texts, through the tokenizers library, with the work of repeated words done once.

Both vocabularies split a text into pre-tokens before merging, and no pre-token goes on past a blank: with
byte_bpe a blank opens the pre-token of the word after it, with word_bpe blanks and line ends are dropped. So the
ids of a text are the ids of its pieces between blanks, joined. Where a blank adjoins other white space it parts
nothing. Pieces are found and looked up with numpy over slices of texts; what is not known goes to the library, many
pieces joined to one string, whose ids are cut apart by the tokens that open (or end) a word.

Known pieces are in a hash table of SLOTS slots in a worker (about 40 MB), compared by all of their bytes; it starts
anew when three quarters full. Pieces above 24 bytes are not kept. Texts that hold the string of a special token are encoded
whole by the library as it comes, which makes that string the special token.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from plinth.llm.common import mix

SLOTS = 1 << 20
PROBES = 8
#: Longest piece in bytes that the table keeps: three 64-bit words.
KEPT_BYTES = 24
#: Bytes of texts that are cut into pieces at a time; a longer text is cut at blanks.
CHUNK_BYTES = 1 << 20
#: Pieces joined for one call of the library.
JOINED = 64
#: Signs that both vocabularies keep apart from a letter before them, as one pre-token if they stand together.
_SIGNS = ".,!?;:&$%*#|"
_SPACE = re.compile(r"\s")
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # masks of the first k bytes


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; operators take such a path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, of ASCII or beyond it."""
    out = (data <= 0x20) & ((data == 0x20) | (data >= 0x1C) | ((data >= 0x09) & (data <= 0x0D)))
    if data.size and data.max() >= 0xC2:
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        for at in (np.flatnonzero(data == lead) for lead in (0xC2, 0xE1, 0xE2, 0xE3)):
            if not len(at):
                continue
            lead, b, c = padded[at[0]], padded[at + 1], padded[at + 2]
            if lead == 0xC2:
                hit = (b == 0x85) | (b == 0xA0)
            elif lead == 0xE1:
                hit = (b == 0x9A) & (c == 0x80)
            elif lead == 0xE2:
                hit = ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F))
            else:
                hit = (b == 0x80) & (c == 0x80)
            for k in range(2 if lead == 0xC2 else 3):
                out[at[hit] + k] = True
    return out


class Encoder:
    """encode(data, offs): the ids of each text of a slice (UTF-8 bytes and offsets), and where each text's begin."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(added) if added else None
        # white space makes no ids and every run of it is one blank: line ends then part pieces as blanks do
        self.blind = not self.tokenizer.encode_batch_fast([" \n a \n"], add_special_tokens=False)[0].ids[1:]
        # tokens that open a piece after a blank, or that end a pre-token
        self.edge = np.zeros(self.size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.edge[number] = token.endswith("</w>") if self.blind else token.startswith("Ġ")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((3, SLOTS), np.uint64)
        self.marks = np.zeros(SLOTS, np.uint8)  # length, and 128 for pieces that begin a text; 0: free
        self.offset, self.number = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint8)
        self.ids, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def _append(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[:at], np.zeros(max(len(self.ids) // 2, len(ids)) + len(ids), np.uint32)))
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts, and how many each has."""
        out, counts = [], []
        for lo in range(0, len(texts), 1024):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 1024], add_special_tokens=False)]
            counts += map(len, ids)
            out.append(np.fromiter(chain.from_iterable(ids), np.uint32, sum(counts[-len(ids) :])))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(counts, np.int64)

    def _learn(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces (which follow a blank if lead is one), where each one's begin, and how many each has."""
        if self.blind:
            stems = [x.rstrip(_SIGNS) for x in pieces]
            edges = np.fromiter(((s.isalpha() and 1 + (len(s) < len(x))) for s, x in zip(stems, pieces, strict=True)), np.int64, len(pieces))
        else:
            edges = np.fromiter((bool(lead) and not _SPACE.search(x) for x in pieces), np.int64, len(pieces))
        begin, number = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        joined = np.flatnonzero(edges)
        groups = np.arange(0, len(joined), JOINED)
        order = joined.tolist()
        ids, counts = self._many([lead + " ".join([pieces[k] for k in order[i : i + JOINED]]) for i in groups.tolist()])
        if len(groups):
            starts = np.cumsum(counts) - counts
            edge = self.edge[ids]
            # a group whose pieces have other pre-tokens than their letters tell is encoded piece by piece
            good = np.add.reduceat(edge, starts, dtype=np.int64) == np.add.reduceat(edges[joined], groups)
            kept = np.repeat(good, counts)
            spots, own = np.flatnonzero(edge & kept), joined[np.repeat(good, np.diff(np.append(groups, len(joined))))]
            want = np.cumsum(edges[own])
            if self.blind:  # the last edge of each piece ends it
                ends = spots[want - 1] + 1
                number[own] = np.diff(ends, prepend=0)
                first = np.flatnonzero(np.isin(own, joined[groups[good]]))
                number[own[first]] = ends[first] - starts[good]
                begin[own] = ends - number[own]
            else:
                begin[own] = spots
                last = np.append(np.flatnonzero(np.isin(own, joined[groups[good]]))[1:] - 1, len(own) - 1)
                number[own] = np.diff(np.append(spots, 0))
                number[own[last]] = (starts + counts)[good] - spots[last]
            edges[own] = -1
        alone = np.flatnonzero(edges >= 0)
        more, counts = self._many([lead + pieces[k] for k in alone.tolist()])
        begin[alone], number[alone] = len(ids) + np.cumsum(counts) - counts, counts
        return np.concatenate((ids, more)), begin, number

    def _look(self, keys: np.ndarray, marks: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Slots of pieces, -1 where unknown."""
        out, todo = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k in range(PROBES):
            slot = ((h[todo] >> np.uint64(8)).astype(np.int64) + k) & (SLOTS - 1)
            there = self.marks[slot]
            same = (there == marks[todo]) & (self.keys[0, slot] == keys[0, todo]) & (self.keys[1, slot] == keys[1, todo]) & (self.keys[2, slot] == keys[2, todo])
            out[todo[same]] = slot[same]
            todo = todo[~same & (there > 0)]
            if not len(todo):
                break
        return out

    def _keep(self, keys: np.ndarray, marks: np.ndarray, h: np.ndarray, offset: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct pieces into free slots; those that find none are not kept."""
        todo = np.flatnonzero(number < 256)
        for k in range(PROBES):
            slot = ((h[todo] >> np.uint64(8)).astype(np.int64) + k) & (SLOTS - 1)
            free = np.flatnonzero(self.marks[slot] == 0)
            spot, first = np.unique(slot[free], return_index=True)
            won = free[first]
            who = todo[won]
            self.keys[:, spot], self.marks[spot] = keys[:, who], marks[who]
            self.offset[spot], self.number[spot] = offset[who], number[who]
            self.held += len(who)
            todo = np.delete(todo, won)

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, in order, and how many each has; head: pieces that begin a text."""
        if self.held > SLOTS // 4 * 3 or self.used > 8 * SLOTS:
            self._clear()
        size = end - start
        padded = np.concatenate((data, np.zeros(32, np.uint8)))
        word = np.ndarray(len(data) + 24, "<u8", buffer=padded, strides=(1,))
        keys = np.stack([word[np.minimum(start + 8 * k, len(data) + 16)] & _LOW[np.clip(size - 8 * k, 0, 8)] for k in range(3)])
        marks = (np.minimum(size, KEPT_BYTES + 1) | np.where(head & (not self.blind), 128, 0)).astype(np.uint8)
        h = mix(keys[0] * _A ^ keys[1] * _B ^ keys[2] * _C ^ marks.astype(np.uint64) * _D)
        short = size <= KEPT_BYTES
        slot = np.full(len(start), -1, np.int64)
        slot[short] = self._look(keys[:, short], marks[short], h[short])
        new = np.flatnonzero(slot < 0)
        offset = self.offset[slot].astype(np.int64)
        number = self.number[slot].astype(np.int64)
        if len(new):
            raw, of, local = data, np.empty(len(new), np.int64), {}
            # distinct unknown pieces: neighbours in the order of their hashes that are the same in all their bytes
            order = np.argsort(h[new], kind="stable")
            o = new[order]
            fresh = np.ones(len(o), bool)
            fresh[1:] = (h[o[1:]] != h[o[:-1]]) | (marks[o[1:]] != marks[o[:-1]]) | (keys[:, o[1:]] != keys[:, o[:-1]]).any(axis=0) | ~short[o[1:]] | ~short[o[:-1]]
            of[order] = np.cumsum(fresh) - 1
            reps = o[fresh]
            names = [raw[i:j].tobytes().decode() for i, j in zip(start[reps].tolist(), end[reps].tolist(), strict=True)]
            local_of = np.empty(len(reps), np.int64)
            first = marks[reps] >= 128
            lists: tuple[list[str], list[str]] = ([], [])
            for k, (name, at_head) in enumerate(zip(names, first.tolist(), strict=True)):
                found = local.setdefault((name, at_head), len(lists[at_head]))
                if found == len(lists[at_head]):
                    lists[at_head].append(name)
                local_of[k] = found
            made_offset, made_number = np.empty(len(reps), np.int64), np.empty(len(reps), np.int64)
            for kind, lead in ((0, "" if self.blind else " "), (1, "")):
                if lists[kind]:
                    ids, begin, n = self._learn(lists[kind], lead)
                    own = first == bool(kind)
                    made_number[own] = n[local_of[own]]
                    made_offset[own] = self._append(ids) + begin[local_of[own]]
            keep = short[reps]
            self._keep(keys[:, reps[keep]], marks[reps[keep]], h[reps[keep]], made_offset[keep], made_number[keep])
            offset[new], number[new] = made_offset[of], made_number[of]
        ends = np.cumsum(number)
        return self.ids[np.repeat(offset - ends + number, number) + np.arange(ends[-1] if len(ends) else 0)], number

    def _part(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of texts without strings of special tokens."""
        white = _white(data)
        gap = data == 0x20
        if self.blind:
            gap |= data == 0x0A
        else:
            gap[:1] = gap[-1:] = False
            gap[1:-1] &= ~white[:-2] & ~white[2:]
            some = offs[1:] > offs[:-1]
            gap[offs[:-1][some]] = False
            gap[offs[1:][some] - 1] = False
        at = np.flatnonzero(gap)
        out, counts, lo, n = [], np.zeros(len(offs) - 1, np.int64), 0, len(data)
        while lo < n:
            hi = n
            if n - lo > CHUNK_BYTES:  # on to the last gap before, or the first after, or the end of a text
                k = int(np.searchsorted(at, lo + CHUNK_BYTES))
                hi = int(at[k - 1]) if k and at[k - 1] > lo else int(at[k]) if k < len(at) else n
            cuts = offs[(offs >= lo) & (offs <= hi)]
            inner = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
            # every blank ends a piece and the one after it begins another; so do ends of texts
            start = np.sort(np.concatenate(([lo], inner + 1, cuts[(cuts > lo) & (cuts < hi)])))
            end = np.sort(np.concatenate((inner, cuts[(cuts > lo) & (cuts < hi)], [hi])))
            full = end > start
            start, end = start[full], end[full]
            doc = np.searchsorted(offs, start, "right") - 1
            ids, number = self._pieces(data, start, end, start == offs[doc])
            counts += np.bincount(doc, number, len(counts)).astype(np.int64)
            out.append(ids)
            lo = hi + 1 if hi < n and gap[hi] else hi
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum(counts)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes() if self.special else b""
        at = raw.find(self.special) if self.special else -1
        if at < 0:
            return self._part(data, offs)
        whole = set()
        while at >= 0:
            doc = int(np.searchsorted(offs, at, "right")) - 1
            whole.add(doc)
            at = raw.find(self.special, int(offs[doc + 1]))
        ids, counts, lo = [], [], 0
        for doc in [*sorted(whole), len(offs) - 1]:
            if doc > lo:
                part, bounds = self._part(data[offs[lo] : offs[doc]], offs[lo : doc + 1] - offs[lo])
                ids.append(part)
                counts += np.diff(bounds).tolist()
            if doc < len(offs) - 1:
                ids.append(np.array(self.tokenizer.encode(raw[offs[doc] : offs[doc + 1]].decode(), add_special_tokens=False).ids, np.uint32))
                counts.append(len(ids[-1]))
            lo = doc + 1
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(counts)))

    def encode_ended(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with the end id after each text's ids; little-endian unsigned 32-bit."""
        ids, bounds = self.encode(data, offs)
        return np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False), bounds + np.arange(len(bounds))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    return Encoder(path)
