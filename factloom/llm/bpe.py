"""Byte-pair merges of many fragments at once.

All fragments of one length are rows of a matrix. A step merges, in each row, the pair of lowest rank (the leftmost of
equals), so every row that is not done has one symbol less after it, and the matrix stays rectangular. That takes time
with the square of the length, so long fragments are merged one by one, with a heap over a linked list.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np

from .shared import span_hashes, worker_cache

_NONE = np.int32(2**31 - 1)
#: Fragments of more bytes are merged one by one.
LONG = 200


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BatchBpe:
    """Merges over symbols that are token ids. ``end``: suffix of a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        alphabet = byte_alphabet()
        self.base = np.array([vocab[c] for c in alphabet], np.int32)
        self.base_last = np.array([vocab[c + end] for c in alphabet], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        to_byte = {c: b for b, c in enumerate(alphabet)}
        inside = np.zeros((256, 256), bool)
        for t in vocab:
            raw = bytes(to_byte[c] for c in (t.removesuffix(end) if end else t))
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a, b] = True
        #: Byte pairs that stand side by side inside no token: no merge crosses them.
        self.forced = ~inside

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _one(self, ids: np.ndarray) -> np.ndarray:
        """The merged symbols of one long fragment."""
        if not hasattr(self, "pairs"):
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged[self.ranks].tolist(), strict=True), strict=True))
        ranks = self.rank(ids[:-1], ids[1:]).astype(np.int64)
        at = np.flatnonzero(ranks != _NONE)
        heap = (ranks[at] << 32 | at).tolist()
        heapify(heap)
        s, n, pairs = ids.tolist(), len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if s[i] < 0 or j >= n:
                continue
            found = pairs.get(s[i] << 32 | s[j])
            if found is None or found[0] != top >> 32:
                continue
            s[i], s[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(s[i] << 32 | s[k])) is not None:
                    heappush(heap, x[0] << 32 | i)
            h = before[i]
            if h >= 0 and (x := pairs.get(s[h] << 32 | s[i])) is not None:
                heappush(heap, x[0] << 32 | h)
        return np.array([x for x in s if x >= 0], np.int32)

    def _group(self, s: np.ndarray, rows: np.ndarray, done: list) -> None:
        r = self.rank(s[:, :-1], s[:, 1:])
        while len(rows):
            if not r.shape[1]:
                done.append((rows, s))
                return
            j = r.argmin(axis=1)
            low = r[np.arange(len(rows)), j]
            stop = low == _NONE
            if stop.any():
                done.append((rows[stop], s[stop]))
                go = ~stop
                rows, s, r, j, low = rows[go], s[go], r[go], j[go], low[go]
                if not len(rows):
                    return
            n, width = s.shape
            i = np.arange(n)
            col = np.arange(width - 1)[None, :]
            s = np.take_along_axis(s, col + (col > j[:, None]), 1)
            s[i, j] = self.merged[low]
            if width == 2:
                done.append((rows, s))
                return
            col = col[:, :-1]
            r = np.take_along_axis(r, col + (col >= j[:, None]), 1)
            left = np.flatnonzero(j > 0)
            r[left, j[left] - 1] = self.rank(s[left, j[left] - 1], s[left, j[left]])
            right = np.flatnonzero(j < width - 2)
            r[right, j[right]] = self.rank(s[right, j[right]], s[right, j[right] + 1])

    def encode(self, data: np.ndarray, piece_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie end to end in ``data``, and where each piece's ids end.

        Pieces are cut at forced boundaries first; the fragments are encoded independently and concatenated.
        """
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(piece_ends), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.forced[data[:-1], data[1:]]
        word_end = np.zeros(len(data) + 1, bool)
        word_end[piece_ends] = True
        ends = np.flatnonzero(cut | word_end)
        ends = ends[ends > 0]
        starts = np.concatenate(([0], ends[:-1]))
        last = word_end[ends]
        size = ends - starts
        done: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        bounds = np.flatnonzero(np.diff(size[order], append=-1)) + 1
        begin = 0
        for bound in bounds:
            width = int(size[order[begin]])
            step = max(1, (1 << 18) // width)
            for k in range(begin, bound, step):
                rows = order[k : min(bound, k + step)]
                s = self.base[data[starts[rows][:, None] + np.arange(width)[None, :]]]
                s[last[rows], -1] = self.base_last[data[ends[rows[last[rows]]] - 1]]
                if width == 1:
                    done.append((rows, s))
                elif width > LONG:
                    done += [(rows[i : i + 1], self._one(s[i])[None, :]) for i in range(len(rows))]
                else:
                    self._group(s, rows, done)
            begin = bound
        count = np.zeros(len(size), np.int64)
        for rows, s in done:
            count[rows] = s.shape[1]
        to = np.cumsum(count)
        out = np.empty(int(to[-1]), np.int32)
        for rows, s in done:
            out[(to[rows] - s.shape[1])[:, None] + np.arange(s.shape[1])[None, :]] = s
        piece_at = np.searchsorted(ends, piece_ends)
        return out, np.where(piece_ends > 0, to[np.minimum(piece_at, len(to) - 1)], 0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes ``starts[i], starts[i] + 1, ...``, ``counts[i]`` of each, end to end."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.repeat(starts - begin, counts) + np.arange(total)


class PieceEncoder:
    """Ids of pieces, each encoded once: new ones of a batch together, known ones from a pool by their 64-bit hash."""

    def __init__(self, bpe: BatchBpe, most: int = 250_000):
        self.bpe, self.most = bpe, most
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.begin = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.pool = np.zeros(1 << 14, np.int32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def encode(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the spans of code points, end to end, and how many each has."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        keys, first, back = np.unique(span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        at = np.fromiter(map(self.index.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.index) + len(new) > self.most and self.index:
                self._clear()
                at[:] = -1
                new = np.arange(len(keys))
            s, e = starts[first[new]], ends[first[new]]
            cps = points[ragged(s, e - s)]
            width = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
            data = np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
            to = np.concatenate(([0], np.cumsum(width)))[np.cumsum(e - s)]
            ids, id_ends = self.bpe.encode(data, to)
            n = len(self.index)
            at[new] = np.arange(n, n + len(new))
            self.index.update(zip(keys[new].tolist(), range(n, n + len(new)), strict=True))
            self.begin, self.count = self._room(self.begin, n + len(new)), self._room(self.count, n + len(new))
            counts = np.diff(id_ends, prepend=0)
            self.begin[n : n + len(new)] = self.used + id_ends - counts
            self.count[n : n + len(new)] = counts
            self.pool = self._room(self.pool, self.used + len(ids))
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        at = at[back]
        counts = self.count[at]
        return self.pool[ragged(self.begin[at], counts)], counts


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
# What may follow an apostrophe as a piece of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _classes() -> np.ndarray:
    """As the tokenizers library's own patterns see every code point; Python's tables may be of another Unicode version."""
    from tokenizers import Regex, pre_tokenizers

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[a:b]] = kind
    return out


def classes() -> np.ndarray:
    """The class of every code point."""
    return worker_cache("classes", _classes)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and where each begins and the end."""
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), offsets


def pieces(points: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece of a pre-tokenizer over runs of letters, numbers and other characters.

    spaces: white space is kept; a run's last character stands before what follows, joined to it if it is a space, and
    numbers run on. Else white space is dropped and each number stands alone. An apostrophe that begins a piece takes a
    contraction's letters with it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start = change.copy()
    begins = edge[:-1]
    if spaces:
        next_solid = np.zeros(n, bool)
        next_solid[:-1] = ~space[1:] & ~edge[1:-1]
        last = space & next_solid
        start |= last
        joined = np.zeros(n, bool)
        joined[1:] = last[:-1] & (points[:-1] == 32)
        start &= ~joined
    else:
        start |= kind == NUMBER
        start &= ~space
        joined = begins & False
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & ~joined[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(quote):
        ends_at = offsets[np.searchsorted(offsets, quote, "right")]
        for word in CONTRACTIONS:
            k = len(word)
            fits = quote + k < ends_at
            q = quote[fits]
            hit = np.ones(len(q), bool)
            for j, c in enumerate(word):
                hit &= points[q + 1 + j] == ord(c)
            q = q[hit]
            start[q + 1] = False
            after = q + 1 + k
            inside = after[(after < n)]
            inside = inside[~edge[inside]]
            start[inside[kind[inside] == LETTER]] = True
    starts = np.flatnonzero(start)
    if spaces:
        return starts, np.concatenate((starts[1:], [n]))
    stop = start | space
    stop = np.flatnonzero(np.concatenate((stop, [True])))
    return starts, stop[np.searchsorted(stop, starts, "right")]
