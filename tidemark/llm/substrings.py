"""Passages that near-duplicate each other, by compact windows.

A text's tokens are its five-word shingles.  Under one min-hash, the Cartesian tree over the tokens' hash values gives
compact windows (l, c, r): every subsequence that begins in l..c and ends in c..r has its minimum at c, so windows with
equal minima stand for all pairs of subsequences that share the signature.  Only windows wide enough for a whole passage
are made: their centres are the minima of some span of that width, found by a sliding minimum and a sliding maximum over
it, and their ends by a stack over those centres alone.

A window's context is the shingles that a shortest passage around its centre can reach.  Of the windows with equal
minima, those that share a whole passage word by word at the same distance from their centres (or their whole context)
are linked to the first that has it.  All others of the minimum are compared with each other, in pairs of tiles: first
those that share a passage word by word at any distance are linked, then those whose contexts hold near-duplicate
passages, unless earlier links of the pair of tiles join them already, so links grow with the windows.  The links of two
documents are joined where their intervals overlap on about the same diagonal; the intervals are cut from the texts and
verified by the Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HUB_LEAST, HUB_SHARE, connected_components, cut, drop_cut, text_blocks
from .embeddings import find

SHINGLE = 5
#: Words in the shortest passage.
PASSAGE = 50
HASHES = 4
#: Hashes that must link a pair of intervals before it is verified; their contexts were compared already.
AGREE = 1
SIMILARITY = 0.8
#: Shift, in words, up to which links count as of one diagonal.
SHIFT = 12
#: Windows of one minimum in a tile, and buckets that a context's shingles are counted in before they are compared.
TILE, BUCKETS = 2000, 512
#: Shingles before the centre at which the passages begin that windows are linked by at first, in parts of a passage.
STARTS = (1 / 6, 1 / 2, 5 / 6)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose words are hashed at once.
BYTES = 1 << 20
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    odd = int(_MIX)
    up, down = np.full(n, odd, np.uint64), np.full(n, pow(odd, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in bytes, A-Z lower-cased, and where they begin.  The last byte must be white space."""
    hashes, begins, at = [], [], 0
    while at < len(raw):
        end = min(at + BYTES, len(raw))
        if end < len(raw):  # not inside a word
            while not (gap := _SPACE[raw[end : end + BYTES]]).any():
                end += BYTES
            end += int(gap.argmax()) + 1
        part = raw[at:end]
        space = _SPACE[part]
        edge = np.diff(space, prepend=True)
        begin, stop = np.nonzero(edge & ~space)[0], np.nonzero(edge & space)[0]
        up, down = _powers(1 << max(20, (len(part) - 1).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[part] * up[: len(part)], dtype=np.uint64)])
        hashes.append(mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64)))
        begins.append(begin + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(begins)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Shingled:
    """Hashes of the five-word shingles of texts: base[starts[i] : starts[i] + sizes[i]] for text i, each ended by a 0."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        h, begins = word_hashes(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
        ends = np.cumsum([len(r) + 1 for r in raw])
        of = np.searchsorted(ends, begins, "right")
        words = np.bincount(of, minlength=len(raw))
        self.sizes = np.maximum(words - SHINGLE + 1, 0)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])
        self.base = np.zeros(int(self.sizes.sum()) + len(raw), np.uint64)
        n = len(h) - SHINGLE + 1
        if n > 0:
            out = np.zeros(n, np.uint64)
            for i in range(SHINGLE):
                out = out * _MIX + mix(h[i : i + n] + np.uint64(i + 1))
            at = np.nonzero(of[:n] == of[SHINGLE - 1 :])[0]  # within one text
            first = np.concatenate([[0], np.cumsum(words)[:-1]])
            self.base[self.starts[of[at]] + at - first[of[at]]] = mix(out[at]) | np.uint64(1)  # never 0


def shingles(text: str | None) -> np.ndarray:
    """Hashes of a text's five-word shingles, in order (none for a shorter text)."""
    return Shingled([text]).base[:-1]


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every span of width of x, by doubling."""
    n = 1
    while 2 * n <= width:
        x = op(x[:-n], x[n:])
        n *= 2
    return op(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def compact_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the windows of width at least; 0 in h parts documents."""
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 3
    low = sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, h.dtype)
    best = sliding(np.concatenate([pad, low, pad]), width, np.maximum)  # over all spans that hold a position
    at = np.nonzero((best == h) | (h == 0))[0]
    v, pos = h[at].tolist(), at.tolist()
    left, right, stack = [-1] * len(at), [len(h)] * len(at), []
    for i, x in enumerate(v):  # parents of a wide window are wide windows or ends of documents, so the rest can be left out
        while stack and v[stack[-1]] > x:
            right[stack.pop()] = pos[i]
        if stack:
            left[i] = pos[stack[-1]]
        stack.append(i)
    l, r = np.array(left, np.int64) + 1, np.array(right, np.int64) - 1  # noqa: E741
    ok = (h[at] != 0) & (r - l + 1 >= width)
    return l[ok], at[ok], r[ok]


class _Runs:
    """Hashes of stretches base[lo:hi] as seen from c: equal where the shingles and their distances from c are."""

    def __init__(self, base: np.ndarray):
        up, self.back = _powers(1 << max(20, len(base).bit_length()))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(base * up[: len(base)], dtype=np.uint64)])

    def __call__(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.total[hi] - self.total[lo]) * self.back[c]) >> np.uint64(32) | np.uint64(1)


#: A window: its minimum, document, l and c, r and hash function, and two pairs of keys, of the context and of runs.
WINDOW = ("grp", "doc", "lc", "rh", "ab", "cd")
LOW = (1 << 32) - 1


def _windows(width: int, hashes: int):
    back = [int(x * width) for x in STARTS]

    def block(texts: list[str | None], docs: np.ndarray) -> np.ndarray:
        of = Shingled(texts)
        base, sizes, starts, found = of.base, of.sizes, of.starts, []
        runs = _Runs(base)
        for k in range(hashes):
            h = np.where(base == 0, np.uint64(0), mix(base + np.uint64((k + 1) * int(_MIX) % (1 << 64))) | np.uint64(1))
            l, c, r = compact_windows(h, width)  # noqa: E741
            d = np.searchsorted(starts, c, "right") - 1
            first, end = starts[d], starts[d] + sizes[d]
            keys = [runs(c, np.maximum(first, c - width + 1), np.minimum(end, c + width))]
            for i in back:
                whole = (c - i >= first) & (c - i + width <= end)
                keys.append(np.where(whole, runs(c, np.maximum(c - i, 0), np.minimum(c - i + width, len(base))), np.uint64(0)))
            up = np.uint64(32)
            place = (l - first).astype(np.uint64) << up | (c - first).astype(np.uint64)
            right = (r - first).astype(np.uint64) << np.uint64(8) | np.uint64(k)
            longs = [h[c], docs[d].astype(np.int64).view(np.uint64), place, right, keys[0] << up | keys[1], keys[2] << up | keys[3]]
            found.append(np.stack(longs, 1).view(np.int64))
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in text_blocks(texts):
                w = block(texts[part], docs[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, i])) for i in range(len(WINDOW))], names=list(WINDOW))

    return run


LINK = ("hid", "doc", "l", "c", "r", "odoc", "ol", "oc", "orr")
#: Rows that are worked on at once where rows are short.
BLOCK = 65_536


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[np.ndarray]:
    """The batches' columns as longs, in blocks of BLOCK rows or a little more."""

    def joined(held: list[pa.RecordBatch]) -> np.ndarray:
        t = pa.Table.from_batches(held)
        return np.stack([t.column(c).cast(pa.int64()).to_numpy() for c in columns], 1)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield joined(held)
            held = []
    if held:
        yield joined(held)


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[np.ndarray, bool]]:
    """Rows sorted by their first column, in whole groups; of a group over BLOCK rows pieces of BLOCK rows, True while more come.

    What is yielded does not depend on how the rows came in batches.
    """
    held = np.zeros((0, len(columns)), np.int64)
    for w in _blocks(batches, columns):
        held = np.concatenate([held, w])
        while len(held) > BLOCK:
            last = int(np.searchsorted(held[:, 0], held[-1, 0], "left"))
            n = last or BLOCK
            yield held[:n], not last
            held = held[n:]
    if len(held):
        yield held, False


def _batch(rows: np.ndarray, columns: tuple[str, ...]) -> pa.RecordBatch:
    types = [pa.int64() if c in ("grp", "doc", "odoc", "place") else pa.int32() for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i], pa.int64()).cast(t) for i, t in enumerate(types)], names=list(columns))


FIRST = ("grp", *LINK, "place")


def _first_of(keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For each row the first with the same keys (rows); itself where it is not valid."""
    out = np.arange(len(valid))
    at = np.nonzero(valid)[0]
    if len(at):
        at = at[np.lexsort(keys[at].T)]
        new = np.concatenate([[True], (keys[at[1:]] != keys[at[:-1]]).any(1)])
        out[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    return out


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by group and document: links to the first that shares a run, and the firsts of groups with several.

    A link has place -1; a first its number in its group.
    """
    going = 0  # firsts that were yielded of a group whose rows are not at their end
    for w, more in _groups(batches, WINDOW):
        g = np.concatenate([[0], np.nonzero(w[1:, 0] != w[:-1, 0])[0] + 1])
        size = np.diff(np.concatenate([g, [len(w)]]))
        large = size > 1
        if going or more:
            large[0] = True
        w, size = w[np.repeat(large, size)], size[large]
        if not len(w):
            continue
        doc, first, root, pairs = w[:, 1], np.ones(len(w), bool), np.arange(len(w)), []
        for key in (w[:, 4] >> 32 & LOW, w[:, 4] & LOW, w[:, 5] >> 32 & LOW, w[:, 5] & LOW):
            of = _first_of(np.stack([w[:, 0], key], 1), key != 0)
            other = of != np.arange(len(w))
            first &= ~other
            at = np.nonzero(other)[0]
            a, b = find(root, at), find(root, of[at])
            at = at[a != b]
            at = at[np.unique(np.stack([a, b], 1)[a != b], axis=0, return_index=True)[1]]  # one link joins two trees
            _united(root, at, of[at])
            at = at[doc[at] != doc[of[at]]]
            pairs.append(np.stack([at, of[at]], 1))
        pairs = np.concatenate(pairs)
        f = np.stack([w[:, 3] & 255, doc, w[:, 2] >> 32, w[:, 2] & LOW, w[:, 3] >> 8], 1)
        grp, n = w[:, :1], len(pairs)
        out = [np.concatenate([grp[pairs[:, 0]], f[pairs[:, 0]], f[pairs[:, 1], 1:], np.full((n, 1), -1)], 1)]
        g = np.concatenate([[0], np.cumsum(size)[:-1]])
        firsts = np.add.reduceat(first.astype(np.int64), g)
        place = np.cumsum(first) - 1 - np.repeat(np.cumsum(firsts) - firsts, size)
        several = np.minimum.reduceat(np.where(first, doc, np.iinfo(np.int64).max), g) != np.maximum.reduceat(np.where(first, doc, np.iinfo(np.int64).min), g)
        if going or more:
            several[0] = True
            place[: size[0]] += going
            going = going + int(firsts[0]) if more else 0
        at = np.nonzero(first & np.repeat(several, size))[0]
        out.append(np.concatenate([grp[at], f[at], np.zeros((len(at), 4), np.int64), place[at, None]], 1))
        rows = np.concatenate(out)
        if len(rows):
            yield _batch(rows, FIRST)


def _lists(column: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The row that each element of a column of lists of structs is in, and its fields as longs."""
    flat = column.flatten()
    of = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
    return of, np.stack([flat.field(x).cast(pa.int64()).to_numpy(zero_copy_only=False) for x in names], 1) if len(flat) else np.zeros((0, len(names)), np.int64)


def _pieces(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of the bytes of data, sizes[i] numbers of it for row i."""
    ends = np.concatenate([[0], np.cumsum(sizes * data.itemsize)])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


#: Rows of pairs of tiles that are compared at once (more if one pair has more, up to two tiles).
TILES_BLOCK = 8192
ASKED = ("grp", "hid", "l", "c", "r", "tile", "tiles")


def _around(width: int):
    """A document's firsts with the shingles around their centres, as 16-bit hashes (0 past the text's ends)."""
    reach = np.arange(-width + 1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in text_blocks(texts):
                s = Shingled(texts[part])
                short = (s.base >> np.uint64(48)).astype("<u2") | np.uint16(1)
                rows = batch.slice(part.start, part.stop - part.start)
                of, f = _lists(rows.column("firsts"), ASKED)
                ok = f[:, 3] < s.sizes[of]  # where an id is repeated, its other text may be shorter
                of, f = of[ok], f[ok]
                docs = rows.column("doc").to_numpy()
                for i in range(0, len(of), TILES_BLOCK):
                    o, g = of[i : i + TILES_BLOCK], f[i : i + TILES_BLOCK]
                    at = g[:, 3:4] + reach
                    inside = (at >= 0) & (at < s.sizes[o][:, None])
                    x = np.where(inside, short[np.where(inside, at + s.starts[o][:, None], 0)], np.uint16(0)).astype("<u2")
                    cols = [pa.array(np.ascontiguousarray(g[:, j])) for j in range(len(ASKED))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(docs[o]), _pieces(x, np.full(len(o), len(reach)))], names=[*ASKED, "doc", "part"])

    return run


def _sums(hit: np.ndarray) -> np.ndarray:
    """Hits in the first 0, 1, ... rows, by column; a pair of contexts has a column, which numpy reduces many of at once."""
    return np.concatenate([np.zeros((1, hit.shape[1]), np.int16), np.cumsum(hit, 0, dtype=np.int16)])


def _share(hit: np.ndarray, least: int) -> np.ndarray:
    """The greatest share of hits in any stretch of least rows or more, by column."""
    total = _sums(hit)
    best = np.zeros(hit.shape[1], np.float32)
    for n in range(least, min(2 * least, len(hit) + 1)):  # a longer stretch has one of these with as great a share
        best = np.maximum(best, (total[n:] - total[:-n]).max(0) / np.float32(n))
    return best


def _aligned(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows hold near-duplicate passages at equal distances from their centres, and which may at others.

    A pair that shares nothing but what stands at equal distances has no passage put together in another way, and one
    that shares less than the shortest passage needs has none.
    """
    hit, share = np.ascontiguousarray(((x == y) & (x > 0)).T), 2 * similarity / (1 + similarity)
    total = _sums(hit)
    out = np.zeros(len(x), bool)
    for n in range(least, len(hit) + 1):
        out |= (total[n:] - total[:-n]).max(0) >= share * n
    rest = np.nonzero(~out)[0]
    both = np.sort(np.concatenate([x[rest], y[rest]], 1), axis=1, kind="stable")
    shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] > 0)).sum(1)
    return out, rest[(shared > total[-1, rest]) & (shared >= similarity * least)]


def _possible(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Which pairs of rows can hold near passages: the shares found of both sides bound the Jaccard similarity."""
    out, short = [np.zeros(0, bool)], int(similarity * least)
    for i in range(0, len(x), 256):
        a, b = np.ascontiguousarray(x[i : i + 256].T), np.ascontiguousarray(y[i : i + 256].T)
        b[b == 0] = 2  # hashes are odd, so this is none of the other side's
        in_b, in_a = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
        for k, row in enumerate(b):
            same = a == row
            in_b |= same
            np.logical_or.reduce(same, 0, out=in_a[k])
        a, b = _share(in_b, short), _share(in_a, short)
        out.append(1 / np.maximum(a, 1e-3) + 1 / np.maximum(b, 1e-3) <= 1 + 1 / similarity + 1e-3)
    return np.concatenate(out)


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) join what root has apart; afterwards root has all of them joined."""
    root[:] = find(root, np.arange(len(root)))
    news = root[a] != root[b]
    a, b = a[news], b[news]
    while len(a):
        ra, rb = find(root, a), find(root, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
    return news


def _tile_links(pair: np.ndarray, side: np.ndarray, w: np.ndarray, x: np.ndarray, least: int, similarity: float) -> np.ndarray:
    """Links (LINK's columns) that join the windows of each pair of tiles whose contexts hold near-duplicate passages."""
    n, root, out = len(w), np.arange(len(w)), []

    def link(p: np.ndarray, q: np.ndarray) -> None:
        p, q = (np.where(w[p, 1] > w[q, 1], p, q), np.where(w[p, 1] > w[q, 1], q, p))
        keep = w[p, 1] != w[q, 1]
        out.append(np.concatenate([w[p[keep]], w[q[keep], 1:]], 1))

    total = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(x * np.cumprod(np.full(x.shape[1], _MIX)), 1, dtype=np.uint64)], 1)
    gaps = np.concatenate([np.zeros((n, 1), np.int16), np.cumsum(x == 0, 1, dtype=np.int16)], 1)
    own = mix(pair.view(np.uint64))
    for i in range(x.shape[1] - least + 1):
        of = _first_of((own + mix(total[:, i + least] - total[:, i])).view(np.int64)[:, None], gaps[:, i + least] == gaps[:, i])
        at = np.nonzero(of != np.arange(n))[0]
        at = at[_united(root, at, of[at])]
        link(at, of[at])
    signs = _signatures(x)
    for p, q in _near(pair, side, w[:, 1], signs, root, similarity * least - SLACK):
        ok, rest = _aligned(x[p], x[q], least, similarity)
        at = np.nonzero(ok)[0]
        at = at[_united(root, p[at], q[at])]
        link(p[at], q[at])
        at = rest[find(root, p[rest]) != find(root, q[rest])]
        at = at[_possible(x[p[at]], x[q[at]], least, similarity)]
        for i, j in zip(p[at].tolist(), q[at].tolist(), strict=True):
            if (e := find(root, np.array([i, j])))[0] != e[1] and _matches(x[i][x[i] > 0], x[j][x[j] > 0], least, similarity):
                link(np.array([i]), np.array([j]))
                root[e.max()] = e.min()
    return np.concatenate(out) if out else np.zeros((0, len(LINK)), np.int64)


#: Shared shingles of a context that may fall into buckets that others of it have.
SLACK = 4


def _signatures(x: np.ndarray) -> np.ndarray:
    """Rows of bits for the buckets that a context's shingles fall into."""
    bucket = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    bits = np.zeros(len(x) * BUCKETS + 1, bool)
    at = bucket[x] + np.arange(0, len(x) * BUCKETS, BUCKETS)[:, None]
    at[x == 0] = len(x) * BUCKETS  # no shingle: beside the rows
    bits[at] = True
    return np.packbits(bits[:-1].reshape(-1, BUCKETS), axis=1).view(np.uint64)


#: Pairs of windows that are compared at once, and rows under which all pairs of a pair of tiles are.
PAIRS, FEW = 4096, 48


def _near(pair: np.ndarray, side: np.ndarray, doc: np.ndarray, signs: np.ndarray, root: np.ndarray, enough: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that root does not join and that share enough shingles; root may change from yield to yield."""
    root[:] = find(root, np.arange(len(root)))
    kind = np.min_scalar_type(int(np.bitwise_count(signs).sum(1).max(initial=0)))  # bytes add fastest
    starts = np.concatenate([np.zeros(min(1, len(pair)), np.int64), np.nonzero(pair[1:] != pair[:-1])[0] + 1])
    sizes = np.diff(np.concatenate([starts, [len(pair)]]))
    several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts) if len(starts) else np.zeros(0, bool)
    starts, sizes = starts[several], sizes[several]
    meets = lambda p, q: (doc[p] != doc[q]) & ((side[p] == 1) | (side[p] != side[q])) & (root[p] != root[q])
    few = sizes < FEW
    yield from _of_few(starts[few], sizes[few], signs, meets, enough)
    for i, j in zip(starts[~few].tolist(), (starts + sizes)[~few].tolist(), strict=True):
        r = root[i:j]
        largest = int(np.bincount(r - i).argmax()) + i
        rest = i + np.nonzero(r != largest)[0]  # of two windows that are apart one at least is here
        late = np.full(j - i, len(pair))  # rows of rest come in turn, and meet those before them only in their turn
        late[rest - i] = np.arange(len(rest))
        words = np.ascontiguousarray(signs[i:j].T)
        k, step = 0, 1
        while k < len(rest):  # few at first: what they join need not be compared
            rows = rest[k : k + step]
            k, step = k + len(rows), min(2 * step, 64)
            root[i:j] = find(root, np.arange(i, j))
            most = root[i:j] == root[largest]
            rows = rows[~most[rows - i]]  # what has joined the largest meets the others in their turn
            if not len(rows):
                continue
            cols = np.nonzero(most | (late > late[rows[0] - i]))[0]
            shared = np.zeros((len(rows), len(cols)), kind)
            for word in words:
                shared += np.bitwise_count(word[rows - i][:, None] & word[cols])
            now = root[i:j]
            p, q = np.nonzero((shared >= enough) & (now[rows - i][:, None] != now[cols]))
            p, q = rows[p], cols[q] + i
            keep = meets(p, q) & ((late[q - i] > late[p - i]) | most[q - i])
            yield from _chunks(p[keep], q[keep])


def _of_few(starts: np.ndarray, sizes: np.ndarray, signs: np.ndarray, meets: Callable, enough: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What _near() gives for pairs of tiles of few rows, many at a time; the pairs of one stay together."""
    cuts = np.searchsorted(np.cumsum(sizes * (sizes - 1) // 2), np.arange(0, int((sizes * (sizes - 1) // 2).sum()) + 1, 16 * PAIRS), "left")
    cuts = np.unique(np.concatenate([[0], cuts, [len(sizes)]]))
    for i, j in zip(cuts, cuts[1:], strict=False):  # some at a time
        of, p, q = [], [], []
        for m in np.unique(sizes[i:j]).tolist():
            at = i + np.nonzero(sizes[i:j] == m)[0]
            a, b = np.triu_indices(m, 1)
            of.append(np.repeat(at, len(a)))
            p.append((starts[at][:, None] + a).ravel())
            q.append((starts[at][:, None] + b).ravel())
        of, p, q = map(np.concatenate, (of, p, q))
        for keep in (lambda: meets(p, q), lambda: np.bitwise_count(signs[p] & signs[q]).sum(1) >= enough):
            ok = keep()
            of, p, q = of[ok], p[ok], q[ok]
        order = np.argsort(of, kind="stable")
        of, p, q = of[order], p[order], q[order]
        at = 0
        while at < len(of):
            end = int(np.searchsorted(of, of[min(at + PAIRS, len(of)) - 1], "right"))
            yield p[at:end], q[at:end]
            at = end


def _chunks(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(p), PAIRS):
        yield p[i : i + PAIRS], q[i : i + PAIRS]


def _tiles(least: int, similarity: float):
    """Sorted by pair of tiles: its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in ("pair", "side", *LINK[:5])], 1)
            x = np.frombuffer(b"".join(batch.column("part").to_pylist()), "<u2").reshape(len(w), -1)
            w, x = (w, x) if held is None else (np.concatenate([held[0], w]), np.concatenate([held[1], x]))
            while len(w) > TILES_BLOCK:
                n = int(np.searchsorted(w[:, 0], w[TILES_BLOCK, 0], "left"))  # a pair's rows stay together
                n = n or int(np.searchsorted(w[:, 0], w[0, 0], "right"))
                if n == len(w):
                    break
                yield from done(w[:n], x[:n])
                w, x = w[n:], x[n:]
            held = w, x
        if held is not None:
            yield from done(*held)

    def done(w: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = _tile_links(w[:, 0], w[:, 1], w[:, 2:], x, least, similarity)
        if len(links):
            yield _batch(links, LINK)

    return run


def _joined(agree: int):
    """Sorted by pair: intervals of two documents where links of enough hashes overlap on about one diagonal."""
    names = ("doc", "lo", "hi", "odoc", "olo", "ohi", "shift")

    def one(g: np.ndarray) -> list[tuple]:  # hid, doc, l, c, r, odoc, ol, oc, or
        if len(g) < agree:
            return []
        out = []
        g = g[np.argsort(g[:, 3] - g[:, 7], kind="stable")]
        diag = g[:, 3] - g[:, 7]
        for part in np.split(g, np.nonzero(np.diff(diag) > SHIFT)[0] + 1):
            part = part[np.argsort(part[:, 2], kind="stable")]
            ends = np.maximum.accumulate(part[:, 4])
            for p in np.split(part, np.nonzero(part[1:, 2] > ends[:-1])[0] + 1):
                if len(np.unique(p[:, 0])) >= agree:
                    shift = int(np.sort(p[:, 3] - p[:, 7])[len(p) // 2])
                    out.append((p[0, 1], p[:, 2].min(), p[:, 4].max(), p[0, 5], p[:, 6].min(), p[:, 8].max(), shift))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for w in _blocks(batches, LINK):
            w = w if held is None else np.concatenate([held, w])
            cuts = np.nonzero((w[1:, 1] != w[:-1, 1]) | (w[1:, 5] != w[:-1, 5]))[0] + 1
            *full, held = np.split(w, cuts)
            out = [x for g in full for x in one(g)]
            if out:
                yield _batch(np.array(out, np.int64), names)
        if held is not None and (out := one(held)):
            yield _batch(np.array(out, np.int64), names)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's asked intervals with their shingles, each as often as its salts say."""
    names = ("lo", "hi", "salts")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in text_blocks(texts):
            s = Shingled(texts[part])
            have = (s.base >> np.uint64(32)).astype("<u4")
            rows = batch.slice(part.start, part.stop - part.start)
            of, f = _lists(rows.column("asked"), names)
            docs = rows.column("doc").to_numpy()
            n = np.minimum(f[:, 1] + 1, s.sizes[of]) - np.minimum(f[:, 0], s.sizes[of])
            cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + 1, BYTES), "left") if len(n) else np.zeros(0, np.int64)
            cuts = np.unique(np.concatenate([[0], cuts, [len(n)]]))
            for i, j in zip(cuts, cuts[1:], strict=False):  # some intervals at a time
                data = [have[b + lo : b + lo + k] for b, lo, k in zip(s.starts[of[i:j]].tolist(), f[i:j, 0].tolist(), n[i:j].tolist(), strict=True)]
                cols = [pa.array(np.ascontiguousarray(f[i:j, k])) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(docs[of[i:j]]), _pieces(np.concatenate(data), n[i:j])], names=[*names, "doc", "part"])


def _longest(hit: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch that begins and ends with a hit and has at least this share of hits."""
    ends = np.nonzero(hit)[0] + 1
    if not len(ends):
        return 0, 0
    gain = np.concatenate([[0.0], np.cumsum(np.where(hit, 1.0, -share / (1 - share)))])
    low = np.minimum.accumulate(np.where(hit, gain[:-1], np.inf))
    starts = np.searchsorted(-low, -gain[ends] - 1e-9, "left")
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


def matched(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches of a and b (start, end, start, end, Jaccard) of least shingles that agree in similarity at least.

    Stretches of a are looked up in b, then those of b in a; the second adds what lies on a new place of either side.
    """
    out = _matched(a, b, least, similarity)
    for s, e, s2, e2, jac in _matched(b, a, least, similarity):
        if e2 - s2 >= least and not any(x <= s2 and e2 <= y and x2 <= s and e <= y2 for x, y, x2, y2, _ in out):
            out.append((s2, e2, s, e, jac))
    return out


def _matches(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> bool:
    """Whether matched() finds any."""
    return bool(_matched(a, b, least, similarity)) or any(e2 - s2 >= least for _, _, s2, e2, _ in _matched(b, a, least, similarity))


def _in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.isin, without its overhead for short arrays."""
    return (a[:, None] == b).any(1) if len(a) * len(b) < 1 << 15 else np.isin(a, b)


def _matched(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    out, todo = [], [(0, len(a))]
    in_b = _in(a, b)
    # the containment that this Jaccard needs where both sides lose alike, and the least it allows where one side does
    shares = [2 * similarity / (1 + similarity), similarity]
    while todo:
        i, j = todo.pop()
        if j - i < least:
            continue
        failed, hits = None, np.count_nonzero(in_b[i:j])
        for share in shares:
            if hits < share * least - 1e-6:  # too few for any stretch
                continue
            s, e = (i + x for x in _longest(in_b[i:j], share))
            if e - s < least:
                continue
            best = _densest(np.nonzero(_in(b, a[s:e]))[0], e - s)
            x, y = np.unique(a[s:e]), np.unique(b[best[0] : best[1]])
            both = len(np.intersect1d(x, y, assume_unique=True))
            jac = both / (len(x) + len(y) - both)
            if jac >= similarity:
                out.append((s, e, *best, jac))
                todo += [(i, s), (e, j)]
                break
            failed = failed or (s, e)
        else:
            if failed is None:
                continue
            s, e = failed
            if not in_b[s:e].all():  # its longest unbroken run still may
                stops = np.concatenate([[s - 1], s + np.nonzero(~in_b[s:e])[0], [e]])
                k = int(np.argmax(np.diff(stops)))
                todo += [(s, int(stops[k]) + 1), (int(stops[k]) + 1, int(stops[k + 1])), (int(stops[k + 1]), e)]
            todo += [(i, s), (e, j)]
    return out


def _matched_along(a: np.ndarray, b: np.ndarray, shift: int, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """What matched() gives where a[i] stands for b[i - shift]: changed words, but none put in or left out."""
    i, j = max(0, shift), min(len(a), len(b) + shift)
    if j - i < least:
        return []
    hit, share = a[i:j] == b[i - shift : j - shift], 2 * similarity / (1 + similarity)
    out, todo = [], [(0, j - i)]
    while todo:
        x, y = todo.pop()
        if y - x < least or np.count_nonzero(hit[x:y]) < share * least - 1e-6:  # too few for any stretch
            continue
        s, e = (x + z for z in _longest(hit[x:y], share))
        if e - s < least:
            continue
        if hit[s:e].all():
            jac = 1.0
        else:
            u, v = np.unique(a[i + s : i + e]), np.unique(b[i + s - shift : i + e - shift])
            both = len(np.intersect1d(u, v, assume_unique=True))
            jac = both / (len(u) + len(v) - both)
        if jac >= similarity:
            out.append((i + s, i + e, i + s - shift, i + e - shift, jac))
        todo += [(x, s), (e, y)]
    return out


def _densest(at: np.ndarray, n: int) -> tuple[int, int] | None:
    """The span of at most about n that holds the most of the positions at."""
    if not len(at):
        return None
    ends = np.searchsorted(at, at + int(n * 1.2) + 1, "left")
    k = int(np.argmax(ends - np.arange(len(at))))
    return int(at[k]), int(at[ends[k] - 1]) + 1


def _verified(least: int, similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            out = []
            for cid, side, doc, lo, shift, part in zip(pdf["cid"], pdf["side"], pdf["doc"], pdf["lo"], pdf["shift"], pdf["part"], strict=True):
                if held is None or held[0] != cid or held[1] == side:
                    held = (cid, side, doc, lo, part)
                    continue
                a, b = np.frombuffer(held[4], "<u4"), np.frombuffer(part, "<u4")
                found = _matched_along(a, b, shift - held[3] + lo, least, similarity)
                for s, e, os_, oe, jac in found or matched(a, b, least, similarity):
                    out.append((held[2], held[3] + s, held[3] + e + SHINGLE - 1, doc, lo + os_, lo + oe + SHINGLE - 1, jac))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "start_word", "end_word", "other_id", "other_start", "other_end", "similarity"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, hashes: int = HASHES, agree: int = AGREE, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of passage words or more that near-duplicate one of another document.

    Columns: doc_id, start_word, end_word (exclusive), other_id, other_start, other_end, similarity, class_id (smallest
    doc_id that repeated passages join, over any number of them).  Each row ties a passage to one of an earlier document
    (a smaller id); copies are not expanded into all pairs, and of several that a passage could be tied to the first by
    id stands for them.  The rows depend on the texts alone, not on batches or partitions, but for minima with over BLOCK
    windows.  Words are split at white space, A-Z lower-cased.  Null or short text: no passages.  Very long texts are
    hashed and cut in blocks of BYTES.  Rows with a null id, and repetitions inside one id, are not linked; rows that
    repeat an id count as one document.  Empty table: no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    width = passage - SHINGLE + 1
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ints = "hid int, doc long, l int, c int, r int, odoc long, ol int, oc int, orr int"
    made = d.mapInArrow(_windows(width, hashes), ", ".join(f"{x} long" for x in WINDOW))
    firsts = cut(made.repartition(n, "grp").sortWithinPartitions("grp", "doc", "lc").mapInArrow(_firsts, f"grp long, {ints}, place long"))
    equal = firsts.where("place < 0").select(*LINK)
    apart = firsts.where("place >= 0").withColumn("tile", F.floor(F.col("place") / TILE))
    # tiles of the minima that have several; joined by tile, so that no key has more rows than a tile
    many = apart.groupBy("grp").agg(F.max("tile").alias("last")).where("last > 0")
    many = many.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("tile"), (F.col("last") + 1).alias("tiles"))
    apart = apart.join(many, ["grp", "tile"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    asked = apart.groupBy("doc").agg(F.collect_list(F.struct("grp", "hid", "l", "c", "r", "tile", "tiles")).alias("firsts"))
    around = asked.join(d, "doc").mapInArrow(_around(width), "grp long, hid long, l long, c long, r long, tile long, tiles long, doc long, part binary")
    # every window of a minimum with t tiles goes to the t pairs of tiles that hold its own
    mine = F.col("tile")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least(o, mine).alias("a"), F.greatest(o, mine).alias("b"), F.when(o == mine, 1).when(mine < o, 0).otherwise(2).alias("side")))
    spread = around.withColumn("t", F.explode(pairs)).select(F.xxhash64("grp", "t.a", "t.b").alias("pair"), F.col("t.side").alias("side"), *(F.col(x).cast("long" if x == "doc" else "int").alias(x) for x in LINK[:5]), "part")
    near = spread.repartition(n, "pair").sortWithinPartitions("pair", "doc", "c", "l").mapInArrow(_tiles(width, similarity), ints)
    links = cut(equal.unionByName(near))
    drop_cut(firsts)
    pairs = links.repartition(n, "doc", "odoc").sortWithinPartitions("doc", "odoc", "hid", "c", "oc").mapInArrow(_joined(agree), "doc long, lo int, hi int, odoc long, olo int, ohi int, shift int")
    asked = cut(pairs.withColumn("cid", F.monotonically_increasing_id()))
    drop_cut(links)
    both = asked.select("cid", F.lit(0).alias("side"), "doc", "lo", "hi", "shift").unionByName(asked.select("cid", F.lit(1).alias("side"), F.col("odoc").alias("doc"), F.col("olo").alias("lo"), F.col("ohi").alias("hi"), "shift"))
    # an interval that many pairs ask for is cut once and joined over salts; such intervals are few, by their bound
    over = max(HUB_LEAST, int(2 * asked.count() * HUB_SHARE))
    times = both.groupBy("doc", "lo", "hi").agg(F.ceil(F.count("*") / over).alias("salts"))
    salted = F.broadcast(times.where("salts > 1"))
    per_doc = times.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "salts")).alias("asked"))
    parts = per_doc.join(d, "doc").mapInArrow(_slices, "lo long, hi long, salts long, doc long, part binary")
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    both = both.join(salted, ["doc", "lo", "hi"], "left").withColumn("salt", F.pmod(F.xxhash64("cid"), F.coalesce("salts", F.lit(1).cast("long")))).drop("salts")
    parts = both.join(parts, ["doc", "lo", "hi", "salt"]).select("cid", "side", "doc", "lo", "shift", "part")
    out = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, similarity double"
    found = cut(parts.repartition(n, "cid").sortWithinPartitions("cid", "side").mapInPandas(_verified(width, similarity), out).distinct())
    drop_cut(asked)
    comp = connected_components(found.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b")))
    return found.join(comp.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")), "doc_id")
