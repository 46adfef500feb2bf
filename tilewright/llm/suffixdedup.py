"""Suffix-array dedup: remove bytes covered by LENGTH-byte strings that also start in a smaller document.

Shards by content. In each window of LENGTH bytes one gram of GRAM bytes has the least hash: its anchor. Equal strings
have equal anchors, so a string can only repeat under its anchor. Anchors found in one document alone are put aside
first; around every other the bytes of all windows that it anchors, its segment, go to the anchor's shard. Windows of an
anchor that very many documents have are told apart by a second anchor, under another order of hashes. Equal segments of
a block of documents meet before that: all but the least document's are covered whole and go no further.

Within a shard. Distinct segments are concatenated; a suffix array is refined by prefix doubling in the manner of
Larsson and Sadakane, re-sorting only groups that are not yet settled, until LENGTH bytes are in order; Kasai's pass gives
the common prefixes of neighbours, along the text in many lanes at once. Neighbours that share LENGTH bytes are one
string, and the least document under it is its owner. An anchor with more segments than a shard holds is worked off in
shards of ascending documents; the strings of earlier shards are found by binary search, byte for byte, in the sorted
table that these leave behind.

Cases: null counts as empty; texts shorter than LENGTH keep everything; very long texts are read whole; strings are judged
on the input, not on what is left; rows that share a doc_id never remove each other's bytes; null doc_ids come before all
others; the smallest doc_id keeps what ties; repeated rows give repeated results; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, ready
from .words import CHUNK, _power, mix

LENGTH, GRAM = 50, 24
#: Bytes of distinct segments in one suffix array.
SHARD = 1_000_000
#: Anchors that a task holds before it hands them on.
HELD = 1_000_000
#: An anchor in so many documents is split by a second one.
HOT = 20_000
#: Places in the text at which Kasai's pass starts.
LANES = 4096
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_NONE = np.int64(-(2**63))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k bytes."""
    n = len(data)
    if n < k:
        return np.zeros(0, np.uint64)
    if len(_powers.get("up", ())) < n + 1:
        _powers["up"], _powers["down"] = _power(max(n + 1, CHUNK + 100_000), _BASE), _power(max(n + 1, CHUNK + 100_000), _INVERSE)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers["up"][:n], out=run[1:])
    h = (run[k:] - run[:-k]) * _powers["down"][: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts joined: hash of each anchor, its text, and the first and the end of the windows it anchors; the joined bytes. Each turn has another order."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    h, w = gram_hashes(data, gram), length - gram + 1
    h = mix(h + np.uint64(turn)) if turn else h
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return np.zeros(0, np.uint64), none, none, none, data
    low, size = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1  # the least, the leftmost on ties
    while 2 * size <= w:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - (w - size)], low[w - size :]) if size < w else low
    room = np.repeat(first + sizes, sizes)[: len(low)] - np.arange(len(low)) >= length
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~room[:-1]
    starts = np.flatnonzero(new & room)
    stop_at = np.flatnonzero(new | ~room)
    ends = np.append(stop_at, len(low))[np.searchsorted(stop_at, starts, "right")]
    text = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(ends, first[text] + sizes[text] - length + 1)
    # A text's first window may carry the anchor of a window of the text before: it still begins a range of its own.
    return h[(low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)], text, starts, ends, data


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Positions of data in the order of their first bytes, and of how many, depth or more; bytes past the end are less than any."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 9 bits each
        key = key << np.uint64(9) | padded[i : i + n]
    order, h = np.argsort(key, kind="stable"), 7
    rank = np.empty(n, np.int64)
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while h < depth:
        single = head & np.append(head[1:], True)
        at = np.flatnonzero(~single)  # only groups that are not settled are sorted again
        if not len(at):
            return order, n
        pos = order[at]
        after = pos + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[pos].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        turn = np.argsort(both, kind="stable")
        both, pos = both[turn], pos[turn]
        order[at] = pos
        differs = np.ones(len(at), bool)
        differs[1:] = both[1:] != both[:-1]
        head[at] = differs
        rank[pos] = at[np.maximum.accumulate(np.where(differs, np.arange(len(at)), 0))]
        h *= 2
    return order, h


def words_at(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place as one number; zeros past the end."""
    full = np.concatenate([data, np.zeros(64, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(full, 8)[: len(data) + 56].copy().view(order).ravel()


def common_prefixes(data: np.ndarray, order: np.ndarray, sorted_depth: int, depth: int, lanes: int = LANES) -> np.ndarray:
    """For each place in the suffix array, how many bytes it shares with the one before it, as far as depth (Kasai).

    Along the text a common prefix is at most one shorter than the last one's, so only what follows is compared, eight
    bytes at once. Many lanes run side by side, each from a place of its own. As suffixes are in order of their first
    sorted_depth bytes only, a prefix that is as long says nothing of the next.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    words, out = words_at(data), np.zeros(n, np.int32)
    each = max(1, -(-n // lanes))
    starts, h = np.arange(0, n, each), np.zeros(-(-n // each), np.int64)
    most = depth if sorted_depth >= n else sorted_depth  # whether a prefix is as long as the order knows has to be seen
    for t in range(each):
        i = starts + t
        i = i[i < n]
        h = h[: len(i)]
        j = before[i]
        room = np.minimum(most, n - np.maximum(i, j))
        h = np.where((h >= sorted_depth) | (j < 0), 0, np.maximum(h - 1, 0))
        left = np.flatnonzero((j >= 0) & (h < room))
        while len(left):
            x = words[i[left] + h[left]] ^ words[j[left] + h[left]]
            same = x == 0
            low = x & (~x + np.uint64(1))  # the lowest bit that differs
            h[left] += np.where(same, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            left = left[same & (h[left] < room[left])]
        h = np.minimum(h, np.maximum(room, 0))
        out[i] = h
    return np.minimum(out, depth)[order]


def strings_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """[places, words]: the length bytes from each place, as numbers in their order."""
    words = words_at(data, ">u8")
    return np.stack([words[at + k] for k in [*range(0, length - 8, 8), length - 8]], 1).astype(np.uint64)


def search(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where each row is in the sorted table, or -1: binary search over all bytes."""
    lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(table))
    while (lo < hi).any():
        middle = (lo + hi) >> 1
        at = table[np.minimum(middle, len(table) - 1)]
        differs = at != rows
        first = differs.argmax(1)[:, None]
        less = differs.any(1) & (np.take_along_axis(at, first, 1) < np.take_along_axis(rows, first, 1)).ravel()
        lo, hi = np.where((lo < hi) & less, middle + 1, lo), np.where((lo < hi) & ~less, middle, hi)
    found = (lo < len(table)) & (table[np.minimum(lo, len(table) - 1)] == rows).all(1)
    return np.where(found, lo, -1)


class Shard:
    """Segments of some anchors, rows in the order (anchor, doc)."""

    def __init__(self, length: int):
        self.length = length
        self.kept: tuple[int | None, np.ndarray, np.ndarray] = (None, np.zeros((0, 1), np.uint64), np.zeros(0, np.int64))
        self.clear()

    def clear(self):
        self.index, self.least, self.anchor, self.size = {}, [], [], 0
        self.rows: list[tuple[int, int, int]] = []

    def add(self, anchor: int, doc: int, start: int, segment: bytes):
        k = self.index.get((anchor, segment))
        if k is None:
            k = self.index[anchor, segment] = len(self.least)
            self.least.append(doc)
            self.anchor.append(anchor)
            self.size += len(segment)
        self.rows.append((k, doc, start))

    def spans(self, going_on: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, begin, end) of what is covered; going_on: the anchor that the next shard goes on with."""
        length, segments = self.length, [s for _, s in self.index]
        data = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.array([len(s) for s in segments])
        first = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(segments)), sizes)
        window = np.arange(len(data)) <= (first + sizes - length)[seg]
        order, depth = suffix_array(data, length)
        shared = common_prefixes(data, order, depth, length)
        keep = np.flatnonzero(window[order])
        # Between two windows the least of the common prefixes in between counts.
        new = np.minimum.reduceat(shared[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1])) < length if len(keep) else np.zeros(0, bool)
        order, new[:1] = order[keep], True
        least = np.array(self.least, np.int64)
        heads = np.flatnonzero(new)
        owner = np.empty(len(data), np.int64)
        owner[order] = np.minimum.reduceat(least[seg[order]], heads)[np.cumsum(new) - 1]
        anchor = np.array(self.anchor, np.int64)
        name, known, owners = self.kept
        if name is not None and len(known):
            mine = np.flatnonzero(window & (anchor == name)[seg])
            at = search(known, strings_at(data, mine, length))
            hit = at >= 0
            owner[mine[hit]] = np.minimum(owner[mine[hit]], owners[at[hit]])
        if going_on is None:
            self.kept = (None, known[:0], owners[:0])
        else:
            mine = np.flatnonzero(window & (anchor == going_on)[seg])
            keys, docs = strings_at(data, mine, length), owner[mine]
            if name == going_on:
                keys, docs = np.concatenate([known, keys]), np.concatenate([owners, docs])
            turn = np.lexsort((docs, *keys.T[::-1]))
            keys, docs = keys[turn], docs[turn]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]).any(1)
            self.kept = (going_on, keys[once], docs[once])
        # The rows of a segment's least document have what others own; all rows of later ones are covered whole.
        k, doc, start = (np.array(x, np.int64) for x in zip(*self.rows, strict=True))
        full = doc > least[k]
        out = [(doc[full], start[full], start[full] + sizes[k[full]])]
        taken = np.flatnonzero(window & (owner < least[seg]))
        if len(taken):
            cut = np.ones(len(taken), bool)
            cut[1:] = (taken[1:] != taken[:-1] + 1) | (seg[taken[1:]] != seg[taken[:-1]])
            a, b = taken[cut], taken[np.append(np.flatnonzero(cut)[1:], len(taken)) - 1] + length
            of = seg[a]
            part = np.flatnonzero(~full)
            lo, hi = np.searchsorted(of, k[part]), np.searchsorted(of, k[part], "right")
            many = hi - lo
            run = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            row = np.repeat(part, many)
            out.append((doc[row], start[row] + a[run] - first[of[run]], start[row] + b[run] - first[of[run]]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))


def _by_block(block: np.ndarray, fields: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(block, kind="stable")
    block, fields = block[order], fields[order]
    at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True):
        yield int(block[a]), fields[a:b].tobytes()


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of sorted (begin, end) rows."""
    out: list[list[int]] = []
    for a, b in spans.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _runs(blocks: np.ndarray, counts: np.ndarray, values: np.ndarray) -> bytes:
    return np.concatenate([[len(blocks)], blocks, counts, values]).astype("<u4").tobytes()


def _unrun(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<u4")
    n = int(x[0])
    return np.repeat(x[1 : n + 1], x[n + 1 : 2 * n + 1]), x[2 * n + 1 :]


_SPAN = np.dtype([("doc", "<i8"), ("a", "<i8"), ("b", "<i8")])


def repeated_anchors(docs: DataFrame, blocks: int, buckets: int, length: int, gram: int) -> DataFrame:
    """(block, kind, data): for each block of documents, hashes of its anchors that two documents or more have (0), or HOT (-1).

    A hash travels as its bucket and 32 more bits: who shares those by accident only costs work.
    """

    def scan(batches):
        held, count = [], 0

        def out():
            pair, value = np.concatenate([p for p, _ in held]), np.concatenate([v for _, v in held])
            order = np.argsort(pair, kind="stable")
            pair, value = pair[order], value[order]
            at = np.append(np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])), len(pair))
            runs, count = pair[at[:-1]], np.diff(at)
            cuts = np.append(np.flatnonzero(np.concatenate([[True], runs[1:] // blocks != runs[:-1] // blocks])), len(runs))
            rows = []  # one for each bucket: its blocks, how many values each has, the values
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows.append((int(runs[a] // blocks), _runs(runs[a:b] % blocks, count[a:b], value[at[a] : at[b]])))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            texts, a = batch.column(1).to_pylist(), 0
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (b == a or n + len(texts[b]) <= CHUNK // 2):
                    n += len(texts[b])
                    b += 1
                h, text, *_ = anchors(texts[a:b], length, gram)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, text = h[once], text[once]
                held.append(((h % np.uint64(buckets)).astype(np.int64) * blocks + block[a:b][text], (h >> np.uint64(32)).astype(np.uint32)))
                count += len(h)
                a = b
                if count > HELD:
                    yield out()
                    held, count = [], 0
        if count:
            yield out()

    def meet(batches):
        """Rows come sorted by bucket."""
        bucket, held = None, []

        def out():
            parts = [_unrun(d) for d in held]
            block, value = np.concatenate([b for b, _ in parts]), np.concatenate([v for _, v in parts])
            order = np.argsort(value, kind="stable")
            value, block = value[order], block[order]
            same = value[1:] == value[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if not many.any():
                return None
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            docs_of = np.repeat(np.diff(np.append(start, len(value))), np.diff(np.append(start, len(value))))
            rows = []
            for kind, mine in ((-1, docs_of >= HOT), (0, many)):
                pairs = np.unique(block[mine].astype(np.uint64) << np.uint64(32) | value[mine])
                full = (pairs & np.uint64(0xFFFFFFFF)) << np.uint64(32) | np.uint64(bucket)
                rows += [(b, kind, d) for b, d in _by_block((pairs >> np.uint64(32)).astype(np.int64), full)] if len(pairs) else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "kind", "data"])

        for batch in batches:
            for k, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != bucket:
                    if held and (x := out()) is not None:
                        yield x
                    bucket, held = k, []
                held.append(d)
        if held and (x := out()) is not None:
            yield x

    found = docs.select("block", "data").mapInArrow(scan, "bucket int, data binary")
    return found.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "block int, kind int, data binary")


def _chunks(rows: list[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    ids, texts, n = [], [], 0
    for doc, data in rows:
        if ids and n + len(data) > CHUNK // 3:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(doc)
        texts.append(data)
        n += len(data)
    if ids:
        yield ids, texts


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all segments in a row."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _found(ids, texts, known: np.ndarray, hot: np.ndarray, buckets: int, length: int, gram: int):
    """(anchor, doc, start, size, bytes) of the segments of repeated anchors; hot ones by a second anchor."""
    h, text, start, end, data = anchors(texts, length, gram)
    short = (h >> np.uint64(32)) << np.uint64(32) | h % np.uint64(buckets)
    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
    hit = known[at] == short
    much = hit & (hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short) if len(hot) else np.zeros(len(h), bool)
    first = np.cumsum([0, *map(len, texts)])[:-1]
    docs = np.array(ids, np.int64)
    plain = np.flatnonzero(hit & ~much)
    size = end[plain] - start[plain] + length - 1
    yield h[plain], docs[text[plain]], start[plain] - first[text[plain]], size, _cut(data, start[plain], size)
    much = np.flatnonzero(much)
    if len(much):
        size = end[much] - start[much] + length - 1
        parts = [data[a : a + n].tobytes() for a, n in zip(start[much].tolist(), size.tolist(), strict=True)]
        h2, of, start2, end2, data2 = anchors(parts, length, gram, 1)
        first2, size2, row = np.cumsum(size) - size, end2 - start2 + length - 1, much[of]
        yield mix(h[row] ^ (h2 * np.uint64(0x9E3779B97F4A7C15))), docs[text[row]], start[row] - first[text[row]] + start2 - first2[of], size2, _cut(data2, start2, size2)


def segments(docs: DataFrame, repeated: DataFrame, copies: DataFrame, blocks: int, buckets: int, length: int, gram: int) -> DataFrame:
    """(anchor, doc, start, segment) for every repeated anchor in every document that is no copy of a smaller one.

    Of a block's equal segments only the least document's go on; a row with start -1 - block has spans of the others.
    """

    def least_of(parts):
        """Which rows are their segment's least document's in this block."""
        docs_of, size = (np.concatenate([p[k] for p in parts]) for k in (1, 3))
        hashes = []
        for _, _, _, sizes, body in parts:
            ends = np.cumsum(sizes)
            run = [_runs_of(body, turn) for turn in (0, 1)]
            hashes.append(np.stack([(x[ends] - x[ends - sizes]) * down[ends - sizes] for x, down in run], 1))
        hashes = np.concatenate(hashes)
        order = np.lexsort((docs_of, size, hashes[:, 1], hashes[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]).any(1) | (size[order[1:]] != size[order[:-1]])
        least = np.empty(len(order), np.int64)
        least[order] = docs_of[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return docs_of == least

    def run(batches):
        block, known, hot, twins, held = None, [], [], set(), []

        def out():
            if not known or not held:
                return
            sorted_, hot_ = np.unique(np.concatenate(known)), np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
            parts = [p for ids, texts in _chunks(held) for p in _found(ids, texts, sorted_, hot_, buckets, length, gram) if len(p[0])]
            if not parts:
                return
            stays, a, spans = least_of(parts), 0, []
            for anchor, doc, start, size, body in parts:
                mine = stays[a : a + len(anchor)]
                a += len(anchor)
                go, at = np.flatnonzero(mine), np.cumsum(size) - size
                offsets = np.concatenate([[0], np.cumsum(size[go])]).astype(np.int32)
                segment = pa.Array.from_buffers(pa.binary(), len(go), [None, pa.py_buffer(offsets), pa.py_buffer(_cut(body, at[go], size[go]).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[go].view(np.int64)), pa.array(doc[go]), pa.array(start[go].astype(np.int64)), segment], names=["anchor", "doc", "start", "segment"])
                span = np.empty(int((~mine).sum()), _SPAN)
                span["doc"], span["a"], span["b"] = doc[~mine], start[~mine], start[~mine] + size[~mine]
                spans.append(span)
            spans = np.concatenate(spans)
            if len(spans):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int64()), pa.array([-1 - block], pa.int64()), pa.array([_joined(spans).tobytes()], pa.binary())], names=["anchor", "doc", "start", "segment"])

        for batch in batches:
            for b, kind, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    yield from out()
                    block, known, hot, twins, held = b, [], [], set(), []
                    give_back()
                if kind <= 0:
                    (known if kind == 0 else hot).append(np.frombuffer(data, np.uint64))
                elif kind == 1:
                    twins.add(doc)
                elif doc not in twins:
                    held.append((doc, data))
        yield from out()

    all_rows = docs.select("block", F.lit(2).alias("kind"), "doc", "data")
    all_rows = all_rows.unionByName(repeated.select("block", "kind", F.lit(0).cast("long").alias("doc"), "data"))
    all_rows = all_rows.unionByName(copies.select("block", F.lit(1).alias("kind"), "doc", F.lit(None).cast("binary").alias("data")))
    return all_rows.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, "anchor long, doc long, start long, segment binary")


def _runs_of(data: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a polynomial in one of two bases, and the powers that bring differences to a common one."""
    n = len(data)
    if len(_powers.get(f"up{turn}", ())) < n + 1:
        base = _BASE if turn == 0 else np.uint64(0xA0761D6478BD642F)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        _powers[f"up{turn}"], _powers[f"down{turn}"] = _power(n + 1, base), _power(n + 1, inverse)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1 + 256 * turn)) * _powers[f"up{turn}"][:n], out=run[1:])
    return run, _powers[f"down{turn}"]


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans in order, overlapping ones of a document as one."""
    spans = spans[np.lexsort((spans["a"], spans["doc"]))]
    number = np.cumsum(np.concatenate([[True], spans["doc"][1:] != spans["doc"][:-1]])) - 1
    wide = int(spans["b"].max()) + 1
    reach = np.maximum.accumulate(spans["b"] + number * wide)
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (spans["a"][1:] + number[1:] * wide > reach[:-1])])
    head = np.flatnonzero(new)
    out = spans[head]
    out["b"] = reach[np.append(head[1:], len(spans)) - 1] - number[head] * wide
    return out


def covered(found: DataFrame, blocks: int, length: int) -> DataFrame:
    """(block, data): spans to remove, packed, by block of documents."""

    def run(batches):
        shard, last = Shard(length), None

        def out(going_on):
            spans = np.zeros(0, _SPAN)
            doc, a, b = shard.spans(going_on)
            shard.clear()
            give_back()
            spans = np.empty(len(doc), _SPAN)
            spans["doc"], spans["a"], spans["b"] = doc, a, b
            rows = list(_by_block(block_of(doc, blocks), spans)) if len(doc) else []
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["block", "data"])

        for batch in batches:
            for anchor, doc, start, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - start], pa.int32()), pa.array([segment], pa.binary())], names=["block", "data"])
                    continue
                if shard.size >= SHARD and (anchor != last or shard.size >= 2 * SHARD) or len(shard.rows) >= 400_000:
                    yield out(anchor if anchor == last else None)
                shard.add(anchor, doc, start, segment)
                last = anchor
        if shard.rows:
            yield out(None)

    return found.repartition("anchor").sortWithinPartitions("anchor", "doc").mapInArrow(run, "block int, data binary")


_PRIME, _FACTOR = 1_000_003, 7919


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return doc % _PRIME * _FACTOR % _PRIME % blocks


def block_column(doc, blocks: int):
    """The same as block_of, in Spark; nothing overflows."""
    return F.pmod(F.pmod(F.pmod(doc, F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)), F.lit(blocks)).cast("int")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of each text, as bytes, and what was taken."""
    spark = ready(docs.sparkSession)
    blocks = blocks or 4 * max(docs.rdd.getNumPartitions(), 2)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NONE)))
    keyed = docs.select(doc.alias("doc"), "doc_id", F.coalesce(F.encode("text", "utf-8"), F.encode(F.lit(""), "utf-8")).alias("data")).withColumn("block", block_column(F.col("doc"), blocks))
    # Whole copies of a smaller document need no search; a doc_id with rows that differ is left to it.
    named = materialize(keyed.select("doc", "block", F.xxhash64("data").alias("h1"), F.xxhash64(F.lit(1), "data").alias("h2")), "text-hashes")
    least = named.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "least")
    single = named.groupBy("doc").agg(F.count("*").alias("rows")).where("rows = 1").select("doc")
    copies = materialize(named.join(least, ["h1", "h2"]).where("doc > least").join(single, "doc", "left_semi").select("block", "doc"), "copies")
    repeated = materialize(repeated_anchors(keyed, blocks, blocks, length, gram), "repeated-anchors")
    spans = materialize(covered(segments(keyed, repeated, copies, blocks, blocks, length, gram), blocks, length), "spans")

    def run(batches):
        block, held, twins, ready_ = None, [], set(), None
        for batch in batches:
            ids, sizes, removed, counts, kept = [], [], [], [], []
            for b, kind, d, doc_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, held, twins, ready_ = b, [], set(), None
                if kind == 0:
                    held.append(np.frombuffer(data, _SPAN))
                    continue
                if kind == 1:
                    twins.add(d)
                    continue
                if ready_ is None:
                    ready_ = np.concatenate(held) if held else np.zeros(0, _SPAN)
                    ready_ = ready_[np.lexsort((ready_["a"], ready_["doc"]))]
                    held = []
                if d in twins and len(data) >= length:
                    runs = [(0, len(data))]
                else:
                    lo, hi = np.searchsorted(ready_["doc"], d), np.searchsorted(ready_["doc"], d, "right")
                    mine = ready_[lo:hi]
                    runs = _merged(np.stack([mine["a"], mine["b"]], 1)) if hi > lo else []
                ids.append(doc_id)
                sizes.append(len(data))
                removed.append(sum(y - x for x, y in runs))
                counts.append(len(runs))
                ends = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = keyed.select("block", F.lit(2).alias("kind"), "doc", F.col("doc_id").cast("long").alias("doc_id"), "data")
    none = F.lit(None).cast("long").alias("doc_id")
    rows = rows.unionByName(spans.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc"), none, "data"))
    rows = rows.unionByName(copies.select("block", F.lit(1).alias("kind"), "doc", none, F.lit(None).cast("binary").alias("data")))
    return rows.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
