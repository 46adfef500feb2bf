"""The bit model of LM scoring on arrays: codes of known words, spelling of the others, counts and mixing.

A known word is a path in a binary tree over all known words (Shannon-Fano-Elias codes over their counts in the order
of class and hash, without the levels that do not branch); each class has an escape in that tree, behind which unknown
words are spelled byte by byte. Contexts predict a bit by the counts of both bits behind the same path; `Mixer` sums
their logits with weights chosen by a gate and refines the result by an adaptive table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import mix

CLASSES = 16
#: Bits of a stored code: 58 for the path, left-aligned, and 6 for its length.
CODE, SIX = 58, np.uint64(63)
#: Levels of the tree at which whole classes are counted.
TOP = 14
#: Levels at which a frequent word's successors are counted apart.
HEAD = 6
TABLE_BITS = (12, 14, 15)
LEVELS = 33
BATCH = 4096
#: Fractions of a bit in sums over levels.
FINE = 1 << 32
#: Evidence of a context in ten steps; of a class in three.
STEPS = np.searchsorted([1, 2, 3, 5, 9, 17, 65, 513, 1023], np.arange(1024), side="right")
ZONES = np.searchsorted([1, 30], np.arange(1024), side="right")
GATES, ROUGH = 10 * 2 * 3 * 4, 10 * 2
SPELL_GATES, SPELL_ROUGH = 14 * 6, 14


class Mixer:
    """Weights by gate, and the refining table by rough gate and logit. It learns as it goes."""

    def __init__(self, weights: np.ndarray, rough: int):
        self.weights = np.ascontiguousarray(weights.T, np.float32)
        self.square = np.full(self.weights.shape, 1e-4)
        self.table = np.zeros((2, rough * LEVELS))  # zeros, ones

    def step(self, x: np.ndarray, gate: np.ndarray, rough: np.ndarray, bit: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """log2 of the bits' probabilities, with what is known so far; then one step of descent over those that have mass.

        x: [inputs, bits]. Steps are as long as a gate's slopes are small, so they shrink while it learns.
        """
        logit = self.weights[0].take(gate)
        logit *= x[0]
        for w, row in zip(self.weights[1:], x[1:], strict=True):
            w = w.take(gate)
            w *= row
            logit += w
        np.maximum(np.minimum(logit, 16, out=logit), -16, out=logit)
        place = logit * np.float32((LEVELS - 1) / 24)
        place += np.float32((LEVELS - 1) / 2)
        np.rint(np.maximum(np.minimum(place, LEVELS - 1, out=place), 0, out=place), out=place)
        level = rough * LEVELS + place.astype(np.int64)
        p = np.exp(np.negative(logit, out=logit), out=logit)
        p += 1
        np.reciprocal(p, out=p)
        # The mean of p and (ones + 30 p) / (zeros + ones + 30) is a line in p.
        share = 0.5 / (self.table[0] + self.table[1] + 30)
        fine = (30 * share + 0.5).astype(np.float32).take(level)
        fine *= p
        fine += (self.table[1] * share).astype(np.float32).take(level)
        fine += bit
        fine -= 1
        np.maximum(np.abs(fine, out=fine), np.float32(1e-6), out=fine)  # its own value for a one, what is left for a zero
        n = self.weights.shape[1]
        total = np.bincount(gate, mass, n)
        if total.any():
            np.subtract(bit, p, out=p)
            p *= mass
            slope = np.stack([np.bincount(gate, p * row, n) for row in x]) / np.maximum(total, 1e-9)
            self.square += slope**2
            self.weights += (0.05 * slope / np.sqrt(self.square)).astype(np.float32)
            self.table += np.bincount(level + bit.astype(np.int64) * self.table.shape[1], mass, self.table.size).reshape(2, -1)
        return np.log2(fine, out=fine)


def word_mixer() -> Mixer:
    """Inputs: all texts, the class, the word before."""
    return Mixer(np.tile(np.array([0.2, 0.5, 0.8]), (GATES, 1)), ROUGH)


def spell_mixer() -> Mixer:
    """Inputs: the last one, two and three bytes."""
    return Mixer(np.tile(np.array([0.2, 0.3, 0.6]), (SPELL_GATES, 1)), SPELL_ROUGH)


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.2)) / (n0 + np.float32(0.2)))


# Codes


def sfe(lo: np.ndarray, count: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (in units of 2 ** -(bits + 1)) and length of the path in the middle of each interval [lo, lo + count)."""
    log = np.frexp(count.astype(np.float64))[1].astype(np.int64) - 1  # exact below 2 ** 53
    return 2 * lo + count >> log << log, bits - log + 1


def branching(start: np.ndarray, length: np.ndarray, region: np.ndarray, bits: int) -> np.ndarray:
    """Packed codes with those levels alone at which the words of a run part, or which a run may share with other tables.

    Rows are in order; a run that touches an end of its region may go on elsewhere, so all its levels are kept.
    """
    n = len(start)
    code, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return code.astype(np.uint64)
    first = np.concatenate([[True], region[1:] != region[:-1]])
    end = first | np.concatenate([first[1:], [True]])
    for s in range(int(length.max())):
        at = np.flatnonzero(length > s)
        prefix, bit = start[at] >> (bits + 1 - s), start[at] >> (bits - s) & 1
        head = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (region[at][1:] != region[at][:-1])]))
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
        ones = np.add.reduceat(bit, head)
        all_ = np.diff(np.append(head, len(at)))
        keep = ((ones > 0) & (ones < all_) | (np.add.reduceat(end[at].astype(np.int64), head) > 0))[run]
        code[at[keep]] = code[at[keep]] * 2 + bit[keep]
        size[at[keep]] += 1
    return pack(code, size)


def pack(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) << (CODE - size).astype(np.uint64)) << np.uint64(6) | size.astype(np.uint64)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned path and length."""
    return (packed >> np.uint64(6)).astype(np.int64), (packed & SIX).astype(np.int64)


def escapes(regions: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the words of each class (rows) and range of hashes (columns) begin, the classes' escapes' codes, and the bits of all.

    regions: training counts of known words; rare: words that training has once, by class. An escape stands before its class.
    """
    mass = np.concatenate([rare[:, None] + 1, regions], 1).astype(np.int64)
    lo = (np.cumsum(mass.ravel()) - mass.ravel()).reshape(mass.shape)
    bits = max(2, int(mass.sum()).bit_length())
    start, length = sfe(lo[:, 0], mass[:, 0], bits)
    return lo[:, 1:], pack(start >> (bits + 1 - length), length), bits


def word_codes(classes: np.ndarray, counts: np.ndarray, lo: np.ndarray, bits: int) -> np.ndarray:
    """Codes of a range's known words, in the order of class and hash; lo: where each class begins in this range."""
    before = np.cumsum(counts) - counts
    first = np.searchsorted(classes, np.arange(CLASSES))
    at = lo[classes] + before - np.append(before, counts.sum())[first][classes] if len(classes) else before
    start, length = sfe(at, counts, bits)
    return branching(start, length, classes, bits)


def cells(codes: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class * 2 ** TOP + cell, count) of the training words."""
    at = (classes << TOP) + (unpack(codes)[0] >> (CODE - TOP))
    found, inverse = np.unique(at, return_inverse=True)
    return found, np.bincount(inverse, counts, len(found)).astype(np.int64)


def tops(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[CLASSES + 1, cells + 1]: running counts over the cells of each class, and of all."""
    full = np.bincount(keys, counts, CLASSES << TOP).reshape(CLASSES, -1)
    full = np.concatenate([full, full.sum(0, keepdims=True)])
    return np.concatenate([np.zeros((CLASSES + 1, 1)), np.cumsum(full, 1)], 1)


# Successors

_levels: list = [None, []]


def prospects(top: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level above TOP the inputs of each class and of all, and four times their zones, by what is left out, class and path; of the last top asked for."""
    if _levels[0] is not top:
        found = []
        for s in range(TOP):
            level = np.diff(top[:, :: 1 << (TOP - s - 1)])
            differ = level.reshape(len(level), -1, 2)[:, :, ::-1].reshape(level.shape)
            same = np.stack([level, np.maximum(level - 1, 0)])
            x = _stretch(differ.astype(np.float32), same.astype(np.float32))
            x[:, :, ::2] *= -1
            found.append((x.ravel(), (4 * ZONES[np.minimum(same + differ, 1023).astype(np.int64)]).astype(np.int8).ravel()))
        _levels[:] = top, found
    return _levels[1]


class Successors:
    """Distinct (context, word) rows in order of context and code, with their training counts.

    context: any numbers, equal for equal contexts; head: per row the row in `heads` of a frequent context, or -1.
    heads: [frequent contexts, 2 ** HEAD + 1] running counts of all their successors; kinds: how many successors they have.
    """

    def __init__(self, context, classes, codes, counts, top, head=None, heads=None, kinds=None):
        self.code, self.length = unpack(codes)
        self.classes, self.counts, self.top = classes, counts.astype(np.float32) if counts.sum() < 1 << 24 else counts.astype(np.float64), top
        self.head = head
        self.heads = np.zeros((1, (1 << HEAD) + 1)) if heads is None else heads
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(codes) else np.zeros(0, bool)
        differ = self.code[1:] ^ self.code[:-1]
        shared = CODE - np.frexp(differ.astype(np.float64))[1]
        shared = np.where(differ >> 53 > 0, CODE - 53 - np.frexp((differ >> 53).astype(np.float64))[1], shared)
        self.shared = np.where(new, -1, np.concatenate([[-1], shared])).astype(np.int8) if len(codes) else np.zeros(0, np.int8)
        self.length = self.length.astype(np.int8)
        which = np.cumsum(new) - 1
        known, all_ = np.bincount(which, counts > 0)[which], np.bincount(which, counts)[which]
        if heads is not None:
            frequent = self.head >= 0
            known = np.where(frequent, kinds[self.head], known)
            all_ = np.where(frequent, heads[self.head, -1], all_)
        self.novel = np.searchsorted([0.1, 0.3, 0.7], known / np.maximum(all_, 1)).astype(np.int8)

    def score(self, mixer: Mixer, rows: np.ndarray, left_out: np.ndarray, mass: np.ndarray) -> np.ndarray:
        """log2 of the rows' probabilities, online: the levels in turn, at each the rows in order, BATCH of them to a step.

        rows: in order, each at least once; those that are not left out of their own counts have no mass. Rows of a context
        whose codes go on alike up to a bit have the same inputs for it, apart from what is left out: a step computes these
        once, with the rows' masses added.
        """
        first = np.append(True, rows[1:] != rows[:-1])[: len(rows)]
        code, size, novel, classes, left = self.code[rows], self.length[rows], self.novel[rows], self.classes[rows], left_out.astype(np.int8)
        shared, counts = np.where(first, self.shared[rows], 127).astype(np.int8), np.where(first, self.counts[rows], 0)
        head = self.head[rows] if len(self.heads) > 1 else None
        places, going, total, levels = np.arange(len(rows)), np.ones(len(rows), bool), np.zeros(len(rows)), prospects(self.top)

        def sums():
            """Up to each place: the counts, the masses, how many are left out and how many not; changes of the score."""
            up = [np.zeros(len(code) + 1) for _ in range(2)] + [np.zeros(len(code) + 1, np.int32) for _ in range(2)]
            for to, of in zip(up, (counts, mass, going & (left > 0), going & (left == 0)), strict=True):
                np.cumsum(of, out=to[1:], dtype=to.dtype)
            return *up, np.zeros((2, len(code) + 1), np.int64)

        def gather():
            total[places[going]] += np.where(left, *np.cumsum(found[::-1, :-1], 1))[going] / FINE

        above, masses, outs, ins, found = sums()
        for s in range(int(size.max(initial=0))):
            if s >= TOP:  # where a context has nothing left to say, each bit costs one
                gather()
                run, going = np.cumsum(shared < s) - 1, going & (size > s)
                over = going & (np.bincount(run, counts)[run] <= left)
                total[places[over]] -= size[over] - s
                going &= ~over
                stay = np.flatnonzero((np.bincount(run, going) > 0)[run])
                code, size, novel, left, shared, counts, places, going, mass = (v[stay] for v in (code, size, novel, left, shared, counts, places, going, mass))
                above, masses, outs, ins, found = sums()
                if not len(code):
                    break
            # Nodes are rows alike up to this bit; parts, a node's rows in one step.
            marks = np.flatnonzero(going & (size > s))[BATCH::BATCH]
            cut = shared <= s
            cut[marks] = True
            part = np.flatnonzero(cut)
            stop, on = np.append(part[1:], len(code)), size[part] > s
            if not on.all():
                part, stop = part[on], stop[on]
            share = shared[part]
            new = share <= s
            node, share = np.cumsum(new) - 1, share[new]
            n = np.bincount(node, above[stop] - above[part])
            both, other = np.flatnonzero(share[1:] == s), np.zeros(len(n))
            other[both], other[both + 1] = n[both + 1], n[both]
            n, other, path = n[node], other[node], code[part] >> (CODE - 1 - s)
            if s < HEAD and head is not None:
                k, width = head[part], 1 << (HEAD - s - 1)
                lo, beside = path * width, (path ^ 1) * width
                n = np.where(k >= 0, self.heads[k, lo + width] - self.heads[k, lo], n)
                other = np.where(k >= 0, self.heads[k, beside + width] - self.heads[k, beside], other)
            has = np.empty((len(part), 2), bool)
            has[:, 0], has[:, 1] = ins[stop] > ins[part], outs[stop] > outs[part]
            of = np.flatnonzero(has)
            own, of = of & 1, of >> 1
            same, differ = (n[of] - own).astype(np.float32), other[of].astype(np.float32)
            x, bit = np.zeros((3, len(of)), np.float32), (path & 1).astype(np.float32)[of]
            np.multiply(_stretch(differ, same), 2 * bit - 1, out=x[2])
            rough = STEPS.take(np.minimum(same + differ, 1023).astype(np.int64)) * 2 + (np.minimum(same, differ) == 0)
            gate = rough * 12 + novel[part][of]
            if s < TOP:
                of_all, zone = levels[s]
                at = path[of] + (own * (CLASSES + 1) << s + 1)
                of_all.take(at + (CLASSES << s + 1), out=x[0])
                at += (classes[part] << s + 1)[of]
                of_all.take(at, out=x[1])
                gate += zone.take(at)
            weight = ((masses[stop] - masses[part])[of] * own).astype(np.float32)
            a, units = 0, np.empty(len(of))
            for b in [*np.searchsorted(of, np.searchsorted(part, marks)).tolist(), len(of)]:
                c = slice(a, b)
                units[c] = mixer.step(x[:, c], gate[c], rough[c], bit[c], weight[c])
                a = b
            units, flat = np.rint(units * FINE).astype(np.int64), found.ravel()
            own *= found.shape[1]
            flat[own + part[of]] += units
            flat[own + stop[of]] -= units
        gather()
        return total


# Spelling


class Speller:
    """Words as flat bytes, each closed by a zero."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, classes: np.ndarray):
        self.lengths, self.classes = lengths, classes
        self.data = np.concatenate([data, np.zeros(1, np.uint8)])
        self.first = np.cumsum(lengths) - lengths

    def flat(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For each byte of the words: its word's place in words, the byte, and its rows in the three tables."""
        size = self.lengths[words] + 1
        own = np.repeat(np.arange(len(words)), size)
        d = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at, word = self.first[words][own] + d, words[own]
        byte = np.where(d < self.lengths[word], self.data[np.minimum(at, len(self.data) - 1)], 0).astype(np.int64)
        key, rows = self.classes[word].astype(np.uint64), []
        for k, bits in enumerate(TABLE_BITS, 1):
            last = np.where(d >= k, self.data[np.maximum(at - k, 0)], 1).astype(np.uint64)
            key = key * np.uint64(257) + last
            rows.append((mix(key * np.uint64(4) + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64))
        return own, byte, rows

    def chunks(self, words: np.ndarray, size: int = 512) -> Iterator[np.ndarray]:
        """A few words at a time; a long one alone."""
        cut = np.flatnonzero(np.diff(np.cumsum(self.lengths[words] + 1) // (16 * size))) + 1
        for part in np.split(words, cut):
            for a in range(0, len(part), size):
                yield part[a : a + size]

    def table_counts(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(row * 256 + byte, count) of each table; every word counts once."""
        out: list[list] = [[], [], []]
        for part in self.chunks(words, 20_000):
            _, byte, rows = self.flat(part)
            for k, row in enumerate(rows):
                out[k].append(np.unique(row * 256 + byte, return_counts=True))
        result = []
        for found in out:
            keys, inverse = np.unique(np.concatenate([f for f, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
            result.append((keys, np.bincount(inverse, np.concatenate([n for _, n in found] or [np.zeros(0)]), len(keys)).astype(np.int64)))
        return result

    @staticmethod
    def running(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
        """Running sums over the bytes of each row, 257 to a row."""
        out = []
        for bits, k, n in zip(TABLE_BITS, keys, counts, strict=True):
            full = np.bincount(k, n, 1 << (bits + 8)).reshape(-1, 256)
            out.append(np.concatenate([np.zeros((len(full), 1), np.float32), np.cumsum(full, 1).astype(np.float32)], 1).ravel())
        return out

    @staticmethod
    def bits(byte: np.ndarray, out: np.ndarray, rows: list[np.ndarray], apart: np.ndarray, tables: list[np.ndarray]) -> Iterator[tuple]:
        """Bit by bit: how many of the bytes share inputs; inputs, gate, rough gate, bit and what is left out.

        The bytes come in order of rows, what is left out and byte; apart: in what each differs from the one before.
        """
        rows = [r * 257 for r in rows]
        for j in range(8):
            start, half = np.flatnonzero(apart >> (7 - j)), 128 >> j
            of, left = byte[start] >> (7 - j), out[start]
            lo, hi, bit = of * half, (of ^ 1) * half, (of & 1).astype(np.float32)
            x, sign, all_ = np.empty((3, len(start)), np.float32), 2 * bit - 1, []
            for k, (t, r) in enumerate(zip(tables, rows, strict=True)):
                r = r[start]
                mine, beside = r + lo, r + hi
                same, differ = t[mine + half] - t[mine], t[beside + half] - t[beside]
                same -= left
                np.maximum(same, 0, out=same)
                np.multiply(_stretch(differ, same), sign, out=x[k])
                all_.append(np.frexp(same + differ)[1])
            rough = np.minimum(all_[2], SPELL_ROUGH - 1).astype(np.int64)
            gate = rough * 6 + np.minimum(all_[1] // 3, 5)
            yield np.diff(np.append(start, len(byte))), x, gate, rough, bit, left

    def score(self, mixer: Mixer, words: np.ndarray, left_out: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """log2 of the words' probabilities, online: a few words to a step, which learns from those that are left out of their own counts."""
        total, a = np.zeros(len(words)), 0
        for part in self.chunks(words, 1024):
            b = a + len(part)
            own, byte, rows = self.flat(part)
            key = left_out[a:b][own].astype(np.int64)
            out = key.astype(np.float32)
            for bits, row in zip(TABLE_BITS, rows, strict=True):
                key = key << bits | row
            key = key << 8 | byte
            order = np.argsort(key)
            key, found = key[order], np.zeros(len(key))
            apart = np.append(1 << 8, key[1:] ^ key[:-1])
            for many, x, gate, rough, bit, left in self.bits(byte[order], out[order], [r[order] for r in rows], apart, tables):
                found += np.repeat(mixer.step(x, gate, rough, bit, left * many.astype(np.float32)), many)
            by_place = np.empty(len(found))
            by_place[order] = found
            total[a:b] = np.bincount(own, by_place, len(part))
            a = b
        return total
