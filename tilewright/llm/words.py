"""Words and word shingles of many texts at once, on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes handled at once; a single longer text is handled alone.
CHUNK = 500_000
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * (out[-1:] * base)])
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Parts of a batch, texts as UTF-8 bytes, null as empty."""
    held, n, a = [], 0, 0
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        t = t or b""
        if held and n + len(t) > CHUNK:
            yield ids.slice(a, i - a), held
            held, n, a = [], 0, i
        held.append(t)
        n += len(t)
    if held:
        yield ids.slice(a), held


def lowered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the texts with A-Z lower-cased, a newline after each, and where words start and stop in them."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)
    white = (data - np.uint8(9) < 5) | (data == 32)
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    return data, edge[::2], edge[1::2]  # the last byte is white, so every word ends


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hashes and bounds as `word_hashes` gives them; bytes, starts and stops as `lowered` does."""
    data, starts, stops = lowered(texts)
    n = len(data)
    if len(_powers.get("up", ())) < n + 1:
        _powers["up"], _powers["down"] = _power(max(n + 1, CHUNK + 100_000), _BASE), _power(max(n + 1, CHUNK + 100_000), _INVERSE)
    run = np.zeros(n + 1, np.uint64)
    np.add(data, np.uint64(1), out=run[1:], dtype=np.uint64)
    run[1:] *= _powers["up"][:n]
    np.cumsum(run[1:], out=run[1:])
    hashes = mix((run[stops] - run[starts]) * _powers["down"][starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)]), data, starts, stops


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z lower-cased, and the bounds of each text's in that array."""
    return hashed_words(texts)[:2]


def shingle_sets(ids: pa.Array, texts: pa.Array, k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Parts of a batch with each text's sorted distinct shingle hashes."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for part, chunk in text_chunks(ids, texts):
        words, bounds = word_hashes(chunk)
        runs = max(0, len(words) - k + 1)
        sums = np.zeros(runs, np.uint64)
        for j in range(k):
            sums += words[j : j + runs] * factors[j]
        sums = mix(sums)
        sets = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(sums[a : b - k + 1]))
            elif b > a:
                sets.append(mix((words[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield part, sets
