"""Byte-level BPE without regular expressions.

Pre-tokenisation. Code points become classes by one table lookup. What a class does to the splitter's state is a
function from states to states; these functions form a small monoid whose products are tabulated, so the states
before all characters come from an associative scan: products within blocks (vectorised over the blocks), a scan
over the blocks' products, and one more lookup. State, class and the next class then say where a token begins.
Encoding. The slices between boundaries go through a cache to pair merging by rank. Decoding gathers the tokens'
bytes at offsets that are the running sum of their lengths.

Cases: null and empty texts have no tokens and decode to nothing; very long slices are merged with a heap, in
n log n steps; equal rows have equal results; ties between pairs go to the leftmost; an empty table gives an empty
result; other columns pass through, but one with the name of the result is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, with_columns, without

# Fixed values of the split pattern: classes, states, contractions and the white space of Unicode.
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, ELL, E, END = range(12)
START, AFTER_SPACE, AFTER_WHITE, IN_LETTERS, IN_NUMBER, IN_OTHER, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(11)
N_CLASSES, N_STATES = 12, 11
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTERS = {LETTER, STMD, R, V, ELL, E}
#: Characters handled at once; a single longer text is handled alone.
CHUNK = 400_000
#: Slices in each half of the cache.
CACHE = 150_000


def class_table() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for letters, c in (("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E)):
        table[[ord(x) for x in letters]] = c
    return table


def _next_state(s: int, c: int) -> int:
    if c == END:
        return START
    if c in LETTERS:
        if s == QUOTED:
            return {STMD: CONTRACTED, R: QUOTE_R, V: QUOTE_V, ELL: QUOTE_L}.get(c, IN_LETTERS)
        if (s in (QUOTE_R, QUOTE_V) and c == E) or (s == QUOTE_L and c == ELL):
            return CONTRACTED
        return IN_LETTERS
    if c == QUOTE:
        return IN_OTHER if s in (AFTER_SPACE, IN_OTHER, QUOTED) else QUOTED
    return {SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, NUMBER: IN_NUMBER, OTHER: IN_OTHER}[c]


def _begins(s: int, c: int, following: int) -> bool:
    """Whether a token begins at a character of class c in state s."""
    if s == START or c == END:
        return True
    if c in (SPACE, WHITE):  # the last white space before a token stands apart from those before it
        return s not in (AFTER_SPACE, AFTER_WHITE) or following not in (SPACE, WHITE, END)
    if s == AFTER_SPACE:
        return False
    if c in LETTERS:
        if s == QUOTED:
            return not (c == STMD or (c in (R, V) and following == E) or (c == ELL and following == ELL))
        return s not in (IN_LETTERS, QUOTE_R, QUOTE_V, QUOTE_L)
    if c == NUMBER:
        return s != IN_NUMBER
    return s not in (IN_OTHER, QUOTED)


class Splitter:
    def __init__(self):
        self.classes = class_table()
        gens = [tuple(_next_state(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
        known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(N_STATES)), *gens]))}
        todo = list(known)
        while todo:  # close under composition
            f = todo.pop()
            for g in gens:
                h = tuple(g[x] for x in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        self.act = np.array(list(known), np.uint8)  # [function, state]
        self.size = len(known)
        self.product = np.array([known[tuple(g[x] for x in f)] for f in known for g in known], np.uint8)
        self.generator = np.array([known[g] for g in gens], np.uint8)
        self.begins = np.array([_begins(s, c, d) for s in range(N_STATES) for c in range(N_CLASSES) for d in range(N_CLASSES)], bool)

    def scan(self, f: np.ndarray) -> np.ndarray:
        """Inclusive products of the functions f, by blocks."""
        n, size = len(f), np.uint16(self.size)
        if n <= 64:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.product[int(out[i - 1]) * self.size + int(f[i])]
            return out
        length = max(16, min(256, int(n**0.5)))
        blocks = -(-n // length)
        x = np.zeros(blocks * length, np.uint8)  # 0 is the identity
        x[:n] = f
        x = np.ascontiguousarray(x.reshape(blocks, length).T)
        for i in range(1, length):
            x[i] = self.product[x[i - 1].astype(np.uint16) * size + x[i]]
        before = np.zeros(blocks, np.uint8)
        before[1:] = self.scan(x[-1])[:-1]
        x = self.product[before.astype(np.uint16) * size + x]
        return np.ascontiguousarray(x.T).ravel()[:n]

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Indices at which tokens begin; the END after each text is one of them. classes ends with END."""
        state = np.empty(len(classes), np.uint16)
        state[0] = START
        state[1:] = self.act[:, START][self.scan(self.generator[classes])[:-1]]
        state *= N_CLASSES
        state += classes
        state *= N_CLASSES
        state[:-1] += classes[1:]
        state[-1] += END
        return np.flatnonzero(self.begins[state])

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All texts' tokens in order, an END's "\\0" after each text's, and where in the list these ends are."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[points]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[ends] = END
        at = self.starts(classes)
        bounds = [*at.tolist(), len(joined)]
        return [joined[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], np.searchsorted(at, ends)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of the lowest rank, the leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    get, parts = ranks.get, [word[i : i + 1] for i in range(len(word))]
    none = 1 << 60
    pair = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pair and (least := min(pair)) < none:
        i = pair.index(least)
        parts[i] += parts.pop(i + 1)
        del pair[i]
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:  # out of date: a part of it has been merged since
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """Slice -> its ids as little-endian 32-bit integers; when full it becomes the older half, which what is used leaves."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.splitter, self.older = ranks, Splitter(), {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for chunk in chunks(texts):
            pieces, ends = self.splitter.split(chunk)
            ids, a = list(map(self.__getitem__, pieces)), 0
            for b in ends.tolist():
                yield b"".join(ids[a:b])
                a = b + 1


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        offsets = self.offsets(ids)
        return self.bytes[np.repeat(self.first[ids] - offsets[:-1], self.lengths[ids]) + np.arange(offsets[-1])]


def chunks(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > CHUNK:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _vocabulary(path: str) -> tuple[str, dict[bytes, int]]:
    """A digest of the ranks, and the ranks."""
    ranks = read_ranks(path)
    digest = hashlib.blake2b(digest_size=16)
    for token, rank in ranks.items():
        digest.update(b"%d %d " % (rank, len(token)) + token)
    return digest.hexdigest(), ranks


_made: dict = {}


def _once(kind, shared):
    """One encoder or decoder for a worker's life, as its cache is worth keeping."""
    digest, ranks = shared.value
    key = (kind, digest)
    if key not in _made:
        _made[key] = kind(ranks)
    return _made[key]


def encode(docs: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with one more column: the ids of each text as little-endian unsigned 32-bit integers.

    The rank file is read on the driver and broadcast: its size is that of a vocabulary, not of the data.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_vocabulary(path or default_path()))
    docs = without(docs, ids)
    at = docs.columns.index("text")

    def run(batches):
        encoder = _once(Encoder, shared)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            yield batch_with(batch, pa.array(encoder.encode(texts), pa.binary(), size=len(texts)))

    return with_columns(docs, run, [T.StructField(ids, T.BinaryType())])


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with one more column: the bytes that the ids stand for. All ids of a batch are gathered at once."""
    spark = ready(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(_vocabulary(path or default_path()))
    encoded = without(encoded, into)
    at = encoded.columns.index(ids)

    def run(batches):
        decoder = _once(Decoder, shared)
        for batch in batches:
            for part in slices(batch, at):
                rows = [x or b"" for x in part.column(at).to_pylist()]
                out = decoder.decode(np.frombuffer(b"".join(rows), "<u4").astype(np.int64))
                stops = np.cumsum([0, *(len(x) // 4 for x in rows)])
                offsets = decoder.offsets(np.frombuffer(b"".join(rows), "<u4").astype(np.int64))[stops]
                whole = out.tobytes()
                yield batch_with(part, pa.array([whole[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()))

    return with_columns(encoded, run, [T.StructField(into, T.BinaryType())])


def round_trip(docs: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with both columns of `encode` and `decode`, made by one worker: the decoder sees nothing but the ids."""
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_vocabulary(path or default_path()))
    docs = without(docs, ids, into)
    at = docs.columns.index("text")

    def run(batches):
        encoder, decoder = _once(Encoder, shared), _once(Decoder, shared)
        for batch in batches:
            coded = list(encoder.encode(["" if t is None else t for t in batch.column(at).to_pylist()]))
            plain = [decoder.decode(np.frombuffer(x, "<u4").astype(np.int64)).tobytes() for x in coded]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.binary()), pa.array(plain, pa.binary())], names=[*batch.schema.names, "r0", "r1"])

    return with_columns(docs, run, [T.StructField(ids, T.BinaryType()), T.StructField(into, T.BinaryType())])


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHUNK ids."""
    sizes = [len(x.as_buffer()) // 4 if x.is_valid else 0 for x in batch.column(at)]
    a = n = 0
    for i, s in enumerate(sizes):
        if i > a and n + s > CHUNK:
            yield batch.slice(a, i - a)
            a, n = i, 0
        n += s
    if len(sizes) > a:
        yield batch.slice(a)


def batch_with(batch: pa.RecordBatch, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "r0"])


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")
