"""LM scoring by online logistic context mixing.

A text is its words, A-Z lower-cased, and one end. Each is a string of bits: the path of a known word in a tree over
the training words, or an escape and the word's bytes (see `mixmodel`). Bits of paths are predicted from hashed contexts:
all texts, the document's class (a hash of its language), and class and word before; bits of bytes from the last one, two
and three bytes, each with the class. The predictions' logits are summed with weights chosen by a gate (how much evidence
a context has, whether it has seen one bit only, how often new words follow it); an adaptive table refines the result. Both learn
online: a bucket predicts its events in turn, some thousand to a step, and learns from each step's training events before
the next; an event is left out of its own counts, and events of a step with equal inputs are computed once. The sum over all bits is the score;
with it come the bits for each byte.

Words that training has twice are known in training texts, those that it has once in held-out texts: a training text is
scored by what the others say. All counts are exact sums and all learning runs in streams that the data alone decide, so
scores do not depend on partitions, blocks or runs.

What grows with the corpus stays distributed. Documents are dealt into blocks. Each block sends its distinct words to
ranges of the lexicon (by hash), which send back counts, codes and spellings; then its distinct events (context, word),
with the texts that have them, to buckets of contexts, which send back what their words add to each text. Successors of a frequent
context are split by the first bits of their codes; the counts above those bits, 64 for each of at most 2 ** SHARE
frequent contexts, are broadcast, as are tables of fixed size. Nothing on the driver grows with the corpus.

Cases: null counts as empty, which has the end alone; null languages are a class; a null doc_id is the empty string
to the split; without training documents every count is 0 and the base score 0; repeated rows score alike; very long
texts and words are handled whole; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ready
from .mixmodel import CLASSES, HEAD, TABLE_BITS, Speller, Successors, cells, escapes, spell_mixer, tops, word_codes, word_mixer
from .words import CHUNK, hashed_words, mix, word_hashes

FOLDS, HELD_OUT = 7, 2
#: Bytes of input (as Spark estimates it) in a block of documents.
BLOCK_BYTES = 6_000_000
#: Ranges of hashes in which blocks send their words.
SLOT_BITS = 10
#: Training tokens to a learning stream.
STREAM = 1 << 20
#: A context is frequent from a 2 ** -SHARE of the training tokens on, but not below LEAST.
SHARE, LEAST = 14, 1 << 23
#: Units of a bit in the scores that buckets send back.
UNIT = 1 << 16
_GOLD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_END = mix(np.zeros(1, np.uint64))[0]
_ENTRY = np.dtype([("c", "<i8"), ("code", "<u8"), ("s", "<f4"), ("hot", "u1")])


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def squeezed(a: np.ndarray | bytes, level: int = 1) -> bytes:
    """Compressed, numbers by byte planes, in which zeros meet."""
    if not isinstance(a, bytes):
        a = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.Codec("zstd", level).compress(a, asbytes=True)


def blown(data: bytes, dtype=None) -> np.ndarray | bytes:
    out = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    if dtype is None:
        return out
    return np.ascontiguousarray(np.frombuffer(out, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each distinct key in order, each key's number, and how often each comes."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)  # much faster than argsort
    found = keys[order]
    if (found[1:] < found[:-1]).any():  # some keys differ in the low bits alone
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    start, stop = runs(found)
    number = np.empty(len(keys), np.int32)
    number[order] = np.repeat(np.arange(len(start), dtype=np.int32), stop - start)
    return order[start], number, stop - start


def grouped(batches, columns: int = 1):
    """(key, rows) for each run of rows with equal first columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:columns] != key:
                if held:
                    yield key, held
                key, held = row[:columns], []
            held.append(row[columns:])
    if held:
        yield key, held


def classed(words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return mix(words + classes.astype(np.uint64) * _GOLD)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start and stop."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return start, np.append(start[1:], len(x)) if len(x) else start


def _listed(key: str, value: int, names, rows: list[tuple]) -> pa.RecordBatch:
    """One row of all rows: the key and a list for each column, the first of numbers, the others of bytes."""
    lists = [pa.array([[r[i] for r in rows]], pa.list_(pa.int32() if i == 0 else pa.binary())) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array([value], pa.int32()), *lists], names=[key, *names])


# Documents by block


def packed_texts(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, th, ids, classes, sizes, texts): the documents of a batch that go to one block, compressed; null ids have no bytes."""

    def run(batches):
        for batch in batches:
            block, classes, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            ids = batch.column(1)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            order = np.argsort(block, kind="stable")
            start, stop = runs(block[order])
            for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                at = order[a:b]
                mine = [texts[i] for i in at.tolist()]
                fields = (ids[at], known[at].astype(np.uint8), classes[at].astype(np.uint8), np.fromiter(map(len, mine), np.int64, len(mine)))
                yield pa.RecordBatch.from_arrays([pa.array([block[at[0]]], pa.int32()), *(pa.array([squeezed(f)], pa.binary()) for f in fields), pa.array([squeezed(b"".join(mine), 3)], pa.binary())], names=["block", "ids", "known", "classes", "sizes", "texts"])

    return docs.mapInArrow(run, "block int, ids binary, known binary, classes binary, sizes binary, texts binary")


def _texts(rows: list[tuple]):
    """(ids, classes, texts) of packed rows, CHUNK bytes or so at a time."""
    held, size = ([], [], []), 0
    for row in rows:
        ids, known, classes, sizes = (blown(d, t) for d, t in zip(row, ("<i8", "u1", "u1", "<i8"), strict=False))
        data, ends = blown(row[4]), np.cumsum(sizes)
        for i, k, z, y, n in zip(ids.tolist(), known.tolist(), classes.tolist(), ends.tolist(), sizes.tolist(), strict=True):
            if held[0] and size + n > CHUNK:
                yield held[0], np.array(held[1]), held[2]
                held, size = ([], [], []), 0
            held[0].append(i if k else None)
            held[1].append(z)
            held[2].append(data[y - n : y])
            size += n
    if held[0]:
        yield held[0], np.array(held[1]), held[2]


# Words of blocks, and the lexicon


def picked(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Some stretches of the data, one after the other."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _distinct(ids: list, classes: np.ndarray, texts: list[bytes]):
    """Hash, class, training count and length of the distinct (word, class) of some texts, their ends included, and their bytes."""
    hashes, bounds, data, starts, stops = hashed_words(texts)
    sizes = np.diff(bounds)
    learn = np.array([not held_out(i) for i in ids])
    own = np.repeat(classes, sizes)
    at, inverse, _ = distinct(classed(hashes, own))
    count = np.bincount(inverse, np.repeat(learn, sizes), len(at)).astype(np.int64)
    lengths = stops[at] - starts[at]
    z, n = np.unique(classes, return_inverse=True)
    ends = np.bincount(n, learn, len(z)).astype(np.int64)
    return np.append(hashes[at], np.full(len(z), _END)), np.append(own[at], z), np.append(count, ends), np.append(lengths, np.zeros(len(z), np.int64)), picked(data, starts[at], lengths)


_WORDS = "slot int, block int, mass long, hashes binary, classes binary, counts binary, lengths binary, words binary"


def block_words(blocked: DataFrame) -> DataFrame:
    """For each block and slot of hashes the distinct (word, class) with their training counts, 0 included."""

    def out(block, held):
        hashes, classes, counts, lengths, data = map(np.concatenate, zip(*held, strict=True))
        at, inverse, _ = distinct(classed(hashes, classes))
        counts = np.bincount(inverse, counts, len(at)).astype(np.int64)
        order = np.lexsort((classes[at], hashes[at]))
        at, counts = at[order], counts[order]
        hashes, classes, first, lengths = hashes[at], classes[at], (np.cumsum(lengths) - lengths)[at], lengths[at]
        data = picked(data, first, lengths)
        ends, lengths = np.concatenate([[0], np.cumsum(lengths)]), lengths.astype(np.int32)
        start, stop = runs(hashes >> np.uint64(64 - SLOT_BITS))
        rows = [(int(hashes[a] >> np.uint64(64 - SLOT_BITS)), block, int(counts[a:b].sum()), squeezed(hashes[a:b]), classes[a:b].astype(np.uint8).tobytes(), squeezed(counts[a:b]), squeezed(lengths[a:b]), squeezed(data[ends[a] : ends[b]].tobytes())) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _WORDS.split(", ")])

    def run(batches):
        for (block,), rows in grouped(batches):
            held = [_distinct(*part) for part in _texts(rows)]
            yield out(block, held)

    return blocked.mapInArrow(run, _WORDS)


class Words:
    """A range of the lexicon: distinct (word, class) in order of hash and class, with n, the word's total, bytes and blocks."""

    def __init__(self, rows: list[tuple]):
        """rows: (block, hashes, classes, counts, lengths, words)."""
        parts = [(blown(h, "<u8"), np.frombuffer(z, np.uint8), blown(n, "<i8"), blown(w, "<i4"), np.frombuffer(blown(data), np.uint8)) for _, h, z, n, w, data in rows]
        hashes, classes, counts, lengths, data = (np.concatenate(p) for p in zip(*parts, strict=True))
        classes = classes.astype(np.int64)
        order = np.lexsort((classes, hashes))
        new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (classes[order][1:] != classes[order][:-1])])
        which = np.cumsum(new) - 1
        first = order[new]
        self.hashes, self.classes = hashes[first], classes[first]
        self.n = np.bincount(which, counts[order]).astype(np.int64)
        self.word = np.cumsum(np.concatenate([[True], self.hashes[1:] != self.hashes[:-1]])) - 1
        self.total = np.bincount(self.word, self.n).astype(np.int64)[self.word]
        start, size = (np.cumsum(lengths) - lengths)[first], lengths[first].astype(np.int64)
        self.speller = Speller(picked(data, start, size), size, self.classes)
        of = np.repeat([r[0] for r in rows], [len(p[0]) for p in parts])
        self.asked = which, of[order]  # sorted by row: the blocks that have it

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (the first), class and count of each word with training counts, in order of class and hash; a word is of its most frequent class."""
        best = np.lexsort((self.classes, -self.n, self.word))
        first = best[np.concatenate([[True], self.word[1:] != self.word[:-1]])] if len(best) else best
        first = first[self.total[first] > 0]
        order = np.lexsort((self.hashes[first], self.classes[first]))
        first = first[order]
        return first, self.classes[first], self.total[first]

    def codes(self, lo: np.ndarray, bits: int) -> np.ndarray:
        """Per row its word's code, 0 for unknown words."""
        first, classes, counts = self.known()
        by_word = np.zeros(int(self.word[-1]) + 1 if len(self.word) else 0, np.uint64)
        by_word[self.word[first]] = word_codes(classes, counts, lo, bits)
        return by_word[self.word]


def _sums(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(kind, key, n) rows."""
    kinds = np.concatenate([np.full(len(k), kind, np.int32) for kind, k, _ in rows])
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.concatenate([np.asarray(r[i], np.int64) for r in rows])) for i in (1, 2))], names=["kind", "key", "n"])


_SUMS = "kind int, key long, n long"


def added(df: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and sums by kind, in order of key; as many keys as the model's fixed tables have."""
    found = df.groupBy("kind", "key").agg(F.sum("n").alias("n")).orderBy("kind", "key").toArrow()
    kind, key, n = (found[c].to_numpy() for c in ("kind", "key", "n"))
    return {int(k): (key[kind == k], n[kind == k]) for k in np.unique(kind)}


_NONE = (np.zeros(0, np.int64), np.zeros(0))


# Events


class Events:
    """The distinct (context, word, held out or not) of a block's texts, and which texts have them."""

    def __init__(self, rows: list[tuple], entries: np.ndarray, escape: np.ndarray, bits: int):
        """entries: of the block's distinct (word, class), in order of hash and class."""
        self.ids, words, classes, sizes, learn = [], [], [], [], []
        for ids, z, texts in _texts(rows):
            hashes, bounds = word_hashes(texts)
            words.append(np.insert(hashes, bounds[1:], _END))
            sizes.append(np.stack([np.diff(bounds) + 1, [len(t) for t in texts]], 1))
            classes.append(z)
            learn += [not held_out(i) for i in ids]
            self.ids += ids
        word, self.classes, self.sizes, learn = np.concatenate(words), np.concatenate(classes), np.concatenate(sizes), np.array(learn)
        del words
        n, size = len(self.ids), self.sizes[:, 0]
        own = np.repeat(np.arange(n, dtype=np.int32), size)
        z = self.classes.astype(np.uint8)[own]
        key = classed(word, z)
        at, number, _ = distinct(key)
        place = np.empty(len(at), np.int32)
        place[np.lexsort((z[at], word[at]))] = np.arange(len(at), dtype=np.int32)
        of = np.empty(len(at), np.uint8)
        of[place] = z[at]
        at = place[number]  # each word's entry
        count, hot = np.ascontiguousarray(entries["c"]), entries["hot"] > 0
        hidden = np.stack([count < 1, count < 2])  # held out; in training
        code, spelled = np.where(hidden, escape[of], entries["code"]).ravel(), np.where(hidden, entries["s"], np.float32(0)).ravel()
        train, start = learn[own], np.cumsum(size) - size
        either = at + train * len(count)
        self.known, self.base, self.spelled = (np.bincount(own, v, n) for v in ((count > 0)[at], np.log10(count + 1.0)[at], spelled[either]))
        code = code[either]
        context = np.empty(len(key), np.uint64)  # the word before with the class; the end stands before the first word
        context[1:] = key[:-1]
        split = np.concatenate([[False], hot[at[:-1]]])
        last = start + size - 1
        context[start], split[start] = key[last], hot[at[last]]
        context = mix(context + _OTHER)
        del word, key, number, place, either, at
        at, number, times = distinct(mix(context + mix(code + train * _GOLD)))
        context, code, split, train = context[at], code[at], split[at], train[at]
        to = np.where(split, mix(context + (code >> np.uint64(64 - HEAD))), context)
        order = np.argsort(to)  # all rows of a context in a bucket are together
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order), dtype=np.uint64) << np.uint64(32)
        to = to[order]
        self.bucket = (to >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
        self.context, self.code, self.split, self.train, self.times = context[order], code[order], split[order], train[order], times[order]
        self.context_class = z[at][order]
        self.own = (np.sort(place[number] | own.astype(np.uint64)) & np.uint64((1 << 32) - 1)).astype(np.int32)  # the texts of each row in turn


_EVENTS = "bucket int, kind int, block int, contexts binary, classes binary, splits binary, lengths binary, codes binary, counts binary, owners binary"


def _packed(events: Events, block: int, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, and one of kind 0 for the block itself, which a bucket hands on."""
    ids = np.array([0 if i is None else i for i in events.ids], np.int64)
    known = np.array([i is not None for i in events.ids], np.uint8)
    rows = [(block % buckets, 0, block, *(squeezed(f) for f in (ids, known, events.classes.astype(np.uint8), np.ascontiguousarray(events.sizes).ravel(), np.concatenate([events.known, events.base, events.spelled]))), b"", b"")]
    ends = np.concatenate([[0], np.cumsum(events.times)])
    for a, b in zip(*(x.tolist() for x in runs(events.bucket)), strict=True):
        start, stop = runs(events.context[a:b])
        at = a + start
        fields = (events.context[at], events.context_class[at], events.split[at].astype(np.uint8), (stop - start).astype(np.int32), events.code[a:b], (2 * events.times[a:b] + events.train[a:b]).astype(np.int32), events.own[ends[a] : ends[b]])
        rows.append((int(events.bucket[a]), 1, block, *map(squeezed, fields)))
    types = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 7)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _EVENTS.split(", ")])


class Bucket:
    """The distinct (context, word) of a bucket, and each block's rows among them."""

    def __init__(self, rows: list[tuple], top: np.ndarray, frequent: tuple | None = None):
        """rows: (block, contexts, classes, splits, lengths, codes, counts, owners). frequent: contexts in order, their heads and kinds."""
        sizes, parts = [], []
        for _, contexts, classes, splits, lengths, codes, counts, _ in rows:
            n = blown(lengths, "<i4")
            parts.append((np.repeat(blown(contexts, "<u8"), n), np.repeat(blown(classes, "u1"), n), np.repeat(blown(splits, "u1"), n), blown(codes, "<u8"), blown(counts, "<i4")))
            sizes.append(len(parts[-1][3]))
        context, classes, split, codes, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        order = np.lexsort((codes, context))
        new = np.concatenate([[True], (context[order][1:] != context[order][:-1]) | (codes[order][1:] != codes[order][:-1])])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        self.rows, self.sizes, self.which, self.times, self.train = rows, sizes, which, counts >> 1, counts & 1
        self.context, self.codes, self.split = context[first], codes[first], split[first] > 0
        self.n = np.bincount(which, self.times * self.train).astype(np.int64)
        head = heads = kinds = None
        if frequent is not None and len(frequent[0]):
            names, heads, kinds = frequent
            at = np.minimum(np.searchsorted(names, self.context), len(names) - 1)
            head = np.where(self.split & (names[at] == self.context), at, -1)
        self.successors = Successors(self.context, classes[first].astype(np.int64), self.codes, self.n, top, head, heads, kinds)

    def sums(self):
        """(block, texts, what the bucket's words add to their scores, in UNITs of a bit)."""
        pairs, inverse = np.unique(self.which * 2 + self.train, return_inverse=True)
        row, learn = pairs >> 1, (pairs & 1) > 0
        found = self.successors.score(word_mixer(), row, learn, np.where(learn, self.n[row], 0))
        units, a = np.rint(found * UNIT).astype(np.int64)[inverse], 0
        for (block, *_, owners), n in zip(self.rows, self.sizes, strict=True):
            b = a + n
            own = blown(owners, "<i4")
            total = np.bincount(own, np.repeat(units[a:b], self.times[a:b])).astype(np.int64)  # exact: whole numbers
            texts = np.flatnonzero(total)
            yield block, texts.astype(np.int32), total[texts]
            a = b


def _blocks(docs: DataFrame) -> int:
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2, -(-size // BLOCK_BYTES)) if size < 1 << 50 else 2 * max(docs.rdd.getNumPartitions(), 2)


def score_documents(docs: DataFrame, blocks: int | None = None, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte); model gets the counts of all texts."""
    spark = ready(docs.sparkSession)
    blocks = blocks or _blocks(docs)
    language = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = docs.select(
        F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.pmod(F.xxhash64(language), F.lit(CLASSES)).cast("int").alias("class"),
        F.coalesce(F.encode("text", "utf-8"), F.encode(F.lit(""), "utf-8")).alias("data"),
    )
    packed = packed_texts(text, blocks)
    raw = materialize(block_words(packed.repartition(blocks, "block").sortWithinPartitions("block")), "block-words")
    tokens = raw.agg(F.sum("mass")).first()[0] or 0
    streams, frequent = (tokens // STREAM).bit_length(), max(LEAST, tokens >> SHARE)
    few = min(streams, SLOT_BITS)
    columns = ("block", "hashes", "classes", "counts", "lengths", "words")

    def gather(batches):
        for (part,), rows in grouped(batches):
            yield _listed("part", part, columns, rows)

    lexicon = raw.withColumn("part", F.shiftright("slot", SLOT_BITS - few)).repartition(min(1 << few, 8 * blocks), "part")
    lexicon = lexicon.select("part", *columns).sortWithinPartitions("part", "block").mapInArrow(gather, "part int, block array<int>, " + ", ".join(f"{c} array<binary>" for c in columns[1:]))
    lexicon = materialize(lexicon, "lexicon")
    discard(raw)

    def ranges(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield row["part"], Words(list(zip(*(row[c] for c in columns), strict=True)))

    def survey(batches):
        for part, words in ranges(batches):
            first, classes, counts = words.known()
            region, of = np.unique(classes, return_inverse=True)
            once = words.classes[(words.total == 1) & (words.n == 1)]
            end = words.hashes == _END
            rows = [(0, region << SLOT_BITS | part, np.bincount(of, counts, len(region)) if len(of) else region), (1, [0], [len(first)]), (2, once, np.ones(len(once))), (3, words.classes[end], words.n[end]), (4, [0], [(words.n >= frequent).sum()])]
            rows += [(5 + k, keys, n) for k, (keys, n) in enumerate(words.speller.table_counts(np.flatnonzero(words.n > 0)))]
            yield _sums(rows)

    found = added(lexicon.mapInArrow(survey, _SUMS))
    known, hot = (int(found.get(k, _NONE)[1].sum()) for k in (1, 4))
    class_docs = np.bincount(*found.get(3, _NONE), CLASSES)
    regions = np.bincount(*found.get(0, _NONE), CLASSES << SLOT_BITS).reshape(CLASSES, -1)[:, : 1 << few]
    starts, escape, width = escapes(regions, np.bincount(*found.get(2, _NONE), CLASSES))
    tables = Speller.running(*zip(*(found.get(5 + k, _NONE) for k in range(len(TABLE_BITS))), strict=True))
    shared = spark.sparkContext.broadcast((starts, tables))  # of fixed size

    def rate(batches):
        lo, tables = shared.value
        for part, words in ranges(batches):
            codes, seen = words.codes(lo[:, part], width), words.n > 0
            entry = np.zeros(len(words.n), _ENTRY)
            entry["c"], entry["code"], entry["hot"] = words.total, codes, words.n >= frequent
            asked = np.flatnonzero((words.total == 0) | (words.total == 1) & seen)
            entry["s"][asked] = np.rint(64 * words.speller.score(spell_mixer(), asked, seen[asked], tables)) / 64
            row, block = words.asked
            order = np.argsort(block, kind="stable")
            row, block = row[order], block[order]
            parts = [(int(block[a]), squeezed(entry[row[a:b]])) for a, b in zip(*(x.tolist() for x in runs(block)), strict=True)]
            parts.append((-1, squeezed(np.stack(cells(np.where(words.total == 1, escape[words.classes], codes)[seen], words.classes[seen], words.n[seen]), 1).ravel())))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(parts), pa.int32()), pa.array([b for b, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], names=["part", "block", "data"])

    def unpacked_cells(batches):
        for batch in batches:
            for data in batch.column(2).to_pylist():
                keys, n = blown(data, "<i8").reshape(-1, 2).T
                yield _sums([(0, keys, n)])

    rated = materialize(lexicon.mapInArrow(rate, "part int, block int, data binary"), "entries")
    discard(lexicon)
    top = tops(*added(rated.where("block < 0").mapInArrow(unpacked_cells, _SUMS)).get(0, _NONE))
    none = F.lit(None).cast("binary")
    fields = ("ids", "known", "classes", "sizes")
    entries = rated.where("block >= 0").select("block", F.col("part").alias("kind"), *(none.alias(c) for c in fields), F.col("data").alias("texts"))
    dealt = entries.unionByName(packed.withColumn("kind", F.lit(1 << SLOT_BITS))).repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def send(batches):
        for (block,), rows in grouped(batches):
            entry = np.concatenate([blown(r[5], _ENTRY) for r in rows if r[0] < 1 << SLOT_BITS])  # in order of part
            yield _packed(Events([r[1:] for r in rows if r[0] == 1 << SLOT_BITS], entry, escape, streams), block, 1 << streams)

    sent, often = dealt.mapInArrow(send, _EVENTS), None
    if hot:  # at most 2 ** SHARE contexts, 2 ** HEAD rows each
        sent = materialize(sent, "events")

        def heads(batches):
            for batch in batches:
                for contexts, splits, lengths, codes, counts in zip(*(batch.column(k).to_pylist() for k in (3, 5, 6, 7, 8)), strict=True):
                    n = blown(lengths, "<i4")
                    counts = blown(counts, "<i4")
                    at = np.flatnonzero(np.repeat(blown(splits, "u1"), n) & (counts & 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(blown(contexts, "<u8"), n)[at].view(np.int64)), pa.array(blown(codes, "<u8")[at].view(np.int64)), pa.array((counts[at] >> 1).astype(np.int64))], names=["context", "code", "n"])

        words = sent.where("kind = 1").mapInArrow(heads, "context long, code long, n long").groupBy("context", "code").agg(F.sum("n").alias("n"))
        rows = words.groupBy("context", F.shiftrightunsigned("code", 64 - HEAD).alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
        context, at = np.unique(rows["context"].to_numpy().view(np.uint64), return_inverse=True)
        full = np.bincount((at << HEAD) + rows["cell"].to_numpy(), rows["n"].to_numpy(), len(context) << HEAD).reshape(len(context), -1)
        often = context, np.concatenate([np.zeros((len(context), 1)), np.cumsum(full, 1)], 1), np.bincount(at, rows["kinds"].to_numpy(), len(context))
    counted = spark.sparkContext.broadcast((top, often))
    if model is not None:
        model |= {"tokens": tokens, "escape": escape, "top": top, "tables": tables, "often": often}

    def answer(batches):
        for (_, kind), rows in grouped(batches, 2):
            if not kind:
                for r in rows:
                    yield _row(r[0], 0, r[1:6])
                continue
            bucket = Bucket(rows, *counted.value)
            for block, texts, units in bucket.sums():
                yield _row(block, 1, (squeezed(texts), squeezed(units), None, None, None))

    def _row(block, kind, data):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], names=["block", "kind", *"abcde"])

    prior = np.log10((class_docs + 1) / (class_docs.sum() + CLASSES))
    log_all = np.log10(tokens + known + 1)

    def total(batches):
        for _, rows in grouped(batches):
            ids, valid, classes, sizes, sums = (blown(d, t) for d, t in zip(rows[0][1:], ("<i8", "u1", "u1", "<i8", "<f8"), strict=True))
            ids, n = [i if k else None for i, k in zip(ids.tolist(), valid.tolist(), strict=True)], len(ids)
            (words, size), (n_known, base, spelled) = sizes.reshape(-1, 2).T, sums.reshape(3, -1)
            units = np.zeros(n, np.int64)
            for r in rows[1:]:
                units[blown(r[1], "<i4")] += blown(r[2], "<i8")
            score = (units / UNIT + spelled) * np.log10(2) + prior[classes]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(words), pa.array(n_known.astype(np.int64)),
                pa.array(np.full(n, tokens, np.int64)), pa.array(base - words * log_all), pa.array(score), pa.array(-score * np.log2(10) / np.maximum(size, 1)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    dealt = sent.repartition(min(1 << streams, 8 * blocks), "bucket").sortWithinPartitions("bucket", "kind", "block")
    answers = dealt.mapInArrow(answer, "block int, kind int, " + ", ".join(f"{c} binary" for c in "abcde"))
    return answers.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
