"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles, held as 64-bit hashes. Its signature has chunks of r minhash
values of 16 bits each. Two signatures that differ in at most 2 * chunks - 1 values have, by pigeonhole, a chunk with
one error at most; every chunk is therefore indexed r times, each time without one of its values, so that such pairs
always meet in a bucket. Pairs of a small bucket are tested by their signatures' distance; the members of a full one, of
which pairs would be too many, are tied to its smallest document. The components of both are clusters, and within a
cluster all sets are intersected exactly through posting lists, in pairs of blocks when it is large. The links found, a forest for each block pair, give the final components.

Equal sets are one class from the start, whatever its size; only class representatives are indexed.

Cases: null texts and texts without words have an empty set, link with nothing and are their own component; with
fewer words than a shingle the whole sequence is the one shingle; a row with a null doc_id has no component (null, and so
is kept), whatever its text; rows that share a doc_id are one node and share their component; copies tie and the smallest
id stays; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, ready
from .graph import components
from .words import shingle_sets

#: Shingles in a block of a cluster: two blocks' sets and posting lists are in memory at once.
BLOCK = 1_000_000


class Index:
    """Signature and bucket keys: chunks of r values, each chunk indexed without each of its values in turn."""

    def __init__(self, chunks: int, r: int, seed: int = 7):
        self.chunks, self.r, self.size = chunks, r, chunks * r
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 2**63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.weights = rng.integers(0, 2**63, (self.size, r), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signatures(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[documents, size] 16-bit minhashes of consecutive non-empty sets."""
        out = np.empty((len(sizes), self.size), np.uint16)
        first, a = np.concatenate([[0], np.cumsum(sizes)]), 0
        while a < len(sizes):  # parts that fit the processor's cache
            b = max(a + 1, int(np.searchsorted(first, first[a] + 30_000, "right")) - 1)
            part, starts = hashes[first[a] : first[b]], first[a:b] - first[a]
            for i, f in enumerate(self.factors):
                low = np.minimum.reduceat(part * f, starts)
                out[a:b, i] = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            a = b
        return out

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """[documents, size] bucket keys: position j of a chunk is the chunk without its j-th value."""
        values = signatures.astype(np.uint64) + np.uint64(1)
        out = np.empty(values.shape, np.uint64)
        for c in range(self.chunks):
            chunk = values[:, c * self.r : (c + 1) * self.r]
            for j in range(self.r):
                w = self.weights[c * self.r + j].copy()
                w[j] = 0
                out[:, c * self.r + j] = (chunk * w).sum(1, dtype=np.uint64) + np.uint64(c * self.r + j)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return (out ^ (out >> np.uint64(29))).view(np.int64)


#: The chance that a pair exactly at the threshold meets in no bucket, and the one that it fails the signature test.
MISS, FAR = 2.5e-5, 1e-6
#: Values in a signature, at most; buckets of more members than SMALL are tied to their least member as they are.
VALUES, SMALL = 63, 8


def index_for(percent: int) -> Index:
    """The longest chunks with which so few pairs at the threshold are missed: 9 x 7 at 85, 10 x 6 at 80, 11 x 4 at 70, 16 x 3 at 50."""
    q = min(max(percent, 1), 99) / 100
    for r in range(7, 1, -1):
        meets = q**r + r * q ** (r - 1) * (1 - q)  # a chunk with one error at most
        chunks = math.ceil(math.log(MISS) / math.log(1 - meets))
        if chunks * r <= VALUES:
            return Index(chunks, r)
    return Index(chunks, r)


def reach(percent: int, size: int) -> int:
    """Values in which two signatures may differ: a pair at the threshold differs in more with a chance of FAR."""
    p, most, tail = 1 - percent / 100, size, 0.0
    while most and (tail := tail + math.comb(size, most) * p**most * (1 - p) ** (size - most)) <= FAR:
        most -= 1
    return most


def set_table(docs: DataFrame, words: int, index: Index) -> DataFrame:
    """(doc_id, n_shingles, class, signature); class is a 128-bit hash of the set, null if that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sets in shingle_sets(batch.column(0), batch.column(1), words):
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                signatures = index.signatures(np.concatenate([sets[i] for i in full]), sizes[full]) if len(full) else ()
                classes, signed = [None] * len(sets), [None] * len(sets)
                for i, s in zip(full, signatures, strict=True):
                    classes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    signed[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signed, pa.binary())], names=["doc_id", "n_shingles", "class", "signature"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, class binary, signature binary")


def candidates(reps: DataFrame, index: Index, percent: int) -> DataFrame:
    """(a, b): pairs that share a bucket and differ in few values; members of a full bucket are all tied to its smallest."""

    def run(batches):
        for batch in batches:
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, index.size)
            keys = index.keys(signatures)
            offsets = np.arange(0, keys.size + 1, index.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, keys.ravel())], names=["rep", "keys"])

    most = reach(percent, index.size)

    def near(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, index.size) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(1) <= most))

    keyed = reps.select("rep", "signature").mapInArrow(run, "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(buckets, "key"), "bucket-members")
    stars = members.where(f"n > {SMALL} and rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    few = members.where(f"n <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_set("rep")).alias("m"))  # SMALL at most
    later = F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(y.alias("a"), x.alias("b"))))
    pairs = few.select(F.inline(F.flatten(later))).distinct()
    one, two = (reps.select(F.col("rep").alias(r), F.col("signature").alias(f"s{r}")) for r in ("a", "b"))
    tested = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(near, "a long, b long")
    return stars.unionByName(tested).distinct()


def exact_links(groups: list[tuple], percent: int) -> list[tuple[int, int]]:
    """A forest of the links among the documents (group, node, set), within groups only."""
    sizes = np.array([len(s) for _, _, s in groups], np.int64)
    owner = np.repeat(np.arange(len(groups)), sizes)
    group = np.unique(np.array([g for g, _, _ in groups], dtype="S"), return_inverse=True)[1].astype(np.uint64)
    # The same shingle in two groups is two shingles.
    mixed = (np.concatenate([s for _, _, s in groups]) + np.repeat(group, sizes) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed, kind="stable")
    sorted_, docs = mixed[order], owner[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    term = np.empty(len(mixed), np.int64)
    term[order] = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(mixed))
    first = np.cumsum(sizes) - sizes
    parent = list(range(len(groups)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    shared = np.flatnonzero(stop - start > 1)
    is_shared = np.zeros(len(start), bool)
    is_shared[shared] = True
    for i in range(len(groups)):
        mine = term[first[i] : first[i] + sizes[i]]
        mine = mine[is_shared[mine]]
        if 100 * len(mine) < percent * sizes[i]:  # too few shingles that any other has
            continue
        lengths = stop[mine] - start[mine]
        at = np.repeat(start[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        with_i = docs[at]
        with_i = with_i[with_i < i]
        if not len(with_i):
            continue
        both = np.bincount(with_i, minlength=i)
        hit = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[:i] + sizes[i] - both)))
        for j in hit.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                links.append((groups[i][1], groups[j][1]))
    return links


def near_links(docs: DataFrame, clusters: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links confirmed on full sets; clusters has (node, cluster, block, blocks)."""

    def sets(batches):
        for batch in batches:
            at = 0
            for ids, found in shingle_sets(batch.column(0), batch.column(1), words):
                part = batch.slice(at, len(found))
                at += len(found)
                yield pa.RecordBatch.from_arrays([ids, part.column(2), part.column(3), part.column(4), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "cluster", "block", "blocks", "shingles"])

    def compare(batches):
        """Rows come sorted by group; whole groups are held until they have BLOCK shingles together."""
        held, size, last = [], 0, None
        for batch in batches:
            out = []
            for key, node, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and key != last:
                    out += exact_links(held, percent)
                    held, size = [], 0
                s = np.frombuffer(blob, np.uint64)
                if len(s):
                    held.append((key, node, s))
                    size += len(s)
                    last = key
            if out:
                yield _pairs(out)
        if held:
            yield _pairs(exact_links(held, percent))
        give_back()

    text = docs.select("doc_id", "text")
    with_sets = text.join(clusters, F.col("doc_id") == F.col("node")).select("doc_id", "text", "cluster", "block", "blocks").mapInArrow(sets, "node long, cluster long, block int, blocks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = with_sets.select("node", "shingles", "cluster", "block", other.alias("other"))
    key = F.concat_ws("/", "cluster", F.least("block", "other"), F.greatest("block", "other"))
    paired = paired.select(key.alias("key"), "node", "shingles").repartition("key").sortWithinPartitions("key", "node")
    return paired.mapInArrow(compare, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of the links 100 * |A & B| >= percent * |A | B|."""
    ready(docs.sparkSession)
    index = index_for(percent)
    table = materialize(set_table(docs, words, index), "shingle-sets")
    reps = table.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    reps = materialize(reps, "class-reps")
    clusters = components(candidates(reps, index, percent)).withColumnRenamed("component", "cluster")
    sized = clusters.join(reps.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "node")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    placed = sized.join(blocks, "cluster").select("node", "cluster", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    found = components(near_links(docs, materialize(placed, "clusters"), words, percent))
    labels = reps.join(found, reps["rep"] == found["node"], "left").select(F.col("class").alias("of"), F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return table.join(labels, F.col("class") == F.col("of"), "left").select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
