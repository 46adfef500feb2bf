"""Document fingerprints by winnowing.

The hashes of all runs of K code points are computed at once; in each window of W such hashes the minimum is
chosen, the rightmost on ties, and kept with its position. Texts that share W + K - 1 code points in a row
share a chosen hash. A text with fewer than W hashes is one window; one shorter than K has the hash of the whole.

A fingerprint is a string of 10 hexadecimal digits per choice: 8 of the hash, 2 of the distance from the choice
before (or the text's start), which is at most W. The likeness of two is the Jaccard index of their hash sets; two
empty ones are alike (1).

Cases: null counts as empty; an empty text has an empty fingerprint; equal texts have equal fingerprints; rows with
the same doc_id are ordered by their text's hash, and tie where that is equal; null doc_ids come last; a table of one row
is its own next document; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ready

K, W = 12, 32
CHUNK = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * (out[-1:] * base)])
    return out[:n]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of the runs of k code points: differences of one running sum, brought back to a common power."""
    n = len(points)
    if len(_tables.get("up", ())) < n + 1:
        _tables["up"], _tables["down"] = _powers(max(n + 1, CHUNK), _BASE), _powers(max(n + 1, CHUNK), _INVERSE)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _tables["up"][:n], out=run[1:])
    h = (run[k:] - run[:-k]) * _tables["down"][: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def choices(texts: list[str], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen hashes and their positions in their texts, and bounds: text i has the choices bounds[i]:bounds[i + 1]."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, grams = len(points), lengths - k + 1
    at, chosen = [], []
    if n >= k:
        index = np.arange(n - k + 1, dtype=np.uint64)
        key = rolling(points, k) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - index)  # the least is the rightmost on ties
        low, size = key, 1
        while 2 * size <= w and len(low) > size:  # minima over doubling windows
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < w and len(low) > w - size:
            low, size = np.minimum(low[: len(low) - (w - size)], low[w - size :]), w
        many = np.flatnonzero(grams >= w)
        if len(many):
            room = np.zeros(len(low) + 1, np.int32)  # 1 where a window lies in one text
            np.add.at(room, first[many], 1)
            np.add.at(room, first[many] + grams[many] - w + 1, -1)
            new = np.cumsum(room[:-1]) > 0
            change = np.ones(len(low), bool)
            change[1:] = low[1:] != low[:-1]
            change[first[many]] = True
            at_window = np.flatnonzero(new & change)
            chosen.append(low[at_window])
            at.append(np.repeat(many, np.diff(np.searchsorted(at_window, np.append(first[many], n)))))
        few = np.flatnonzero((grams >= 1) & (grams < w))
        if len(few):
            ends = np.stack([first[few], np.minimum(first[few] + grams[few], len(key))], 1).ravel()
            padded = np.append(key, np.uint64(0xFFFFFFFFFFFFFFFF))
            chosen.append(np.minimum.reduceat(padded, ends)[::2])
            at.append(few)
    text = np.concatenate(at) if at else np.zeros(0, np.int64)
    keys = np.concatenate(chosen) if chosen else np.zeros(0, np.uint64)
    place = (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64) - first[text]
    hashes = (keys >> np.uint64(32)).astype(np.uint32)
    if len(tiny := np.flatnonzero((lengths > 0) & (grams < 1))):
        whole = [int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") for i in tiny]
        text, hashes, place = np.concatenate([text, tiny]), np.concatenate([hashes, np.array(whole, np.uint32)]), np.concatenate([place, np.zeros(len(tiny), np.int64)])
    order = np.lexsort((place, text))
    text, hashes, place = text[order], hashes[order], place[order]
    return hashes, place, np.searchsorted(text, np.arange(len(texts) + 1))


def fingerprints(texts: list[str], k: int = K, w: int = W) -> list[tuple[str, frozenset[int]]]:
    """Per text its fingerprint and the set of its hashes."""
    hashes, place, bounds = choices(texts, k, w)
    gap = np.diff(place, prepend=0)
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    gap[starts] = place[starts]
    packed = np.empty((len(hashes), 5), np.uint8)
    packed[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    packed[:, 4] = gap
    raw, numbers, b = packed.tobytes(), hashes.tolist(), bounds.tolist()
    return [(raw[5 * x : 5 * y].hex(), frozenset(numbers[x:y])) for x, y in zip(b, b[1:], strict=False)]


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Ids that more rows have than a part should hold are split by their texts' hashes, into so many ranges at most.
RANGES = 4096


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, lookahead, doc_id, text), partitioned by part and sorted: each part ends with a copy of the next part's first row.

    Parts are ranges of (doc_id, text hash), descending. Their bounds come from a sample of ids, which decides on nothing
    but their sizes; an id that alone fills more than a part is cut into ranges of its hashes. The driver sees one id and
    hash for each part, and their number is that of the tasks, whatever that is. Texts are shuffled once.
    """
    spark = ready(docs.sparkSession)
    n = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = parts or 4 * n
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("i", id_).withColumn("th", F.xxhash64("text"))
    names = materialize(keyed.select("i", "th"), "ids")
    rows = names.count()
    each = max(1, rows // parts)
    bit = F.pmod(F.xxhash64(F.lit(3), "i", "th"), F.lit(max(1, each // 32))) == 0
    values = np.sort(names.where(bit).select("i").toArrow()["i"].to_numpy()) if rows else np.zeros(0, np.int64)  # some 32 for each part
    full = {r["i"]: r["n"] for r in names.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > 2 * each).where("n > 1").collect()}  # at most parts / 2
    full = {i: k for i, k in full.items() if abs(i) < 1 << 53 or i == -(2**63)}  # whose neighbours have other doubles
    cuts = {float(v) for v in values[np.arange(1, parts) * len(values) // parts].tolist()} if len(values) else set()
    cuts |= {x for i in full for x in (float(i), float(np.nextafter(float(i), np.inf)))}
    splits = [-np.inf, *sorted(cuts), np.inf]
    range_ = Bucketizer(splits=splits, inputCol="at", outputCol="range") if len(splits) > 2 else None

    def dealt(df: DataFrame) -> DataFrame:
        """With part: a row of ranges, descending, and within a full id of ranges of hashes."""
        df = df.withColumn("at", F.col("i").cast("double"))
        df = range_.transform(df) if range_ else df.withColumn("range", F.lit(0.0))
        wide = F.lit(1)
        if full:
            table = spark.createDataFrame([(i, min(RANGES, k // each + 1)) for i, k in full.items()], "of long, wide int")
            df = df.join(F.broadcast(table), F.col("i") == F.col("of"), "left")
            wide = F.coalesce("wide", F.lit(1))
        sub = F.floor((F.lit(0.5) - F.col("th") / F.lit(2.0**64)) * wide).cast("long")
        sub = F.greatest(F.lit(0), F.least(sub, wide - 1))
        return df.withColumn("part", ((len(splits) - F.col("range")).cast("long") * RANGES + sub))

    heads = dealt(names).groupBy("part").agg(F.max(F.struct("i", "th")).alias("head")).collect()  # one row a part
    heads = sorted((r["part"], r["head"]["i"], r["head"]["th"]) for r in heads)
    copies = [(p, i, th, heads[k - 1][0]) for k, (p, i, th) in enumerate(heads)]  # the first row follows the last
    edge = F.broadcast(spark.createDataFrame(copies, "edge_part long, edge_i long, edge_th long, before long"))
    same = (F.col("part") == F.col("edge_part")) & (F.col("i") == F.col("edge_i")) & (F.col("th") == F.col("edge_th"))
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("lookahead"))
    both = F.array(here, F.struct(F.col("before").alias("part"), F.lit(1).alias("lookahead")))
    out = dealt(keyed).join(edge, same, "left").select("doc_id", "text", "th", F.inline(F.when(F.col("before").isNull(), F.array(here)).otherwise(both)))
    return out.repartition(n, "part").sortWithinPartitions("part", "lookahead", F.col("doc_id").desc_nulls_last(), F.col("th").desc()).select("part", "lookahead", "doc_id", "text")


def compare_with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how like it they and the next document's are."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        held = None  # (part, doc_id, text, fingerprint, set) of the row that waits for its next
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            a = 0
            while a < len(columns[0]):
                b, size = a, 0
                while b < len(columns[0]) and (b == a or size + len(columns[3][b]) <= CHUNK):
                    size += len(columns[3][b])
                    b += 1
                part, ahead, ids, texts = (c[a:b] for c in columns)
                a = b
                prints = fingerprints(texts, k, w)
                rows = list(zip(part, ahead, ids, texts, prints, strict=True))
                pairs = []
                for row in rows:
                    if held is not None and held[0] == row[0]:
                        pairs.append((held, row))
                    held = None if row[1] else row
                if not pairs:
                    continue
                changed = [edited(x[3], y[3]) for x, y in pairs]
                after = fingerprints(changed, k, w)
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[2] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                    pa.array([x[4][0] for x, _ in pairs]),
                    pa.array([f for f, _ in after]),
                    pa.array([likeness(x[4][1], s) for (x, _), (_, s) in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([likeness(x[4][1], y[4][1]) for x, y in pairs], pa.float64()),
                ], names=[c.split()[0] for c in schema.split(", ")])

    return with_next(docs).mapInArrow(run, schema)
