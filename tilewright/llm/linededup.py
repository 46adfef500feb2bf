"""Line dedup by levelled sorted runs of line keys.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased. Documents come in batches
of ascending doc_id. The keys seen so far are kept as runs: Parquet tables sorted by key hash, each key in one run
with the document that owns it. A new batch is reduced to one row per key, merge-anti-joined with every run, and
what is left becomes a run of level 0; when a level has FANOUT runs they are compacted into one of the next level.
A line is dropped if its key's owner is a smaller document.

Keys are held as two 64-bit hashes of which the second is seeded, so an accidental match needs 128 equal bits.

Cases: a null or empty text is one empty line; keys of fewer than MIN_KEY code points never drop; all lines of a key
within the owning document stay, repeats included; rows that share a doc_id are one document to the others, each
row keeps its own lines; null doc_ids sort before all others; ties between documents cannot be, ids decide; very long
texts are split whole; an empty table gives an empty result; other columns pass through untouched whatever their names,
but those with the names of the two results, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, fresh, materialize, quoted, without

MIN_KEY = 10
BATCHES = 4
FANOUT = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs: levels[k] holds tables (h1, h2, owner), each sorted by (h1, h2) within its partitions."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """keys: (h1, h2, owner), one row per key of the batch; keys that a run has already keep their older owner."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._written(keys))
        k = 0
        while len(self.levels[k]) >= self.fanout:
            merged, self.levels[k] = self._union(self.levels[k]), []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._written(merged))
            k += 1

    def all(self) -> DataFrame:
        return self._union(self.runs())

    @staticmethod
    def _written(keys: DataFrame) -> DataFrame:
        return materialize(keys.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "line-run")

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out


def line_decisions(docs: DataFrame, min_key: int = MIN_KEY, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, th, drops): per document and text hash, which lines (by position) are dropped."""
    lines = docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("th"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(WHITE)))
    long_enough = F.char_length(key) >= min_key
    lines = lines.select(
        "doc_id", "th", "pos",
        F.when(long_enough, F.xxhash64(key)).alias("h1"),
        F.when(long_enough, F.xxhash64(F.lit(0x9E3779B9), key)).alias("h2"),
    )
    lines = materialize(lines, "line-keys")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)] or [0.5], 1000).alias("x")).first()["x"] or []
    cuts = sorted(set(cuts)) if batches > 1 else []  # batches of about as many documents; only their balance hangs on it
    keyed, runs = lines.where("h1 is not null"), LineRuns(fanout)
    for k in range(len(cuts) + 1):
        mine = F.lit(True) if not cuts else F.col("doc_id").isNull() | (F.col("doc_id") < cuts[0]) if k == 0 else F.col("doc_id") >= cuts[-1] if k == len(cuts) else (F.col("doc_id") >= cuts[k - 1]) & (F.col("doc_id") < cuts[k])
        batch = keyed.where(mine)
        # A null doc_id is the smallest: struct ordering puts nulls first.
        keys = batch.groupBy("h1", "h2").agg(F.min(F.struct("doc_id")).alias("owner"))
        runs.add(keys)
    owners = runs.all()
    judged = keyed.join(owners, ["h1", "h2"]).select("doc_id", "th", "pos", (F.struct("doc_id") > F.col("owner")).alias("drop"))
    judged = judged.unionByName(lines.where("h1 is null").select("doc_id", "th", "pos", F.lit(False).alias("drop")))  # short lines meet no other
    # Rows that are repeated in full have the same decisions: the set keeps one of each.
    per_doc = judged.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "drop"))).alias("x"))
    return per_doc.select("doc_id", "th", F.transform("x", lambda s: s["drop"]).alias("drops"))


def dedup_lines(docs: DataFrame, lines: str = "__lines", drops: str = "__drops", **settings) -> DataFrame:
    """The documents with two columns more: all lines, and which of them go."""
    docs = without(docs, lines, drops)
    of, th, found = (fresh(docs, n) for n in ("__of", "__th", "__found"))
    decided = line_decisions(docs.select("doc_id", "text"), **settings).toDF(of, th, found)
    out = docs.join(decided, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(F.lit(1), F.col("text")) == F.col(th)))
    return out.select(*[quoted(c) for c in docs.columns], lines_of(F.col("text")).alias(lines), F.col(found).alias(drops))


def kept_text(lines: str = "__lines", drops: str = "__drops") -> Column:
    return F.array_join(F.filter(F.col(lines), lambda x, i: ~F.element_at(F.col(drops), i + 1)), "\n")


def n_dropped(drops: str = "__drops") -> Column:
    return F.size(F.filter(drops, lambda d: d)).cast("long")
