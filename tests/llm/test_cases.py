"""Each text operator against brute force on small tables with awkward rows, and on empty tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import bpe, embdedup, graph, linededup, mixing, mixlm, mixmodel, neardup, quality, sharding, suffixdedup, winnow
from tilewright.llm.words import word_hashes

#: Names that the operators use inside.
EXTRA = ["h", "size", "block", "kind", "part", "th", "key", "n", "word", "times", "of", "doc", "data", "class", "component", "source_size", "cell", "node", "rep", "pos", "line", "drop", "score", "ids", "decoded", "a.b", "__lines", "__drops", "__of", "mix_of", "mix_copy", "expected_grade", "tail_probability", "i", "range", "slot", "shard", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
BASE = "the quick brown fox jumps over the lazy dog and runs far away from the barking hounds of the old mill by the river"
ROWS = [
    (1, f"{BASE}\nshared line of text here\nunique one", "en", "b"),
    (2, f"{BASE}\nshared line of text here\nunique two", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \n\t ", "en", "a"),
    (6, "zwei Wörter", "de", "a"),
    (7, f"{BASE}\nshared line of text here\nunique one", "en", "b"),
    (7, f"{BASE}\nshared line of text here\nunique one", "en", "b"),
    (8, "x" * 5000 + " " + "lorem ipsum " * 3000, "fr", "c"),
    (9, "short\n\nshort\n\n\nSHARED line of TEXT here  ", "en", None),
    (10, "it's 'tis we'll 12 ½ été \U0001f600 don't", "fr", "c"),
    (None, f"{BASE} tail", "en", "b"),
    (11, "ab " * 40 + BASE, "en", "a"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, 0, *["?"] * len(EXTRA)) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def by_row(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def test_sharding(docs, empty, spark):
    placed, slots = sharding.shard_documents(docs, 4, 64)
    rows = placed.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    for s in range(4):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert sharding.shard_documents(empty, 4, 64)[0].count() == 0


def test_shards_are_even(spark):
    """Bytes of many documents of very different sizes, by a count of their own."""
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.pareto(1.2, 4000) * 50)]
    placed = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8)[0].collect()
    size, load = {i: len(t) + 16 for i, t in rows}, collections.Counter()
    for r in placed:
        assert r["size"] == size[r["doc_id"]]
        load[r["shard"]] += size[r["doc_id"]]
    largest = max(size.values())
    assert len(placed) == 4000 and max(load.values()) <= max(largest * 1.01, 1.01 * sum(load.values()) / 8)


def test_slot_map(spark, tmp_path):
    load = np.random.default_rng(0).pareto(2, 512) * 100
    m = sharding.SlotMap.dealt(512, 7)
    m.rebalance(load)
    by = np.bincount(m.shards, load, 7)
    assert by.max() - by.min() < 0.01 * by.mean()
    before = m.shards.copy()
    m.grow()
    assert ((m.shards == before) | (m.shards == 7)).all() and (m.shards == 7).sum() >= 60
    m.save(spark, str(tmp_path / "map"))
    again = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    assert len(again.versions) == 3 and (again.shards == m.shards).all()


def test_stored_map_is_edited(spark, docs, tmp_path):
    path = str(tmp_path / "stored")
    first, m = sharding.shard_documents(docs, 3, 64, path)
    assert first.count() == len(ROWS) and len(m.versions) == 2
    grown, m = sharding.shard_documents(docs.where("doc_id < 9 or doc_id is null"), 4, 64, path)
    assert len(m.versions) == 4 and m.n_shards == 4 and grown.agg(F.max("map_version")).first()[0] == 3
    again = sharding.SlotMap.load(spark, path)
    assert again.n_shards == 4 and len(again.versions) == 4
    few = sharding.SlotMap(5, [np.array([0, 1, 2, 3, 3], np.int32)])  # the last shard has nothing
    few.save(spark, path)
    assert sharding.SlotMap.load(spark, path).n_shards == 5


def test_sharding_spreads_a_hot_key(spark):
    many = spark.createDataFrame([(None if i % 2 else i, f"text {i}") for i in range(400)], "doc_id long, text string")
    placed, _ = sharding.shard_documents(many, 4)
    rows = placed.groupBy("shard").agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.max("slot").alias("last")).collect()
    assert all(r["last"] == r["k"] - 1 for r in rows) and max(r["n"] for r in rows) < 1.1 * min(r["n"] for r in rows)


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    got = by_row(bpe.decode(bpe.encode(docs)), "doc_id", "ids", "decoded")
    assert got == collections.Counter((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in ROWS)
    assert bpe.decode(bpe.encode(empty)).count() == 0
    assert by_row(bpe.round_trip(docs), "doc_id", "ids", "decoded") == got and bpe.round_trip(empty).count() == 0


def test_bpe_vocabularies_do_not_mix(spark, tmp_path):
    """Two of one size that begin alike, one after the other in the same workers."""
    import base64

    texts = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    single = [b"!", *(bytes([k]) for k in range(256) if k != 33)]
    for last, want in ((b"ab", [256, 256]), (b"ba", [single.index(b"a"), 256, single.index(b"b")])):
        path = tmp_path / last.decode()
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate([*single, last])))
        row = bpe.decode(bpe.encode(texts, str(path)), str(path)).first()
        assert bytes(row["decoded"]) == b"abab"
        assert np.frombuffer(row["ids"], "<u4").tolist() == want


def test_bpe_random():
    import random

    import public_tokenizers
    import tiktoken

    ranks, r = bpe.read_ranks(bpe.default_path()), random.Random(0)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = [*" \n\t'strdmvl e!1é中　\x85\xa0x\r9.²½Ⅳ\x1c\x00", "'re", "'ll", "  ", "'ve", " '", "''", "\U0001f600"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, "!?" * 500, " " * 300, "ab" * 200 + "' re"]
    for t, ids in zip(texts, bpe.Encoder(ranks).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(t)


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(200)]
    make = lambda bad: " ".join(rng.choice(words, 60).tolist() + (["vilespeech"] * 3 if bad == 0 else ["###"] * 6 if bad == 1 else []))
    grades = rng.choice(3, 400, p=[0.2, 0.2, 0.6])
    many = spark.createDataFrame([(i, make(g)) for i, g in enumerate(grades)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, g in enumerate(grades) if i < 300], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.select(many, labels).collect()}
    assert np.mean([(i in kept) == (grades[i] == 2) for i in range(300, 400)]) > 0.95
    out = quality.score(docs, quality.fit(docs, labels.limit(0)), "q_")
    assert out.count() == len(ROWS) and out.columns[: len(docs.columns)] == docs.columns
    assert {r["q_tail_probability"] > 0.5 for r in out.where("doc_id in (1, 8)").collect()} == {True}
    assert {r["q_tail_probability"] for r in out.where("doc_id in (3, 4, 5)").collect()} == {0.0}
    assert quality.select(empty, labels).count() == 0
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).columns.count("score") == 1
    # Ratings of documents that are not here do not use the sample up; rows of one rated id count once.
    beyond = labels.unionByName(spark.range(1000, 40_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic"))
    found, _, got = quality.rated(many.unionByName(many), beyond, 100)
    assert len(found) == len(got) == 100
    odd = spark.createDataFrame([(0, 1, None), (1, None, 1), (None, 1, 0), (2, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(quality.rated(many, odd)[2].tolist()) == [0, 2]


def test_quality_scores_equal_the_plain_way(spark):
    """Every score from its document's own features, weight by weight; grades by the sum of their probabilities."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["good", "Fine", "bad", "ugly!!", "42"], int(rng.integers(1, 30)))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("ugly" not in t), int("bad bad" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).collect():
        (found, value), = quality.features([texts[r["doc_id"]].encode()])
        w = sum(float(np.float32(model.weights[f])) * float(v) for f, v in zip(found.tolist(), value.tolist(), strict=True))
        below = [1 / (1 + math.exp(w - t)) for t in model.thresholds]  # P(grade <= k)
        p = [below[0], below[1] - below[0], 1 - below[1]]
        assert r["score"] == pytest.approx(w, abs=1e-4) and r["expected_grade"] == pytest.approx(p[1] + 2 * p[2], abs=1e-4)
        assert r["tail_probability"] == pytest.approx(p[2], abs=1e-4)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    x = [np.array([int(rng.integers(50)), 50 + int(rng.integers(3))], np.int32) for _ in range(300)]
    y = np.array([f[1] - 50 for f in x])
    m = quality.Ordinal.fit(x, [np.ones(2, np.float32)] * 300, y)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(np.array([m.weights[f].sum() for f in x]))
    assert ((tails > 0.5).sum(1) == y).mean() > 0.95


def test_lm_scoring(spark, docs, empty):
    rows = {}
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t, *_ in ROWS]
    count = collections.Counter()
    for i, w in tokens:
        if not mixlm.held_out(i):
            count.update(w)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, mixlm.held_out(i), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    rows = mixlm.score_documents(docs, 3).collect()
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert mixlm.score_documents(empty, 2).count() == 0


def test_lm_score_knows_the_order(spark):
    """A held-out text beats its shuffled words; a training text has no credit for its own pairs; blocks do not matter."""
    held = [i for i in range(2000) if mixlm.held_out(i)][:2]
    train = [i for i in range(2000) if not mixlm.held_out(i)][:41]
    words = BASE.split()
    back = " ".join(words[::-1])
    rows = [*((i, BASE, "en", "a") for i in train[:40]), (train[40], back, "en", "a"), (held[0], BASE, "en", "a"), (held[1], back, "en", "a")]
    got = {r["doc_id"]: r["score"] for r in mixlm.score_documents(table(spark, rows), 3).collect()}
    alone = {r["doc_id"]: r["score"] for r in mixlm.score_documents(table(spark, rows), 1).collect()}
    assert alone == pytest.approx(got)
    assert got[held[0]] > got[held[1]] + 5
    assert got[held[0]] > got[train[40]] + 5 and got[held[1]] > got[train[40]]
    assert got[held[0]] > got[train[0]] > got[held[1]]


def plain_scores(rows, classes):
    """Scores event by event and bit by bit, with dictionaries of counts, weights and tables."""
    texts = [(i, z, [*(t or "").encode().lower().split(), b""]) for (i, t, *_), z in zip(rows, classes, strict=True)]
    train = [(z, w) for i, z, w in texts if not mixlm.held_out(i)]
    total = collections.Counter(x for _, w in train for x in w)
    by_class = collections.Counter((x, z) for z, w in train for x in w)
    hashed = {w: int(word_hashes([w])[0][0]) if w else int(mixlm._END) for w in total}
    home = {w: max(range(16), key=lambda z: (by_class[w, z], -z)) for w in total}
    rare = collections.Counter(home[w] for w in total if total[w] == 1)
    lo, spans = 0, []
    for z in range(16):
        for w in [None, *sorted((w for w in total if home[w] == z), key=hashed.get)]:
            n = rare[z] + 1 if w is None else total[w]
            spans.append((z, w, lo, n))
            lo += n
    bits = max(2, lo.bit_length())
    full = {}
    for z, w, at, n in spans:
        size = bits - n.bit_length() + 2
        full[z, w] = format((2 * at + n) >> (n.bit_length() - 1), f"0{size}b")
    path = {}
    for z in range(16):
        words = [w for y, w, *_ in spans if y == z and w is not None]
        for w in words:
            code = full[z, w]
            path[w] = ""
            for s in range(len(code)):
                run = [x for x in words if full[z, x][:s] == code[:s] and len(full[z, x]) > s]
                if len({full[z, x][s] for x in run}) > 1 or words[0] in run or words[-1] in run:
                    path[w] += code[s]

    def symbol(w, z, held):
        return path[w] if total[w] >= (1 if held else 2) else full[z, None]

    seen = collections.Counter()
    follows = collections.defaultdict(collections.Counter)
    for z, words in train:
        for p, w in zip([b"", *words], words, strict=False):
            code = symbol(w, z, False)
            follows[z, p][code] += 1
            for s in range(len(code)):
                for c in ("all", z, (z, p)):
                    seen[c, code[: s + 1]] += 1
    step = lambda n, cuts: sum(n >= c for c in cuts)
    events = sorted({(z, p, symbol(w, z, mixlm.held_out(i)), not mixlm.held_out(i)) for i, z, words in texts for p, w in zip([b"", *words], words, strict=False)})
    assert len(events) < mixmodel.BATCH  # one step a level, in which the order does not matter
    weights, square, table, bits_of = collections.defaultdict(lambda: [0.2, 0.5, 0.8]), collections.defaultdict(lambda: [1e-4] * 3), collections.Counter(), collections.Counter()
    for s in range(max(len(e[2]) for e in events)):
        seen_now, steps = [], collections.defaultdict(lambda: [0.0] * 4)
        for z, p, code, learn in events:
            if len(code) <= s:
                continue
            n = [[seen[c, code[:s] + b] - (b == code[s] and learn) for b in "01"] for c in ("all", z, (z, p))]
            if s >= 14:
                n[:2] = [[0, 0], [0, 0]]
            if s >= 14 and sum(n[2]) == 0:
                bits_of[z, p, code, learn] -= 1
                continue
            x = [math.log((b + 0.2) / (a + 0.2)) for a, b in n]
            own = follows[z, p]
            rough = step(sum(n[2]), [1, 2, 3, 5, 9, 17, 65, 513, 1023]) * 2 + (0 in n[2])
            gate = (rough * 3 + step(sum(n[1]), [1, 30])) * 4 + step(len(own) / max(1, sum(own.values())), [0.1 + 1e-12, 0.3 + 1e-12, 0.7 + 1e-12])
            logit = min(16, max(-16, sum(a * b for a, b in zip(weights[gate], x, strict=True))))
            level = rough, round(min(12, max(-12, logit)) * 32 / 24 + 16)
            q, bit = 1 / (1 + math.exp(-logit)), int(code[s])
            fine = (q + (table[level, 1] + 30 * q) / (table[level, 0] + table[level, 1] + 30)) / 2
            bits_of[z, p, code, learn] += math.log2(max(1e-6, fine if bit else 1 - fine))
            if learn:
                seen_now.append((level, bit, own[code]))
                for k in range(3):
                    steps[gate][k] += own[code] * (bit - q) * x[k]
                steps[gate][3] += own[code]
        for level, bit, n in seen_now:
            table[level, bit] += n
        for gate, (*slope, n) in steps.items():
            square[gate] = [a + (b / n) ** 2 for a, b in zip(square[gate], slope, strict=True)]
            weights[gate] = [w + 0.05 * b / n / a**0.5 for w, a, b in zip(weights[gate], square[gate], slope, strict=True)]
    used = {(w, z) for _, z, words in texts for w in words}
    for w, _ in used:
        hashed.setdefault(w, int(word_hashes([w])[0][0]) if w else int(mixlm._END))
    asked = sorted(((w, z) for w, z in used if total[w] == 0 or total[w] == 1 == by_class[w, z]), key=lambda x: (hashed[x[0]], x[1]))
    spell = lambda found: mixmodel.Speller(np.frombuffer(b"".join(w for w, _ in found), np.uint8), np.array([len(w) for w, _ in found], np.int64), np.array([z for _, z in found], np.int64))
    types = sorted(by_class)
    tables = mixmodel.Speller.running(*zip(*spell(types).table_counts(np.arange(len(types))), strict=True))
    spelled = dict(zip(asked, spell(asked).score(mixmodel.spell_mixer(), np.arange(len(asked)), np.array([total[w] == 1 for w, _ in asked], bool), tables).tolist(), strict=True))
    docs_of, out = collections.Counter(z for z, _ in train), []
    for i, z, words in texts:
        held = mixlm.held_out(i)
        bits = sum(bits_of[z, p, symbol(w, z, held), not held] + (spelled[w, z] if total[w] < 2 - held else 0) for p, w in zip([b"", *words], words, strict=False))
        out.append(bits * math.log10(2) + math.log10((docs_of[z] + 1) / (len(train) + 16)))
    return out


def test_lm_scores_equal_the_plain_way(spark, monkeypatch):
    rng = random.Random(5)
    words = [a + b for a in "abcdefgh" for b in "xyz"] + ["The", "rare" + chr(233)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(60))) + f" once{i}" * (i % 3 == 0), rng.choice(["en", "de", None]), "a") for i in range(80)]
    rows[3] = (3, None, "en", "a")
    docs = table(spark, rows)
    got = {}
    classes = [r[0] for r in docs.orderBy("doc_id").select(F.pmod(F.xxhash64("lang"), F.lit(16))).collect()]
    for least in (1 << 17, 20):  # without and with frequent contexts
        monkeypatch.setattr(mixlm, "LEAST", least)
        model = {}
        found = [r["score"] for r in mixlm.score_documents(docs, 3, model).orderBy("doc_id").collect()]
        assert (model["often"] is not None) == (least == 20)
        assert found == pytest.approx(plain_scores(rows, classes), abs=0.1)  # spellings come in 64ths of a bit, weights are single precision
        got[least] = found
    assert got[20] == got[1 << 17]
    again = [r["score"] for r in mixlm.score_documents(docs.repartition(7), 1).orderBy("doc_id").collect()]
    assert again == got[20]


def test_lm_streams_do_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixlm, "STREAM", 200)
    monkeypatch.setattr(mixlm, "LEAST", 30)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(BASE.split(), k=30)), "en", "a") for i in range(100)]
    one, two = ([(r["doc_id"], r["score"], r["bits_per_byte"]) for r in mixlm.score_documents(table(spark, rows), b).orderBy("doc_id").collect()] for b in (1, 5))
    assert one == two


def test_lm_without_training_documents(spark):
    held = [i for i in range(200) if mixlm.held_out(i)][:3]
    rows = mixlm.score_documents(table(spark, [(i, "some words", "en", "a") for i in held]), 2).collect()
    assert len(rows) == 3 and all(r["score"] < 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in rows)


def counting(mixer):
    """The mixer; its steps say how many inputs they get."""
    step, mixer.inputs = mixer.step, 0

    def counted(x, *rest):
        mixer.inputs += x.shape[1]
        return step(x, *rest)

    mixer.step = counted
    return mixer


def leaves(rng, path="", depth=9):
    """Paths of a random binary tree."""
    if depth == 0 or len(path) > 2 and rng.random() < 0.25:
        return [path]
    return leaves(rng, path + "0", depth - 1) + leaves(rng, path + "1", depth - 1)


@pytest.mark.parametrize("batch", [7, 4096])
def test_lm_rows_with_equal_inputs_are_computed_once(monkeypatch, batch):
    """Scores and steps are those of rows taken one by one, in fewer inputs."""
    monkeypatch.setattr(mixmodel, "BATCH", batch)
    monkeypatch.setattr(mixmodel, "TOP", 6)
    rng, choose = np.random.default_rng(3), random.Random(3)
    words = leaves(choose)
    paths = [(c, w) for c in range(9) for w in sorted(choose.sample(words, 1 if c == 0 else len(words) * 2 // 3))]
    context, classes = np.array([c for c, _ in paths]), np.array([c % 3 for c, _ in paths])
    codes = mixmodel.pack(np.array([int(w, 2) for _, w in paths]), np.array([len(w) for _, w in paths]))
    counts = np.where(rng.random(len(paths)) < 0.6, rng.integers(1, 4, len(paths)), 0)
    top = mixmodel.tops(*mixmodel.cells(codes, classes, counts + 1))
    rows = np.array([r for r, n in enumerate(counts) for _ in range(1 + (n > 0) * (r % 3 == 0))])
    learn = (counts[rows] > 0) & np.append(True, rows[1:] != rows[:-1])
    mass = np.where(learn, counts[rows], 0)
    mixer, plain, want, bits = counting(mixmodel.word_mixer()), mixmodel.word_mixer(), np.zeros(len(rows)), 0
    got = mixmodel.Successors(context, classes, codes, counts, top).score(mixer, rows, learn, mass)
    shares = [np.count_nonzero(counts[context == c]) / max(1, counts[context == c].sum()) for c in range(9)]
    for s in range(max(map(len, words))):
        held = []
        for i, r in enumerate(rows):
            c, path = paths[r]
            if len(path) <= s:
                continue
            like = lambda n, of, path=path, s=s, own=learn[i]: [sum(m for m, ok, (_, w) in zip(n, of, paths, strict=True) if ok and w[: s + 1] == path[:s] + b) - (b == path[s] and own) for b in "01"]
            n = [[0, 0], [0, 0], like(counts, context == c)]
            if s < 6:
                n[:2] = like(counts + 1, context >= 0), like(counts + 1, classes == classes[r])
            elif sum(n[2]) == 0:
                want[i] -= 1
                continue
            rough = sum(sum(n[2]) >= e for e in (1, 2, 3, 5, 9, 17, 65, 513, 1023)) * 2 + (0 in n[2])
            gate = (rough * 3 + sum(sum(n[1]) >= e for e in (1, 30))) * 4 + sum(shares[c] > e for e in (0.1, 0.3, 0.7))
            held.append((i, [math.log((b + 0.2) / (a + 0.2)) for a, b in n], gate, rough, int(path[s])))
        bits += len(held)
        for a in range(0, len(held), batch):
            at, x, gate, rough, bit = (np.array(v) for v in zip(*held[a : a + batch], strict=True))
            want[at] += plain.step(x.T.astype(np.float32), gate, rough, bit.astype(np.float32), mass[at].astype(np.float32))
    assert got == pytest.approx(want, abs=1e-3)
    assert mixer.weights == pytest.approx(plain.weights, abs=1e-3)
    assert batch < 4096 or mixer.inputs < 0.7 * bits


def test_lm_spelling_computes_equal_bytes_once():
    """Words scored one by one with the weights of the start, and together."""
    words = [bytes(w) for w in random.Random(4).choices([b"transport", b"transfer", b"transit", b"a", b"", b"trans\xc3\xa9"], k=200)]
    speller = mixmodel.Speller(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), np.zeros(200, np.int64))
    tables = speller.running(*zip(*speller.table_counts(np.arange(200)), strict=True))
    out = np.arange(200) % 3 == 0
    mixer = counting(mixmodel.spell_mixer())
    together = speller.score(mixer, np.arange(200), out, tables)
    assert mixer.inputs < 0.2 * 8 * sum(len(w) + 1 for w in words)
    once = {}
    for w, o, n in zip(words, out.tolist(), together.tolist(), strict=True):
        assert once.setdefault((w, o), n) == pytest.approx(n)
    mixer = mixmodel.spell_mixer()
    alone = [speller.score(mixer, np.array([i]), np.array([False]), tables)[0] for i in range(200)]
    assert speller.score(mixmodel.spell_mixer(), np.arange(200), np.zeros(200, bool), tables) == pytest.approx(alone, rel=1e-5)


def test_lm_distinct_keys_that_differ_in_low_bits():
    rng = np.random.default_rng(5)
    for keys in (np.array([5, 3, 5, 1], np.uint64), rng.integers(0, 9, 50).astype(np.uint64), rng.integers(0, 1 << 63, 50).astype(np.uint64), np.zeros(0, np.uint64)):
        at, number, times = mixlm.distinct(keys)
        want, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
        assert (keys[at] == want).all() and (number == inverse).all() and (times == n).all()


def test_lm_probabilities_sum_to_one():
    """The paths behind a context, the escapes among them; and the spellings of all short words."""
    rng = np.random.default_rng(2)
    counts, classes = rng.integers(1, 200, 60), np.sort(rng.integers(0, 3, 60))
    lo, escape, bits = mixmodel.escapes(np.bincount(classes, counts, 16)[:, None], np.full(16, 3))
    codes = np.concatenate([mixmodel.word_codes(classes, counts, lo[:, 0], bits), escape])
    size = mixmodel.unpack(codes)[1]
    assert len(set(codes.tolist())) == 76 and (0.5 ** size.astype(float)).sum() <= 1
    codes.sort()
    known = np.where(rng.random(76) < 0.3, rng.integers(1, 9, 76), 0)
    top = mixmodel.tops(*mixmodel.cells(codes, np.ones(76, np.int64), known + 1))
    found = mixmodel.Successors(np.zeros(76, np.int64), np.ones(76, np.int64), codes, known, top)
    mixer, rows = mixmodel.word_mixer(), np.arange(76)
    found.score(mixer, rows, known > 0, known)
    total = (2.0 ** found.score(mixer, rows, np.zeros(76, bool), np.zeros(76))).sum()
    assert 0.5 < total <= 1 + 1e-5
    words = [b"", b"a", b"ab", b"abc", b"b", b"ba", b"xyz", b"xyzzy"]
    speller = mixmodel.Speller(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]), np.zeros(8, np.int64))
    tables = speller.running(*zip(*speller.table_counts(np.arange(8)), strict=True))
    mixer = mixmodel.spell_mixer()
    speller.score(mixer, np.arange(8), np.ones(8, bool), tables)
    short = [bytes([a]) for a in range(1, 256)] + [b""]
    every = mixmodel.Speller(np.frombuffer(b"".join(short), np.uint8), np.array([len(w) for w in short]), np.zeros(256, np.int64))
    assert (2.0 ** every.score(mixer, np.arange(256), np.zeros(256, bool), tables)).sum() < 1
    long = mixmodel.Speller(np.frombuffer(b"ab" * 5000, np.uint8), np.array([10_000]), np.zeros(1, np.int64))
    assert np.isfinite(long.score(mixer, np.array([0]), np.array([False]), tables)).all()


def brute_groups(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {b" ".join(w)} if w else set())
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return collections.Counter((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, docs, empty, k, percent):
    rng = np.random.default_rng(2)
    rows = [(i, t) for i, t, *_ in ROWS]
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    for n in range(60):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 8))):
            w[at] = f"v{rng.integers(1000)}"
        rows.append((100 + n, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_groups(df, k, percent)
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows, k, percent)
    assert neardup.near_groups(docs, k, percent).count() == len(ROWS)
    assert neardup.near_groups(empty, k, percent).count() == 0


def test_near_dedup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 200)
    rows = [(i, " ".join(f"w{x}" for x in range(60)) + f" end{i % 7}") for i in range(40)]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert by_row(got, "doc_id", "n_shingles", "component_id") == brute_groups(rows, 3, 85)


def test_null_ids_have_no_component(spark):
    rows = [(1, BASE), (None, BASE), (None, "other words than those of the first one"), (2, BASE)]
    got = collections.Counter(tuple(r) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect())
    assert got == {(1, 1, True): 1, (2, 1, False): 1, (None, None, None): 2}


def test_index_meets_its_chance():
    assert [(i.chunks, i.r) for i in map(neardup.index_for, (85, 80))] == [(9, 7), (10, 6)]
    for percent in range(20, 100, 5):
        index, q = neardup.index_for(percent), percent / 100
        assert (1 - q**index.r - index.r * q ** (index.r - 1) * (1 - q)) ** index.chunks < 3e-5
        most = neardup.reach(percent, index.size)
        assert 2 * index.chunks - 1 <= index.size and most >= (1 - q) * index.size
        assert sum(math.comb(index.size, k) * (1 - q) ** k * q ** (index.size - k) for k in range(most + 1, index.size + 1)) <= 1e-6


def test_full_buckets_are_tied_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[: 50 + i % 7] + [str(rng.integers(4))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_row(neardup.near_groups(df), "doc_id", "component_id", "kept")
    monkeypatch.setattr(neardup, "SMALL", 1)
    assert by_row(neardup.near_groups(df), "doc_id", "component_id", "kept") == want


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(path).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50}


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-9
    for s in targets:
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= 2 * max(r["size"] for r in mine)
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(r["times"] for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def brute_choices(text, k, w):
    h = winnow.rolling(np.frombuffer(text.encode("utf-32-le"), np.uint32), k).tolist()
    out = []
    for a in range(max(1, len(h) - w + 1)):
        part = h[a : a + w]
        at = a + max(j for j, x in enumerate(part) if x == min(part))
        if not out or out[-1][1] != at:
            out.append((h[at], at))
    return out


def test_winnowing_choices():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab cé"), int(rng.integers(winnow.K, 300)))) for _ in range(100)] + ["a" * 200, "ab" * 100]
    hashes, place, bounds = winnow.choices(texts)
    for i, t in enumerate(texts):
        part = slice(bounds[i], bounds[i + 1])
        assert list(zip(hashes[part].tolist(), place[part].tolist(), strict=True)) == brute_choices(t, winnow.K, winnow.W)
    # Whatever shares W + K - 1 characters shares a hash.
    shared = "".join(rng.choice(list("abcdefgh"), winnow.W + winnow.K - 1))
    (_, a), (_, b) = winnow.fingerprints(["xyz" * 30 + shared + "q" * 50, "u" * 77 + shared])
    assert a & b


def test_winnowing(spark, docs, empty):
    rows = winnow.compare_with_next(docs).collect()
    assert len(rows) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [t or "" for _, t, *_ in order]
    want = collections.Counter()
    for k, (r, t) in enumerate(zip(order, texts, strict=True)):
        e = winnow.edited(t, texts[(k + 1) % len(order)])
        want[r[0], len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["near_next"] for r in winnow.compare_with_next(docs.where("doc_id = 1")).collect()} == {1.0}
    assert winnow.compare_with_next(empty).count() == 0


def plain_fingerprint(text):
    """The string and the set of hashes, gram by gram in plain integers."""
    if not text:
        return "", set()
    if len(text) < winnow.K:
        h = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big")
        return f"{h:08x}00", {h}
    base, mask, grams = int(winnow._BASE), (1 << 64) - 1, []
    for a in range(len(text) - winnow.K + 1):
        h = sum((ord(c) + 1) * pow(base, j, 1 << 64) for j, c in enumerate(text[a : a + winnow.K])) & mask
        grams.append(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 32)
    chosen = []
    for a in range(max(1, len(grams) - winnow.W + 1)):
        at = max(range(a, min(a + winnow.W, len(grams))), key=lambda j: (-grams[j], j))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return "".join(f"{grams[b]:08x}{b - a:02x}" for a, b in zip([0, *chosen], chosen, strict=False)), {grams[b] for b in chosen}


def test_winnowing_equals_the_plain_way(spark):
    rng = np.random.default_rng(13)
    base = "".join(rng.choice(list("abc dé\U0001f600"), 400))
    texts = [base, base[:200] + "xyz" * 40, base[100:], "", None, "short", "a" * 90, base]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in winnow.compare_with_next(df).collect():
        own, after = texts[r["doc_id"]] or "", texts[(r["doc_id"] - 1) % len(texts)] or ""
        half = len(own) // 2
        changed = own[: len(own) - half] + after[:half]
        (a, x), (b, y), (_, z) = map(plain_fingerprint, (own, changed, after))
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(own), a, b)
        assert (r["near_edited"], r["near_next"]) == pytest.approx((likeness(x, y), likeness(x, z)))


def test_winnowing_splits_a_hot_id(spark, monkeypatch):
    """Half of the rows have no id, a third one id: they are in many parts and still in order."""
    rng = np.random.default_rng(12)
    rows = [(None if i % 2 else 7 if i % 3 else i, "".join(rng.choice(list("abc"), 30))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = winnow.with_next(df, 12).where("lookahead = 0").groupBy("part").count().collect()
    assert len(parts) > 8 and max(r["count"] for r in parts) < 60
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = collections.Counter((r[0], hashlib.sha256(winnow.edited(r[1], order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, r in enumerate(order))
    monkeypatch.setattr(winnow, "with_next", lambda d, f=winnow.with_next: f(d, 12))
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in winnow.compare_with_next(df).collect()) == want


def brute_removal(rows, length):
    first = {}
    key = lambda i: -1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            first[s] = min(first.get(s, key(i)), key(i))
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if first[b[a : a + length]] < key(i):
                cover[a : a + length] = b"\1" * length
        runs = sum(bool(c) and (not a or not cover[a - 1]) for a, c in enumerate(cover))
        out[i, len(b), sum(cover), runs, bytes(x for x, c in zip(b, cover, strict=True) if not c)] += 1
    return out


def test_suffix_dedup(spark, docs, empty):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert by_row(suffixdedup.remove_repeats(docs), *names) == brute_removal([(i, t) for i, t, *_ in ROWS], 50)
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_random_and_in_many_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passages = ["".join(rng.choice(list("abcd é"), int(rng.integers(40, 160)))) for _ in range(6)]
    rows = [(int(i), "".join(passages[p] if rng.random() < 0.6 else "".join(rng.choice(list("abcd "), 30)) for p in rng.integers(0, 6, 5))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    want = brute_removal(rows, 50)
    assert by_row(suffixdedup.remove_repeats(df), *names) == want
    monkeypatch.setattr(suffixdedup, "SHARD", 300)  # anchors go on over several shards
    assert by_row(suffixdedup.remove_repeats(df), *names) == want
    monkeypatch.setattr(suffixdedup, "HOT", 2)  # all are split by a second anchor
    assert by_row(suffixdedup.remove_repeats(df, blocks=2), *names) == want


def test_suffix_array():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 123, 300).astype(np.uint8)
    pieces = [base[a : a + n] for a, n in zip(rng.integers(0, 200, 60), rng.integers(20, 100, 60), strict=True)]  # long repeats
    for data in (rng.integers(97, 100, 400).astype(np.uint8), np.full(100, 97, np.uint8), np.concatenate(pieces)):
        order, depth = suffixdedup.suffix_array(data, 50)
        parts = [data[i : i + 50].tobytes() for i in order]
        assert parts == sorted(parts) and sorted(order.tolist()) == list(range(len(data)))
        whole = data.tobytes()
        want = [0] + [next((k for k in range(50) if whole[a + k : a + k + 1] != whole[b + k : b + k + 1] or not whole[a + k : a + k + 1]), 50) for a, b in zip(order, order[1:], strict=False)]
        for lanes in (1, 7, 1000):
            assert suffixdedup.common_prefixes(data, order, depth, 50, lanes).tolist() == want
    data = np.full(100, 97, np.uint8)
    table = suffixdedup.strings_at(data, np.array([0]), 50)
    other = np.concatenate([data, np.full(60, 98, np.uint8)])
    assert suffixdedup.search(table, suffixdedup.strings_at(other, np.array([3, 70, 100]), 50)).tolist() == [0, -1, -1]


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 16))
    x[60:120] = x[0] + 0.05 * rng.normal(size=(60, 16))
    x[130] = x[131]
    rows = [(i, [float(v) for v in row], int(i % 3)) for i, row in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, [1.0, None], 1), (205, [], 1), (206, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j in good if j != i and good[j][1] == good[i][1] and len(good[j][0]) == len(good[i][0]) and good[i][0] @ good[j][0] >= 0.98 * np.linalg.norm(good[i][0]) * np.linalg.norm(good[j][0])} for i in good}
    label = {i: i for i, *_ in rows}
    for _ in rows:
        for i in links:
            label[i] = min([label[i], *(label[j] for j in links[i])])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_vectors(df).collect()}
    assert got == {i: (len(links.get(i, ())), label[i], label[i] == i) for i, *_ in rows}
    assert embdedup.near_vectors(df.limit(0)).count() == 0


def test_embeddings_odd_rows(spark):
    """Huge and tiny components, repeated ids, copies of improper vectors, null ids, other columns."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 8))
    near = a + 0.01 * rng.normal(size=8)
    rows = [(1, a), (2, a), (3, near), (3, near), (3, b), (4, b), (5, 1e200 * a), (6, 1e-200 * a), (7, 0 * a), (8, 0 * a), (None, a), (9, a * np.nan), (10, a * np.nan), (11, a), (11, a)]
    df = spark.createDataFrame([(i, v.tolist(), 0, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, n_links string, `a.b` string")
    proper = [(i, v) for i, v in rows if i is not None and np.isfinite(v).all() and v.any()]
    cosine = lambda v, w: (v / np.abs(v).max()) @ (w / np.abs(w).max()) / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(w / np.abs(w).max())
    links = collections.Counter(i for i, v in proper for j, w in proper if i != j and cosine(v, w) >= 0.98)
    got = embdedup.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert all(r["n_links"] == links[r["vec_id"]] for r in got if r["vec_id"] is not None)
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == {**{i: 1 for i in (1, 2, 3, 4, 5, 6, 11)}, **{i: i for i in (7, 8, 9, 10)}}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, None)]


def test_finer_grids_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 32))
    x[100:200] = x[:100] + 0.1 * rng.normal(size=(100, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = by_row(embdedup.near_vectors(df), "vec_id", "n_links", "component_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert {(i, n) for i, n, _ in want} == {(i, int(n) - 1) for i, n in enumerate((unit @ unit.T >= 0.98).sum(1))}
    monkeypatch.setattr(embdedup, "FEW", 1)
    assert embdedup.grid_for(300) > 7
    assert by_row(embdedup.near_vectors(df), "vec_id", "n_links", "component_id") == want


def test_embeddings_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=8) + 0.02 * rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = by_row(embdedup.near_vectors(df), "vec_id", "n_links", "component_id")
    monkeypatch.setattr(embdedup, "TILE", 20)
    assert by_row(embdedup.near_vectors(df), "vec_id", "n_links", "component_id") == want


def test_equal_embeddings_link_once(spark):
    """Each group of copies among other vectors has all its links, once, whatever cells its members are compared in."""
    rng = np.random.default_rng(19)
    sizes = [*range(2, 12), *[2] * 300, 39, 64, 100, 300]
    groups = [g for g, n in enumerate(sizes) for _ in range(n)]
    rows = [(i, g, x) for i, (g, x) in enumerate(zip(groups, rng.normal(size=(len(sizes), 64))[groups], strict=True))]
    others = rng.normal(size=(2000, 64))  # they share cells with copies
    df = spark.createDataFrame([*((i, x.tolist(), 0) for i, _, x in rows), *((10_000 + i, x.tolist(), 0) for i, x in enumerate(others))], "vec_id long, embedding array<double>, label int")
    first = {}
    for i, g, _ in rows:
        first.setdefault(g, i)
    want = {i: (sizes[g] - 1, first[g]) for i, g, _ in rows}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_vectors(df.repartition(5)).collect()}
    assert {i: got[i] for i in want} == want


def test_copies_count_in_one_block():
    """Two copies meet in a cell of each block, among other vectors and at other places each time."""
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 17):
        for _ in range(60):
            copy, counts = rng.normal(size=64), []
            for block in range(embdedup.BLOCKS):
                x = np.concatenate([np.tile(copy, (n, 1)), rng.normal(size=(rng.integers(0, 38), 64))])
                order = rng.permutation(len(x))
                x = (x / np.sqrt((x * x).sum(1))[:, None])[order]
                found = embdedup.compare(order, [v.tobytes() for v in x], np.ones(len(x), bool), np.zeros(len(x), int), (0, 0), block, 64, 0.98)
                counts.append(dict(zip(found[0].tolist(), found[1].tolist(), strict=True)))
            assert [sum(c.get(i, 0) for c in counts) for i in range(n)] == [n - 1] * n


def test_closest_block_is_the_same_in_every_batch():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 64))
    for dim in (64, 8, 3):
        x = np.concatenate([base, base, base + rng.normal(size=base.shape) * 1e-16, np.nextafter(base, 9)])[:, :dim].copy()
        x /= np.sqrt((x * x).sum(1))[:, None]
        p, q = np.triu_indices(len(x), 1)
        whole = embdedup.closest(x, x @ embdedup.rotation_of(dim), p, q)
        for a in range(len(p)):
            pair = x[[q[a], p[a]]]
            assert embdedup.closest(pair, pair @ embdedup.rotation_of(dim), np.array([0]), np.array([1]))[0] == whole[a]


def brute_lines(rows):
    white = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(white))
    rank = lambda i: -1 if i is None else i
    owner = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            owner[key(s)] = min(owner.get(key(s), rank(i)), rank(i))
    out = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(key(s)) < 10 or owner[key(s)] == rank(i)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, empty, batches):
    out = linededup.dedup_lines(docs, batches=batches, fanout=2)
    got = out.select("doc_id", F.size("__lines").alias("lines"), linededup.n_dropped().alias("gone"), linededup.kept_text().alias("kept"))
    assert by_row(got, "doc_id", "lines", "gone", "kept") == brute_lines([(i, t) for i, t, *_ in ROWS])
    assert out.columns == [*(c for c in docs.columns if c not in ("__lines", "__drops")), "__lines", "__drops"]
    assert linededup.dedup_lines(empty).count() == 0


def test_word_hashes_split_like_bytes():
    texts = [(t or "").encode() for _, t, *_ in ROWS]
    hashes, bounds = word_hashes(texts)
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    words = [w for t in texts for w in t.lower().split()]
    assert len(set(words)) == len(set(hashes.tolist())) and len({(w, h) for w, h in zip(words, hashes.tolist(), strict=True)}) == len(set(words))
