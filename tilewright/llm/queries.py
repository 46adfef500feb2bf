"""The queries op1 to op10 and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embdedup, linededup, mixing, mixlm, neardup, quality, sharding, suffixdedup, winnow
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return docs.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "score", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixlm.score_documents(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(linededup.kept_text(), 256).alias("kept_sha256")
    return docs.select("doc_id", F.size("__lines").cast("long").alias("n_lines"), linededup.n_dropped().alias("n_dropped"), kept)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_byte_bpe, op3_quality_classifier, op4_lm_scoring, op5_minhash_near_dedup, op6_mixing, op7_winnowing, op8_suffix_array_dedup, op9_embedding_near_dedup, op10_line_dedup)}

ORACLES = {
    "op5_minhash_near_dedup": r"""
with recursive w as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
e as (select doc_id, unnest(s) as x from s),
p as (select a.doc_id as i, b.doc_id as j, count(*) as n from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
k as (select i, j from p join s a on a.doc_id = i join s b on b.doc_id = j where 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
r as (select doc_id as i, doc_id as c from documents union select k.j, r.c from r join k on k.i = r.i)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.c) as component_id, s.doc_id = min(r.c) as kept
from s join r on r.i = s.doc_id group by s.doc_id, s.s
""",
    "op6_mixing": r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size,
             [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
      from d group by source),
c as (select *, 2.0 * source_size as cap, 1.5 * sum(source_size) over () as budget from s),
l as (select *, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from c),
t as (select source, source_size, least(cap, weight * max(case when level <= cap / weight then level end) over ()) as target from l),
r as (select d.*, source_size, target,
             case when source_size > 0 then floor(target / source_size) else 0 end as passes,
             sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
             sum(size) over (partition by d.source, h) as here
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * (passes + case when upto - here <= target - passes * source_size
                               and (upto <= target - passes * source_size or here <= 2 * (target - passes * source_size - (upto - here)))
                              then 1 else 0 end))::bigint as taken
from r
""",
    "op8_suffix_array_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) as p from d where len(h) >= 100)),
o as (select s, min(doc_id) as owner from w group by s having count(*) > 1),
c as (select doc_id, p from w join o using (s) where owner < doc_id),
g as (select doc_id, p, sum(case when p <= prev + 50 then 0 else 1 end) over (partition by doc_id order by p) as run from (select *, lag(p) over (partition by doc_id order by p) as prev from c)),
r as (select doc_id, min(p) as a, max(p) + 50 as b from g group by doc_id, run),
k as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans, list(a order by a) as starts, list(b order by a) as ends from r group by doc_id),
j as (select d.doc_id, len(h) // 2 as n, h, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, list_concat([0], coalesce(ends, [])) as kept_from, list_concat(coalesce(starts, []), [len(h) // 2]) as kept_to from d left join k using (doc_id))
select doc_id, n::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(kept_from) + 1), lambda i: substr(h, 2 * kept_from[i] + 1, 2 * (kept_to[i] - kept_from[i]))), ''))) as kept_sha256
from j
""",
    "op9_embedding_near_dedup": """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
n as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
k as (select a.vec_id as i, b.vec_id as j from n a join n b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id as i, vec_id as c from embeddings union select k.j, r.c from r join k on k.i = r.i)
select v.vec_id, (select count(*) from k where k.i = v.vec_id)::bigint as n_links, min(r.c) as component_id, v.vec_id = min(r.c) as kept
from v join r on r.i = v.vec_id group by v.vec_id
""",
    "op10_line_dedup": r"""
with l as (
  select doc_id, i as pos, s[i] as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents), unnest(range(1, len(s) + 1)) as u(i)),
k as (select *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key),
j as (select k.*, coalesce(o.owner < k.doc_id, false) as dropped from k left join o on k.key = o.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from j group by doc_id
""",
}
