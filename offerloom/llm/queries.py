"""Queries of the numbered operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.chunk_dedup import exact_dedup
from offerloom.llm.common import LOWER, UPPER, table
from offerloom.llm.grid_join import near_vectors
from offerloom.llm.html_text import extract_main_text
from offerloom.llm.merkle_manifest import folded, manifest, siblings
from offerloom.llm.ngram_quality import quality
from offerloom.llm.personal_data import personal_data
from offerloom.llm.phrase_dedup import repeated_passages
from offerloom.llm.piece_codec import encode_decode
from offerloom.llm.source_mix import mix_sources
from offerloom.llm.subword_score import lattice_scores
from offerloom.llm.token_combo_join import jaccard_components
from offerloom.llm.token_count import token_counts
from offerloom.llm.vector_codes import vector_codes

WORDS = r"[^\x20\x09-\x0D]+"


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op4_token_combo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3, seed=42).select("doc_id", "size", "source_size", "target", "taken")


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("all_spans")


def op8_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), window=20)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest(table(spark, sf_dir, "documents")).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op13_subword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), modulus=7, remainder=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_ngram_quality": op1_ngram_quality,
        "op2_html_text": op2_html_text,
        "op3_chunk_dedup": op3_chunk_dedup,
        "op4_token_combo_join": op4_token_combo_join,
        "op5_source_mix": op5_source_mix,
        "op6_piece_codec": op6_piece_codec,
        "op7_personal_data": op7_personal_data,
        "op8_grid_join": op8_grid_join,
        "op9_phrase_dedup": op9_phrase_dedup,
        "op10_token_counts": op10_token_counts,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_vector_codes": op12_vector_codes,
        "op13_subword_score": op13_subword_score,
    }


OP3_SQL = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from t group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(g.t) as text_sha256
from t join g on t.t = g.t
"""

OP4_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from w, unnest(range(1, greatest(len(w) - 3, 1))) as t(i) where len(w) >= 5
  union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as low from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id
"""

OP9_SQL = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
v as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as g from w, unnest(range(1, greatest(len(w) - 18, 1))) as t(i) where len(w) >= 20),
f as (select *, row_number() over (partition by g order by doc_id, i) as k from v),
c as (select distinct doc_id, i + j as i from f, unnest(range(0, 20)) as t(j) where k > 1),
x as (select w.doc_id, t.i, w.w[t.i] as word from w, unnest(range(1, len(w) + 1)) as t(i)),
y as (select x.*, c.i is not null as gone from x left join c on c.doc_id = x.doc_id and c.i = x.i),
z as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from y group by doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join z on z.doc_id = d.doc_id
"""

OP5_SQL = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as bigint) as size,
         md5('42:' || coalesce(cast(doc_id as varchar), ''))[1:16] as u
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select source, source_size, source_size * 3.0::double as cap, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from s),
o as (
  select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as held,
         sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as open_w,
         sum(source_size) over () as total
  from w),
l as (select coalesce(min_by((total - held) / open_w, cap / w) filter (where cap / w >= (total - held) / open_w), 0) as level from o),
t as (
  select source, source_size, case when cap < w * level then cap else w * level end as target from w, l),
r as (
  select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as repeats from t),
x as (select *, cast(floor(target - repeats * source_size + 0.5) as bigint) as extra from r),
c as (
  select d.*, coalesce(sum(size) over (partition by source order by u, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead from d)
select c.doc_id, c.size, x.source_size, x.target,
       cast(c.size * x.repeats + greatest(0, least(c.size, x.extra - c.ahead)) as bigint) as taken
from c join x on c.source is not distinct from x.source
"""


OP8_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda e: cast(e as double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0
    and len(list_filter(embedding, lambda e: e <> 0)) > 0),
n as (select vec_id, x, sqrt(list_dot_product(x, x)) as norm from v),
e as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
      where list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as low from r group by a),
d as (select a, count(*) as n from e group by a)
select vec_id, coalesce(d.n, 0) as n_links, least(vec_id, coalesce(c.low, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(c.low, vec_id)) as kept
from embeddings left join c on c.a = vec_id left join d on d.a = vec_id
"""


_FIELD = lambda c, s="varchar": f"coalesce(cast(strlen(cast({c} as {s})) as varchar) || ':' || cast({c} as {s}), '-')"
_HEAD = " || ".join(map(_FIELD, ("doc_id", "source", "lang", "n_chars")))

OP11_SQL = f"""
with recursive c as (
  select *, sha256({_HEAD} || {_FIELD("text")}) as leaf, sha256({_HEAD} || {_FIELD("replace(text, chr(10), '')")}) as bad,
         list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, strlen(cast(doc_id as varchar)) + 1), lambda i: list_concat([cast(ord(cast(doc_id as varchar)[i]) as bigint)], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))),
                     lambda r, b: case when b >= 0 then xor(r, b) when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end) as crc
  from documents),
d as (
  select *, coalesce(xor(crc, 4294967295::bigint) % 2 = 0, false) as chosen, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from c),
u(source, level, i, h, n) as (
  select source, 0, pos, leaf, count(*) over (partition by source) from d
  union all
  select source, level + 1, i // 3, sha256(string_agg(h, '' order by i)), cast(ceil(max(n) / 3.0) as bigint) from u where n > 1 group by source, level, i // 3),
s as (select source, h as subroot, level as height, row_number() over (order by source nulls first) - 1 as pos from u where n = 1),
v(level, i, h, n) as (
  select 0, pos, subroot, count(*) over () from s
  union all
  select level + 1, i // 3, sha256(string_agg(h, '' order by i)), cast(ceil(max(n) / 3.0) as bigint) from v where n > 1 group by level, i // 3),
nodes as (
  select u.source, false as upper, u.level, u.i, u.h from u union all select null, true, level, i, h from v),
around as (
  select a.source, a.upper, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i < a.i), '') as before, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i > a.i), '') as after
  from nodes a left join nodes b on a.source is not distinct from b.source and a.upper = b.upper and a.level = b.level and a.i // 3 = b.i // 3 and a.i <> b.i
  group by a.source, a.upper, a.level, a.i),
steps as (
  select d.source, d.pos, k.level, w.before, w.after
  from d join s on d.source is not distinct from s.source join (select unnest(range(0, 40)) as level) k on k.level < s.height
  join around w on not w.upper and w.source is not distinct from d.source and w.level = k.level and w.i = d.pos // cast(pow(3, k.level) as bigint)
  union all
  select d.source, d.pos, s.height + k.level, w.before, w.after
  from d join s on d.source is not distinct from s.source join (select unnest(range(0, 40)) as level) k on k.level < (select max(level) from v)
  join around w on w.upper and w.level = k.level and w.i = s.pos // cast(pow(3, k.level) as bigint)),
paths as (select source, pos, list(before order by level) as before, list(after order by level) as after from steps group by source, pos),
f(source, pos, k, h) as (
  select source, pos, 0, case when chosen then bad else leaf end from d
  union all
  select f.source, f.pos, f.k + 1, sha256(p.before[f.k + 1] || f.h || p.after[f.k + 1])
  from f join paths p on f.source is not distinct from p.source and f.pos = p.pos where f.k < len(p.before)),
last as (select source, pos, max_by(h, k) as folded_root from f group by source, pos),
r as (select h as root from v where n = 1)
select d.doc_id, d.leaf, s.subroot, r.root,
       sha256(coalesce((select list_reduce(list_transform(list_zip(p.before, p.after), lambda z: z[1] || z[2]), lambda x, y: x || y) from paths p where p.source is not distinct from d.source and p.pos = d.pos), '')) as proof_sha256,
       l.folded_root, l.folded_root = r.root as verified
from d join s on d.source is not distinct from s.source join last l on l.source is not distinct from d.source and l.pos = d.pos cross join r
"""


def _op12_sql(rounds: int = 6) -> str:
    """Each round as two tables: a, the parts with their entry and distance, and c, the entries after it."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} as (select r, p, m % 16 as e, m // 16 as d from (select q.r, q.p, min(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + b.e) as m from q join c{k} b on q.p = b.p group by q.r, q.p) t)"
        )
        if k < rounds:
            steps.append(
                f"m{k} as (select p, e, list(v order by j) as x from (select a.p, a.e, j, cast(floor(cast(sum(q.x[j]) as double) / count(*)) as bigint) as v from a{k} a join q on a.r = q.r and a.p = q.p, unnest(range(1, len(q.x) + 1)) as t(j) group by a.p, a.e, j) t group by p, e)"
            )
            steps.append(f"c{k + 1} as (select c.p, c.e, coalesce(m.x, c.x) as x from c{k} c left join m{k} m on c.p = m.p and c.e = m.e)")
    return f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda e: cast(floor(4096 * cast(e as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
n as (select *, row_number() over (order by vec_id nulls last, x) as r from v),
q as (select r, t.p, x[t.p * (len(x) // 8) + 1 : (t.p + 1) * (len(x) // 8)] as x from n, unnest(range(0, 8)) as t(p)),
c0 as (select p, r - 1 as e, x from q where r <= 16),
{(","+chr(10)).join(steps)},
s as (select sha256(string_agg(t.v, ',' order by p, e, j)) as h from (select p, e, j, cast(c.x[j] as varchar) as v from c{rounds} c, unnest(range(1, len(c.x) + 1)) as t(j)) t),
o as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by r),
l as (select n.label, cast(sum(error) as bigint) as label_error from o join n on o.r = n.r group by n.label)
select n.vec_id, o.code, o.error, l.label_error, s.h as codebooks_sha256
from n join o on n.r = o.r join l on n.label is not distinct from l.label cross join s
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chunk_dedup": OP3_SQL, "op4_token_combo_join": OP4_SQL, "op5_source_mix": OP5_SQL, "op8_grid_join": OP8_SQL, "op9_phrase_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_vector_codes": _op12_sql()}
