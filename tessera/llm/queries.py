"""The registered queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers

from tessera.llm import bytecnn, mixing, mpeg, nndescent, packing, pii, sharding, simhash, sstable, suffix
from tessera.llm.common import table


def op1_sum_of_squares_packing(spark, sf_dir, tokenizer=None):
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op2_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op5_sorted_table_shards(spark, sf_dir, tokenizer=None):
    return sstable.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op6_nn_descent(spark, sf_dir):
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_feistel_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_byte_cnn_quality(spark, sf_dir):
    return bytecnn.digest(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_mpeg_audio(spark, sf_dir):
    return mpeg.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_prefix_doubling(spark, sf_dir):
    return suffix.repeated(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_sum_of_squares_packing, op2_pii, op3_simhash_near_dedup, op4_source_mixing, op5_sorted_table_shards, op6_nn_descent, op7_feistel_sharding, op8_byte_cnn_quality, op9_mpeg_audio, op10_prefix_doubling)}
#: The same results by comparing everything with everything; the others need hashes, tokenizers or trained weights that SQL lacks, and are tested against brute force.
ORACLES: dict[str, str] = {
    "op6_nn_descent": """
with recursive v as (
    select vec_id, embedding::double[] as e from embeddings
    where embedding is not null and list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), edges as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(id, root) as (
    select vec_id, vec_id from embeddings union select e.a, r.root from reach r join edges e on e.b = r.id
), roots as (select id, min(root) as root from reach group by 1), n as (select a, count(*) as c from edges group by 1)
select vec_id, coalesce(c, 0) as n_links, root as component_id, vec_id = root as kept, 1.0::double as audit_recall
from embeddings join roots on id = vec_id left join n on a = vec_id""",
    "op10_prefix_doubling": """
with d as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents
), w as (
    select doc_id, i, substr(h, 2 * i + 1, 200) as s from d, unnest(range(0, n - 99)) t(i) where n >= 100
), f as (
    select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from w) where k > 1
), g as (
    select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from f
), b as (
    select doc_id, min(i) as b, max(i) + 100 as e from (select *, sum(fresh) over (partition by doc_id order by i) as run from g) group by doc_id, run
), p as (
    select doc_id, b, e, lag(e, 1, 0) over (partition by doc_id order by b) as last from b
), k as (
    select doc_id, sum(e - b)::bigint as gone, count(*) as runs, max(e) as tail, string_agg(substr(h, 2 * last + 1, 2 * (b - last)), '' order by b) as kept
    from p join d using (doc_id) group by doc_id
)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(runs, 0) as n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from d left join k using (doc_id)""",
}
