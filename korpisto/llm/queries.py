"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpisto.llm import (
    op01_packing,
    op02_sentencepiece,
    op03_fingerprints,
    op04_suffix_dedup,
    op05_lm_scoring,
    op06_near_dedup,
    op07_substring_dedup,
    op08_pii,
    op09_token_counts,
    op10_quality,
    op11_embedding_dedup,
    op12_conversations,
    op13_hard_negatives,
)
from korpisto.llm.common import documents, labels, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_sentencepiece.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_fingerprints.edited_neighbours(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality are the target; each text is scored without its own counts."""
    return op05_lm_scoring.cross_entropy_difference(documents(spark, sf_dir), labels(spark, sf_dir).where("quality = 1"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_near_dedup.near_dedup(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_substring_dedup.substring_dedup(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_pii.detect(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = op09_token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", counts.n_tokens > 4096)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality.judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_embedding_dedup_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_conversations.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_hard_negatives_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 are relabelled first; rows whose id is divisible by 100 are the anchors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return op13_hard_negatives.hard_negatives(rows, is_anchor="id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.rstrip("_"): f
    for f in (
        op1_packing, op2_sentencepiece, op3_fingerprints, op4_suffix_dedup, op5_lm_scoring,
        op6_near_dedup, op7_substring_dedup, op8_pii, op9_token_counts, op10_quality_rules,
        op11_embedding_dedup_, op12_conversation_repair, op13_hard_negatives_,
    )
}
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t-\\r]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: SQL for the operators that it can express.
ORACLES: dict[str, str] = {
    "op6_near_dedup": f"""
with recursive d as materialized (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) as i from d),
s as materialized (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from i),
n as materialized (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r as (select doc_id, doc_id as root from d union select l.b, r.root from r join l on l.a = r.doc_id),
m as (select doc_id, min(root) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join n using (doc_id) join m using (doc_id)""",
    "op7_substring_dedup": f"""
with d as materialized (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) as i from d),
g as materialized (select doc_id, i, array_to_string(w[i : i + 49], ' ') as g from i),
f as (select g, min(doc_id) as low from g group by 1),
c as (select distinct doc_id, i + unnest(range(0, 50)) as k from g join f using (g) where low < doc_id),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d),
k as (select x.doc_id, count(c.k) as n_removed, string_agg(word, ' ' order by x.k) filter (c.k is null) as kept from x left join c on c.doc_id = x.doc_id and c.k = x.k group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op12_conversation_repair": """
with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as id from conversations),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: case when x % 2 = 0 then x // 2 else xor(x // 2, 3988292384::bigint) end)), 4294967295::bigint) % 20 as kind from o),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(0, case when kind = 3 then 2 else 1 end)) as again from h where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, regexp_replace(text, '[ \t-\r]+$', '') as body from d),
f as materialized (select conv_id, turn, role, text, p, left(role, 1) as i, case when body = '' then 'b' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by p) as before from n),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, max(p) as last from f group by conv_id),
w(i, s, t) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)),
g as (select conv_id, p, s, min(e) as e from (select conv_id, 0::bigint as p, unnest([0, 2, 3]) as s, unnest([{'cost': 0, 'audit': '', 'made': ''}, {'cost': 3, 'audit': 'I', 'made': 'user:' || chr(10)}, {'cost': 6, 'audit': 'II', 'made': 'user:' || chr(10) || 'assistant:' || chr(10)}]) as e from c) group by all
    union all
    select conv_id, p, s, min(e) from (
        select conv_id, p, case when ins = 0 then s when s = 2 or ins = 2 then 3 else 2 end as s, {'cost': e.cost + 3 * ins, 'audit': e.audit || repeat('I', ins),
            'made': e.made || case ins when 0 then '' when 1 then case when s = 2 then 'assistant:' else 'user:' end || chr(10) else 'user:' || chr(10) || 'assistant:' || chr(10) end} as e
        from (select g.conv_id, f.p, g.s, {'cost': g.e.cost + 4, 'audit': g.e.audit || 'D', 'made': g.e.made} as e from g join f on f.conv_id is not distinct from g.conv_id and f.p = g.p + 1
            union all
            select g.conv_id, f.p, w.t, {'cost': g.e.cost + case fault when 't' then 3 else 0 end, 'audit': g.e.audit || 'K', 'made': g.e.made || f.role || ':' || f.text || chr(10)} from g join f on f.conv_id is not distinct from g.conv_id and f.p = g.p + 1 and fault in ('', 't') join w on w.s = g.s and w.i = f.i
            union all
            select g.conv_id, f.p, case g.s when 2 then 3 else 2 end, {'cost': g.e.cost + 3 + case fault when 't' then 3 else 0 end, 'audit': g.e.audit || 'R', 'made': g.e.made || case g.s when 2 then 'assistant:' else 'user:' end || f.text || chr(10)} from g join f on f.conv_id is not distinct from g.conv_id and f.p = g.p + 1 and fault in ('', 't')),
        (values (0), (1), (2)) x(ins) where ins < 2 or s in (0, 1)) group by conv_id, p, s),
e as (select c.conv_id, min({'cost': g.e.cost, 'audit': g.e.audit, 'made': g.e.made}) as e from c join g on g.conv_id is not distinct from c.conv_id and g.p = c.last and g.s in (0, 3) group by c.conv_id),
a as (select distinct conv_id from conversations)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cast(e.e.cost as bigint), 0) as cost, coalesce(e.e.audit, '') as audit,
    sha256(coalesce(left(e.e.made, greatest(length(e.e.made) - 1, 0)), '')) as repaired_sha256 from a left join c on c.conv_id is not distinct from a.conv_id left join e on e.conv_id is not distinct from a.conv_id""",
    "op13_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as q
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, a.label as la, b.vec_id, b.label, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::bigint as score
    from v a join v b on a.vec_id % 100 = 0 and len(a.q) = len(b.q) and a.vec_id <> b.vec_id),
p as (select * from (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where label = la) where k <= 5),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
    from p join s on s.anchor_id = p.anchor_id and s.label <> s.la and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op11_embedding_dedup": """
with recursive v as materialized (select vec_id, list_transform(embedding, lambda x: x::double) as q from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) and list_cosine_similarity(a.q, b.q) >= 0.95),
r as (select vec_id, vec_id as root from v union select l.b, r.root from r join l on l.a = r.vec_id),
c as (select vec_id, min(root) as root from r group by 1), n as (select a, count(*) as n from l group by 1)
select e.vec_id, coalesce(n.n, 0) as n_links, coalesce(c.root, e.vec_id) as component_id, e.vec_id = coalesce(c.root, e.vec_id) as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.vec_id = e.vec_id""",
}
