"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.llm import alignment, audit, decontamination, lattice, minhash, mixing, neural_lm, pii, quality, repeats, sharding, token_counts, toxicity
from srcloom.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 16


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, toxicity.toxicity_model(docs, labels, 5, 0))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses"
    )


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), sharding.ring_key(F.col("doc_id"), F.col("text")).alias("key"),
    )
    placed = sharding.shard_rows(docs, SHARDS, key_col="key")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: ~s["added"])
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"),
    )


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.score_quality(docs, quality.quality_model(docs, labels, 4, 2))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_ALPHA_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = rf"""with d as (select doc_id, coalesce({_ALPHA_WORDS}, []) as w from documents),
  b as (select item_id, {_ALPHA_WORDS} as w from benchmark where text is not null and item_id is not null),
  bw as (select item_id, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i, w from b where len(w) > 0),
  win as (select distinct item_id, n, least(n, 3) as m, array_to_string(w[i:i + least(n, 3) - 1], ' ') as head, array_to_string(w[i:i + n - 1], ' ') as win from bw),
  dwords as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
  heads as (select doc_id, i, word, concat_ws(' ', word, lead(word, 1) over p) as two, concat_ws(' ', word, lead(word, 1) over p, lead(word, 2) over p) as three
    from dwords window p as (partition by doc_id order by i)),
  dw as (select doc_id, i, m, case m when 1 then word when 2 then two else three end as head from heads, (select distinct m from win)),
  near as (select dw.doc_id, i, n, item_id, win from dw join win on win.m = dw.m and win.head = dw.head),
  hits as (select doc_id, i, n, item_id from near join d using (doc_id) where array_to_string(d.w[i:i + n - 1], ' ') = win),
  words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
  items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


@query("op6_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r[1] - r[0])
    ids = F.concat_ws(",", F.sort_array(F.transform("items", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


OP8_SQL = r"""with recursive d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, 'null')) as h from documents),
  s as (select source, sum(size)::bigint as source_size from d group by source),
  w as (select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight from s),
  rounds as (select 0 as k, (select sum(source_size) from w)::bigint as share, (select sum(weight) from w)::bigint as above, 0::bigint as n
    union all
    select k + 1, (select sum(source_size) from w)::bigint - capped, open_weight, n2 from (
      select k, n, (select coalesce(sum(3 * source_size), 0) from w where 3 * source_size * above < weight * share)::bigint as capped,
        (select coalesce(sum(weight), 0) from w where not 3 * source_size * above < weight * share)::bigint as open_weight,
        (select count(*) from w where 3 * source_size * above < weight * share) as n2
      from rounds) where n2 > n and open_weight > 0),
  last as (select share, above from rounds order by k desc limit 1),
  t as (select source, source_size, case when 3 * source_size * above < weight * share then (3 * source_size)::double
      else weight * share::double / above::double end as target from w, last),
  r as (select source, source_size, target, case when source_size > 0 then target / source_size else 0 end as ratio,
    ('0x' || substr(md5(concat('mix', coalesce(source, ''))), 1, 8))::bigint::double / 4294967296.0 as off from t),
  p as (select d.*, row_number() over (partition by source order by
      length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)), h, size, doc_id)::double as k from d)
select doc_id, size, source_size, target, (floor(k * ratio + off) - floor((k - 1) * ratio + off))::bigint * size as taken,
  (floor(k * ratio + off) - floor((k - 1) * ratio + off))::bigint as copies
from p join r on p.source is not distinct from r.source"""


@query("op8_mixing", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs, size_col="size").select("doc_id", "size", "source_size", "target", "taken", "copies")


OP5_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
  n as (select doc_id, count(*) as n from s group by doc_id),
  links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
  e as (select x, y from links union all select y, x from links),
  reach as (select doc_id as x, doc_id as y from w union select reach.x, e.y from reach join e on e.x = reach.y),
  c as (select x as doc_id, min(y) as component_id from reach group by x)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, w.doc_id = component_id as kept from w left join n using (doc_id) join c using (doc_id)"""


@query("op5_minhash", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=85)


OP7_SQL = """with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
  good as (select vec_id, label, e from v where label is not null and e is not null and len(e) > 0 and vec_id is not null
    and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
  links as (select a.vec_id as x, b.vec_id as y from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.e, b.e) >= 0.98),
  reach as (select vec_id as x, vec_id as y from v union select reach.x, links.y from reach join links on links.x = reach.y),
  c as (select x as vec_id, min(y) as component_id from reach group by x),
  n as (select x as vec_id, count(*) as n from links group by x)
select v.vec_id, coalesce(n, 0)::bigint as n_links, component_id, v.vec_id = component_id as kept from v left join n using (vec_id) join c using (vec_id)"""


@query("op7_lattice", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op10_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf_dir, "documents"))


@query("op9_neural_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 1
    scored = neural_lm.score_texts(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP11_SQL = r"""with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
  w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as least from d),
  m as (select part, (len(words) < 50)::int + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::int
      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask,
    doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good, doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as toxic from w),
  c as (select part, mask, count(*)::bigint as n, count(*) filter (where good)::bigint as good, count(*) filter (where toxic)::bigint as toxic from m group by part, mask),
  o as (select '' as ord union all select ord || l from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as l) where not contains(ord, l)),
  s as (select ord, step, 1 << (ascii(substr(ord, step, 1)) - 65) as own, coalesce(list_sum([1 << (ascii(substr(ord, i, 1)) - 65) for i in range(1, step)]), 0)::int as before
    from o, (select unnest(range(1, 6))::int as step) where length(ord) = 5),
  r as (select part, ord, step, own, sum(case when mask & (before | own) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & own > 0 and mask & before = 0 then n else 0 end)::bigint as removed, sum(case when mask & own > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = own then n else 0 end)::bigint as unique_fails, sum(case when mask & own > 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & own > 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost from c, s group by part, ord, step, own)
select part, ord as filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r"""


@query("op11_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)
