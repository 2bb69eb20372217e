"""The dealt operators as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from presslens.llm import bpe, embedding_dedup, exact_dedup, lexical, lm_scoring, merkle, minhash, mixing, packing, sharding, suffix_dedup, token_files, toxicity
from presslens.llm.common import find_package
from presslens.session import prepare_session

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return prepare_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_exact_dedup", r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents),
     g as (select h, count(*) as size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) as keep from t group by h)
select t.doc_id, g.keep as keep_id, g.size as group_size, t.doc_id = g.keep as kept, t.h as text_sha256
from t join g using (h)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


@query("op3_byte_shards", r"""
with recursive k as (select i, 0 as step, i::ubigint as c from range(256) t(i)
                     union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from k where step < 8),
crc as (select list(c order by i) as tab from k where step = 8),
d as (select doc_id, coalesce(text, '') as t from documents),
sized as (select doc_id, strlen(t) + 16 as size,
                 xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::ubigint)),
                                 lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)::int])), 4294967295::ubigint)::bigint as text_crc32 from d, crc),
placed as (select *, sum(size) over (order by doc_id, size, text_crc32) as upto, sum(size) over () as total, row_number() over (order by doc_id, size, text_crc32) as n from sized),
cut as (select *, least(39, ((2 * upto - size) * 40) // (2 * total))::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, n - min(n) over (partition by shard) as slot, null::int as grown_shard from cut""")
def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(_table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query("op6_harmonic_packing")
def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op10_pivotal_mix")
def op10_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = model.score(docs)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_forest_near_vectors", """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
     near as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
     reach as (select a, b from near union select r.a, n.b from reach r join near n on r.b = n.a),
     links as (select a, count(*) as n from near group by a), low as (select a, min(b) as b from reach group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low.b, vec_id)) as component_id, least(vec_id, coalesce(low.b, vec_id)) = vec_id as kept
from v left join links on links.a = vec_id left join low on low.a = vec_id""")
def op9_forest_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


@query("op7_trie_scores")
def op7_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), ~lm_scoring.held_out())


@query("op4_dart_minhash", r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
     k as (select doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) as i from w where len(words) > 0),
     run as (select doc_id, words[i:i + 4] as run, count(*) as n from k group by all),
     weight as (select doc_id, sum(n) as n from run group by doc_id),
     both_ as (select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as n from run a join run b on a.run = b.run and a.doc_id < b.doc_id group by all),
     near as (select a, b from both_ c join weight x on x.doc_id = a join weight y on y.doc_id = b where c.n >= 0.8 * (x.n + y.n - c.n)
              union select a.doc_id, b.doc_id from w a join w b on a.doc_id < b.doc_id and len(a.words) = 0 and len(b.words) = 0),
     edge as (select a, b from near union select b, a from near),
     reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
     class as (select w.doc_id, least(w.doc_id, min(r.b)) as class_id from w left join reach r on r.a = w.doc_id group by w.doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept from class""")
def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@query("op11_lexical_search", r"""
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
     d as (select row_number() over () as row, doc_id, terms, len(terms)::bigint as n from w where len(terms) > 0),
     total as (select count(*)::bigint as docs, sum(n)::bigint as words from d),
     tf as (select row, term, count(*)::bigint as tf from (select row, unnest(terms) as term from d) group by all),
     weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total group by term, docs),
     item as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
     asked as (select item_id, term, count(*)::bigint as times from item group by all),
     scored as (select item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::bigint as score
                from asked join weight using (term) join tf using (term) join d using (row), total group by item_id, row),
     ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored join d using (row) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


@query("op12_bpe_round_trip")
def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), back=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))


@query("op13_merkle_manifest", r"""
with recursive
  k as (select i, 0 as step, i::ubigint as c from range(256) t(i)
        union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from k where step < 8),
  crc as (select list(c order by i) as tab from k where step = 8),
  d as (select *, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)),
                                   lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)::int])), 4294967295::ubigint) % 5) = 0 as changed,
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_text from documents, crc),
  part as (select doc_id, source, changed, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
                  coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(lower_text) || ':' || lower_text, '-') as low from d),
  leaf as (select doc_id, source, sha256(head || body) as leaf, sha256(head || case when changed then low else body end) as met,
                  row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from part),
  up as (select source, 0 as level, i, n, leaf as h from leaf
         union all select source, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from up where n > 1 group by source, level, i // 16, n),
  sub as (select source, h, row_number() over (order by source nulls first) - 1 as i, count(*) over () as n from up where n = 1),
  top as (select 0 as level, i, n, h from sub
          union all select level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, i // 16, n),
  near as (select source, level, i, n, coalesce(string_agg(h, '' order by i) over (partition by source, level, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as before,
                  coalesce(string_agg(h, '' order by i) over (partition by source, level, i // 16 order by i rows between 1 following and unbounded following), '') as after from up),
  above as (select level, i, n, coalesce(string_agg(h, '' order by i) over (partition by level, i // 16 order by i rows between unbounded preceding and 1 preceding), '') as before,
                   coalesce(string_agg(h, '' order by i) over (partition by level, i // 16 order by i rows between 1 following and unbounded following), '') as after from top),
  climb as (select doc_id, source, 0 as level, i, met as h, '' as proof from leaf
            union all select c.doc_id, c.source, c.level + 1, c.i // 16, sha256(before || h || after), proof || before || after
            from climb c join near x on x.source is not distinct from c.source and x.level = c.level and x.i = c.i where x.n > 1),
  ended as (select doc_id, source, arg_max(h, level) as h, arg_max(proof, level) as proof from climb group by doc_id, source),
  climb2 as (select e.doc_id, 0 as level, s.i, e.h, e.proof from ended e join sub s on s.source is not distinct from e.source
             union all select c.doc_id, c.level + 1, c.i // 16, sha256(before || h || after), proof || before || after
             from climb2 c join above x on x.level = c.level and x.i = c.i where x.n > 1),
  done as (select doc_id, arg_max(h, level) as h, arg_max(proof, level) as proof from climb2 group by doc_id)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(o.proof) as proof_sha256, o.h as folded_root, o.h = r.h as verified
from leaf l join sub s on s.source is not distinct from l.source join done o on o.doc_id = l.doc_id join (select h from top where n = 1) r on true""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.when(changed, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))
    rows = merkle.merkle_proofs(_table(spark, sf_dir, "documents"), found={"text": lowered})
    folded = rows.withColumn("folded_root", merkle.fold(F.coalesce("found_leaf", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
