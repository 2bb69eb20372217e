"""BM25, vectors, symbolic profiles, blends and combiners over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions.expr import hash32, unit
from presslens.functions.grouping import checkpointed, scratch_folder, top_k
from presslens.operators import models as C, profiles as PR, quantised as Q, text as T, training as N, vectors as E
from suite.registry import i64, long_vec, query, r6
from suite.views import sql_hash32

TIE = sql_hash32("article_id::VARCHAR")


@query("t1_tokenize", "select article_id, coalesce(n, 0)::BIGINT as n, coalesce(toks, '') as toks from docs left join (select article_id, count(*) as n, string_agg(term, ' ' order by term) as toks from dtok group by article_id) using (article_id)")
def _(v):
    rows = v.docs.select("article_id", T.tokenize("title").alias("t"))
    # compared by code point, as the oracle sorts
    return rows.select("article_id", i64(F.size("t"), "n"), F.array_join(F.array_sort("t"), " ").alias("toks"))


@query("t2_user_query", "select user_id, term, qtf from uterms")
def _(v):
    return v.uterms.select("user_id", "term", i64("qtf"))


@query("t3_bm25_index", "select term, article_id, round(weight, 6) as weight from postings")
def _(v):
    return v.postings.select("term", "article_id", r6("weight"))


@query("t4_bm25_score_all", "select query_id, article_id, round(sum(qtf * weight), 6) as score from qterms join postings using (term) group by all")
def _(v):
    return T.bm25_score_all(T.query_terms(v.queries), v.postings).select("query_id", "article_id", r6("score"))


@query("t5_bm25_top_k", f"""select query_id, article_id, rank, round(score, 6) as score from (
    select query_id, article_id, score, row_number() over (partition by query_id order by round(score, 9) desc, {TIE}, article_id) as rank from (
      select query_id, docs.article_id, coalesce(s, 0e0) as score from (select distinct query_id from qterms join idfs using (term)) cross join docs
      left join (select query_id, article_id, sum(qtf * weight) as s from qterms join postings using (term) group by all) m
        on m.query_id = query_id and m.article_id = docs.article_id)) where rank <= 20""".replace("on m.query_id = query_id and m.article_id = docs.article_id", "using (query_id, article_id)").replace("docs.article_id, coalesce", "article_id, coalesce"))
def _(v):
    top = T.bm25_top_k(T.query_terms(v.queries), v.postings, v.docs, 20)
    return top.select("query_id", "article_id", i64("rank"), r6("score"))


@query("t6_bm25_candidates", "select impression_id, position::BIGINT as position, article_id, round(bm25, 6) as score from eimp join bm25c using (user_id, article_id)")
def _(v):
    rows = T.bm25_score_candidates(v.eimp, v.clicked_terms, v.postings, v.docs)
    return rows.select("impression_id", i64("position"), "article_id", r6("score"))


# --- vectors -----------------------------------------------------------------------------

@query("e1_encode_text", """with often as (select term from dtok group by term having count(*) > 1)
    select article_id, case when n > 0 then 64 end as dim, case when n > 0 then 1e0 end as norm2 from docs left join (
      select article_id, count(*) as n from dtok join often using (term) group by article_id) using (article_id)""")
def _(v):
    """Unit vectors; none for a text without a word that occurs twice in the corpus."""
    vecs = E.encode_text(v.docs)
    size = F.when(F.col("vec").isNotNull(), F.size("vec"))
    return vecs.select("article_id", size.alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


@query("e2_encode_incremental", """select article_id, round(a / sqrt(a * a + b * b), 6) as x, round(b / sqrt(a * a + b * b), 6) as y
    from (select article_id, length(title) + 1e0 as a, (case when lower(category) = 'en' then 5 else 1 end) * 1e0 as b from docs)""")
def _(v):
    """The store first gets the texts of one language, then the rest, then nothing new."""
    store = scratch_folder(v.spark, "encoded")

    def encode(rows):
        raw = F.array(F.length("title") + 1.0, F.when(F.col("category") == "en", 5.0).otherwise(1.0))
        return rows.select("article_id", unit(raw).alias("vec"))

    E.encode_incremental(v.docs.filter("category = 'en'"), store, "lengths", encode)
    E.encode_incremental(v.docs, store, "lengths", encode)
    vecs = E.encode_incremental(v.docs, store, "lengths", encode)
    return vecs.select("article_id", r6(F.get("vec", F.lit(0)), "x"), r6(F.get("vec", F.lit(1)), "y"))


@query("e3_align_vectors", """select article_id, d, round(x / sqrt(sum(x * x) over (partition by article_id)), 6) as x
    from (select article_id, generate_subscripts(vec, 1) as d, unnest(vec) as x from vecs where article_id in (select article_id from ehist))""")
def _(v):
    return long_vec(E.align_vectors(v.vecs, v.ehist), "article_id")


@query("e3_vector_coverage", "select round(avg((article_id in (select article_id from vecs))::INT), 6) as coverage, count(*) as n_ids from docs")
def _(v):
    return E.vector_coverage(E.align_vectors(v.vecs, v.docs), v.docs).select(r6("coverage"), "n_ids")


@query("e4_pool_mean", "select user_id, d, round(x, 6) as x from pooled")
def _(v):
    return long_vec(E.pool_mean(v.ehist, v.dvecs), "user_id")


@query("e5_pool_recency", "select user_id, d, round(x, 6) as x from rpooled")
def _(v):
    return long_vec(E.pool_recency(v.ehist, v.dvecs), "user_id")


@query("e6_entity_mentions", "select article_id, entity_id, confidence from entities")
def _(v):
    return E.entity_mentions(v.docs)


@query("e7_entity_vectors", """select article_id, d, round(s / sqrt(sum(s * s) over (partition by article_id)), 6) as x from (
    select article_id, d, sum(confidence * x) as s from entities join (
      select 'Q' || article_id as entity_id, generate_subscripts(vec, 1) as d, unnest(vec) as x from vecs) using (entity_id) group by all)""")
def _(v):
    return long_vec(E.entity_vectors(v.docs, E.entity_mentions(v.docs), v.entity_vecs), "article_id")


_KNN = f"""select query_id, article_id, rank, round(score, 6) as score from (select query_id, article_id, score,
    row_number() over (partition by query_id order by round(score, 9) desc, {TIE}, article_id) as rank from (
    select q.article_id as query_id, i.article_id as article_id, list_inner_product(q.vec, i.vec) as score from vecs q cross join vecs i)) where rank <= 10"""


def _self_queries(v):
    return v.vecs.select(F.col("article_id").alias("query_id"), "vec")


@query("e8_knn", _KNN)
def _(v):
    return E.knn(_self_queries(v), v.vecs, 10).select("query_id", "article_id", i64("rank"), r6("score"))


@query("e9_cosine_candidates", "select impression_id, position::BIGINT as position, article_id, round(cosine, 6) as score from eimp join cosc using (user_id, article_id)")
def _(v):
    rows = E.cosine_candidates(v.eimp, E.pool_mean(v.ehist, v.dvecs), v.dvecs)
    return rows.select("impression_id", i64("position"), "article_id", r6("score"))


def _quantised(v):
    """The index, and the settings that a mean recall of 0.95 needs, with room for parts of the queries."""
    index = Q.build_quantised(v.vecs, E.ivf_lists(v.n_vecs))
    return index, Q.search_settings(_self_queries(v), index, 10, 0.97)


@query("e10_ivf_knn")
def _(v):
    index, (nprobe, short) = _quantised(v)
    return Q.quantised_knn(_self_queries(v), index, nprobe, short, 10).select("query_id", "article_id", i64("rank"), r6("score"))


@query("e10_ivf_own_lists", f"select query_id, article_id, rank, score from ({_KNN}) where rank = 1")
def _(v):
    """A vector that is in the index is its own first neighbour, or one equal to it is."""
    index, (nprobe, short) = _quantised(v)
    return Q.quantised_knn(_self_queries(v), index, nprobe, short, 1).select("query_id", "article_id", i64("rank"), r6("score"))


@query("e10_ivf_all_cells", _KNN)
def _(v):
    """Probing every cell must give the exact answer."""
    centroids, members = E.ivf_build(v.vecs, 8)
    return E.ivf_knn(_self_queries(v), centroids, members, 8, 10).select("query_id", "article_id", i64("rank"), r6("score"))


@query("e11_ann_audit", f"""with exact as ({_KNN}), approx as (select query_id, article_id, row_number() over (partition by query_id order by score desc, article_id) as rank
      from (select q.article_id as query_id, i.article_id, list_inner_product(q.vec, i.vec) as score from
        (select *, label from vecs join embeddings on vec_id = article_id) q join (select *, label from vecs join embeddings on vec_id = article_id) i using (label)))
    select round(avg(r), 6) as mean_recall, round(min(r), 6) as min_recall, round(avg((r >= 1)::INT), 6) as perfect_share, count(*) as n_queries from (
    select e.query_id, avg((a.article_id is not null)::INT) as r from exact e left join (select * from approx where rank <= 10) a using (query_id, article_id) group by e.query_id)""")
def _(v):
    labelled = v.table("embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    left = labelled.select(F.col("article_id").alias("query_id"), "vec", "label")
    # the approximate side of the audit: neighbours with the query's own label
    found = E._knn_blocks(left, labelled, 10, "query_id", ["label"], 16384, 65536)
    approx = top_k(found, ["query_id"], [F.col("score").desc(), F.col("article_id")], 10, "rank")
    rows = E.ann_audit(E.knn(_self_queries(v), v.vecs, 10), approx, 10)
    return rows.select(r6("mean_recall"), r6("min_recall"), r6("perfect_share"), "n_queries")


def _index_audit(v):
    """(mean_recall, min_recall, share_read, n_queries): share_read is the part of the full vectors that a query reads."""
    index, (nprobe, short) = _quantised(v)
    rows = E.ann_audit(E.knn(_self_queries(v), v.vecs, 10), Q.quantised_knn(_self_queries(v), index, nprobe, short, 10), 10)
    return rows.withColumn("share_read", F.lit(short / v.n_vecs))


@query("e11_ivf_recall")
def _(v):
    return _index_audit(v).select(r6("mean_recall"), r6("min_recall"), r6("share_read"), "n_queries")


@query("e11_ivf_audit", "select true as enough, true as few, count(*) as n_queries from vecs")
def _(v):
    """Whether the search of e10 has a mean recall of 0.95 over all queries, and reads at most a fifth of the vectors."""
    rows = _index_audit(v)
    return rows.select((F.col("mean_recall") >= 0.95).alias("enough"), (F.col("share_read") <= 0.2).alias("few"), "n_queries")


@query("e12_history_sequence", """select user_id, row_number() over (partition by user_id order by pos) as seq, article_id, round(vec[1], 6) as x1
    from ehist join dvecs using (article_id)""")
def _(v):
    rows = E.history_sequence(v.ehist, v.dvecs)
    return rows.select("user_id", i64("seq"), "article_id", r6(F.element_at("vec", 1), "x1"))


@query("e13_attention_scores", """select impression_id, position::BIGINT as position, article_id,
    round(coalesce(att, 0e0) + 0.1e0 * ln(coalesce(popularity, (select v from epop_floor))), 6) as score from eimp left join (
    select user_id, article_id, sum(exp(s / 8e0) * s) / sum(exp(s / 8e0)) as att from (
      select user_id, e.article_id, list_inner_product(c.vec, h.vec) as s from epairs e join dvecs c on c.article_id = e.article_id
      join ehist x using (user_id) join dvecs h on h.article_id = x.article_id) group by all) using (user_id, article_id)
    left join epop using (article_id)""")
def _(v):
    rows = E.attention_scores(v.eimp, v.ehist, v.dvecs, popularity=v.epopularity, pop_weight=0.1)
    return rows.select("impression_id", i64("position"), "article_id", r6("score"))


# --- symbolic ----------------------------------------------------------------------------

@query("f1_entity_sets", "select article_id, entity_id from esets")
def _(v):
    return PR.entity_sets(v.docs)


@query("f2_history_profile", """select user_id, 'category' as kind, category as value, n from pcat union all
    select user_id, 'subcategory', subcategory, n from psub union all select user_id, 'entity', entity_id, n from pent union all
    select user_id, 'all', '', n_articles from hlen""")
def _(v):
    parts = [(v.docs, "category", "category"), (v.docs, "subcategory", "subcategory"), (PR.entity_sets(v.docs), "entity_id", "entity")]
    out = PR.history_length(v.ehist).select("user_id", F.lit("all").alias("kind"), F.lit("").alias("value"), i64("n_articles", "n"))
    for values, value, kind in parts:
        prof = PR.history_profile(v.ehist, values, value)
        out = out.unionByName(prof.select("user_id", F.lit(kind).alias("kind"), F.col(value).alias("value"), i64("n")))
    return out


@query("f3_match_scores", """select impression_id, position::BIGINT as position, round(category_match, 6) as category_match,
    round(subcategory_match, 6) as subcategory_match from eimp join catm using (user_id, article_id)""")
def _(v):
    rows = PR.match_score(v.eimp, v.docs, v.ehist, "category", "category_match")
    rows = PR.match_score(rows, v.docs, v.ehist, "subcategory", "subcategory_match")
    return rows.select("impression_id", i64("position"), r6("category_match"), r6("subcategory_match"))


@query("f4_entity_overlap", "select impression_id, position::BIGINT as position, entity_overlap from eimp join eov using (user_id, article_id)")
def _(v):
    rows = PR.entity_overlap(v.eimp, PR.entity_sets(v.docs), v.ehist)
    return rows.select("impression_id", i64("position"), i64("entity_overlap"))


@query("f5_symbolic_score", """select impression_id, position::BIGINT as position, round(category_match + subcategory_match + ln(1e0 + entity_overlap), 6) as score
    from eimp join catm using (user_id, article_id) join eov using (user_id, article_id)""")
def _(v):
    rows = PR.symbolic_score(v.eimp, v.docs, PR.entity_sets(v.docs), v.ehist)
    return rows.select("impression_id", i64("position"), r6("score"))


@query("f8_history_popularity", "select article_id, clicks, round(decayed, 6) as decayed from hpop")
def _(v):
    return PR.history_popularity(v.ehist, articles=v.docs).select("article_id", "clicks", r6("decayed"))


_LEAK = """with raw as (select article_id, count(*) as total_inviews, sum(case when read_time > 30 then 1 end) as total_pageviews, sum(read_time) as total_read_time
      from ehist group by article_id),
    filled as (select article_id, ln(1e0 + total_inviews) as a, ln(1e0 + coalesce(total_pageviews, (select median(total_pageviews) from raw))) as b,
      ln(1e0 + total_read_time) as c from raw),
    leaks as (select article_id, ((a - min(a) over ()) / (max(a) over () - min(a) over ()) + (b - min(b) over ()) / (max(b) over () - min(b) over ())
      + (c - min(c) over ()) / (max(c) over () - min(c) over ())) / 3e0 as leak from filled) """


def _leaks(v):
    raw = v.ehist.groupBy("article_id").agg(
        F.count("*").alias("total_inviews"), F.sum(F.when(F.col("read_time") > 30, 1)).alias("total_pageviews"),
        F.sum("read_time").alias("total_read_time"))
    return PR.leak_score(raw)


@query("f9_leak_score", _LEAK.replace("(max(a) over () - min(a) over ())", "nullif(max(a) over () - min(a) over (), 0)") + "select article_id, round(leak, 6) as leak from leaks")
def _(v):
    return _leaks(v).select("article_id", r6("leak"))


# --- blends and combiners ----------------------------------------------------------------

def _combined(v, **kw):
    return C.combiner_features(v.eimp, v.ehist, v.docs, v.dvecs, PR.entity_sets(v.docs), v.epopularity, v.clicked_terms, v.postings, **kw)


@query("c2_blend", """select impression_id, position::BIGINT as position, round(0.5e0 * case when bh - bl < 1e-12 then 0 else (bm25 - bl) / (bh - bl) end
    + 0.5e0 * case when ch - cl < 1e-12 then 0 else (cosine - cl) / (ch - cl) end, 6) as score from (
    select impression_id, position, bm25, cosine, min(bm25) over w as bl, max(bm25) over w as bh, min(cosine) over w as cl, max(cosine) over w as ch
    from eimp join bm25c using (user_id, article_id) join cosc using (user_id, article_id) window w as (partition by impression_id))""")
def _(v):
    rows = T.bm25_score_candidates(v.eimp, v.clicked_terms, v.postings, v.docs, out="bm25")
    rows = E.cosine_candidates(rows, E.pool_mean(v.ehist, v.dvecs), v.dvecs, out="cosine")
    return C.blend(rows, {"bm25": 0.5, "cosine": 0.5}).select("impression_id", i64("position"), r6("score"))


@query("c3_leak_blend", _LEAK + """select impression_id, position::BIGINT as position, round(cosine, 6) as score_without,
    round(0.5e0 * case when ch - cl < 1e-12 then 0 else (cosine - cl) / (ch - cl) end + 0.5e0 * case when lh - ll < 1e-12 then 0 else (lk - ll) / (lh - ll) end, 6) as score_with
    from (select *, min(cosine) over w as cl, max(cosine) over w as ch, min(lk) over w as ll, max(lk) over w as lh from (
      select impression_id, position, cosine, coalesce(leak, 0e0) as lk from eimp join cosc using (user_id, article_id) left join leaks using (article_id))
    window w as (partition by impression_id))""")
def _(v):
    rows = E.cosine_candidates(v.eimp, E.pool_mean(v.ehist, v.dvecs), v.dvecs)
    return C.leak_blend(rows, _leaks(v)).select("impression_id", i64("position"), r6("score_without"), r6("score_with"))


@query("c4_combiner_features", """select impression_id, position::BIGINT as position, round(bm25, 6) as bm25, round(cosine, 6) as cosine,
    round(recency_cosine, 6) as recency_cosine, round(category_match, 6) as category_match, round(subcategory_match, 6) as subcategory_match,
    round(log_entity_overlap, 6) as log_entity_overlap, round(log_popularity, 6) as log_popularity,
    round(ln(1e0 + coalesce(n_articles, 0)), 6) as log_history_len from combined left join hlen using (user_id)""")
def _(v):
    return _combined(v, with_history_len=True).select("impression_id", i64("position"), *[r6(c) for c in [*C.COMBINER, "log_history_len"]])


_SCALED = ", ".join(f"(select avg({c}) from combined where {{}}) as m_{c}" for c in C.COMBINER)


@query("c5_standardise", "with part as (select *, impression_time < timestamp '2024-01-11' as is_train from combined) select impression_id, position::BIGINT as position, "
       + ", ".join(f"round(({c} - (select avg({c}) from part where is_train)) / (select stddev_pop({c}) from part where is_train), 5) as {c}" for c in C.COMBINER)
       + " from part where not is_train")
def _(v):
    rows = checkpointed(_combined(v))
    early = F.col("impression_time") < F.lit("2024-01-11").cast("timestamp_ntz")
    values = C.scaler_values(C.fit_scaler(rows.filter(early), C.COMBINER))
    return C.apply_scaler(rows.filter(~early), values).select(
        "impression_id", i64("position"), *[F.round(c, 5).alias(c) for c in C.COMBINER])


# fixed values: any coefficients will do, these weigh every feature
COEF = [0.02, 1.5, 0.7, 0.9, 0.4, 0.3, 0.25]
_LINEAR = "-0.5e0 + " + " + ".join(f"{w}e0 * {c}" for w, c in zip(COEF, C.COMBINER))


@query("c7_apply_linear", f"select impression_id, position::BIGINT as position, round({_LINEAR}, 6) as score from combined")
def _(v):
    return C.apply_linear(_combined(v), C.COMBINER, COEF, -0.5).select("impression_id", i64("position"), r6("score"))


@query("c13_gated_score", f"""select impression_id, position::BIGINT as position, case when coalesce(n_articles, 0) < 25 then 'cold' else 'warm' end as cohort,
    round(case when coalesce(n_articles, 0) < 25 then {_LINEAR} else cosine end, 6) as score from combined left join hlen using (user_id)""")
def _(v):
    rows = C.cohort(_combined(v), v.ehist, threshold=25)
    return C.gated_score(rows, COEF, -0.5).select("impression_id", i64("position"), "cohort", r6("score"))


# --- titles ------------------------------------------------------------------------------

_WORDS = """with words as (select article_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as token from docs),
    tv as (select token, row_number() over (order by n desc, token) + 1 as id from (select token, count(*) as n from words group by token having count(*) >= 2)
      union all select '<pad>', 0 union all select '<unk>', 1) """


@query("n1_title_vocab", _WORDS + "select token, id from tv")
def _(v):
    return N.title_vocab(v.docs)


@query("n2_encode_titles", _WORDS + """select article_id, string_agg(coalesce(id, case when tok is null then 0 else 1 end)::VARCHAR, ' ' order by k) as ids from (
      select article_id, k, regexp_extract_all(lower(title), '[a-z0-9]+')[k] as tok from docs, (select unnest(range(1, 13)) as k)) left join tv on tv.token = tok group by article_id
    union all select null, '0 0 0 0 0 0 0 0 0 0 0 0'""")
def _(v):
    rows = N.encode_titles(v.docs, N.title_vocab(v.docs), 12)
    return rows.select("article_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("n5_vector_coverage", _WORDS + """select count(*) as n_tokens, count(vec) as n_found from tv left join
    (select token, any_value(vec) as vec from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token, [1.0] as vec from queries) group by token) using (token)""")
def _(v):
    words = v.queries.select(F.explode(N.title_tokens("text")).alias("id")).distinct()
    pretrained = words.withColumn("vec", F.array((hash32("id") / 4294967296.0)))
    return N.count_found(N.vector_coverage(N.title_vocab(v.docs), pretrained))
