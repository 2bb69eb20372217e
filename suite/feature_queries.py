"""The feature families, the whole feature frame and the fitted rankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions.grouping import checkpointed
from presslens.operators import features as K, metrics as M, models as C, profiles as PR, text as T, vectors as E
from presslens.operators.sampling import recent_holdout
from suite.registry import i64, long_vec, query, r6, whole_query
from suite.retrieval_queries import _combined

POS = "impression_id, position::BIGINT as position"


def _out(df, *cols):
    return df.select("impression_id", i64("position"), *cols)


@query("k1_long_term_affinity", """select user_id, 'category' as kind, category as value, round(affinity, 6) as affinity from acat
    union all select user_id, 'subcategory', subcategory, round(affinity, 6) from asub
    union all select user_id, 'topic', topic, round(affinity, 6) from atop""")
def _(v):
    clicks = K.engaged_clicks(v.ehist, v.docs)
    out = None
    for values, value in ((K.category_of(v.docs), "category"), (v.subcats, "subcategory"), (v.topics, "topic")):
        part = K.long_term_affinity(clicks, values, value).select(
            "user_id", F.lit(value).alias("kind"), F.col(value).alias("value"), r6("affinity"))
        out = part if out is None else out.unionByName(part)
    return out


@query("k1_long_term_vector", "select user_id, d, round(x, 6) as x from ltvec")
def _(v):
    return long_vec(K.long_term_vector(K.engaged_clicks(v.ehist, v.docs), v.dvecs), "user_id")


@query("k2_long_term_features", f"""select {POS}, round(lt_cat_affinity, 6) as lt_cat_affinity, round(lt_subcat_affinity, 6) as lt_subcat_affinity,
    round(lt_topic_affinity, 6) as lt_topic_affinity, round(lt_embed_sim, 6) as lt_embed_sim from eimp join ltf using (user_id, article_id)""")
def _(v):
    rows = K.long_term_features(v.eimp, v.ehist, v.docs, v.subcats, v.topics, v.dvecs)
    return _out(rows, *[r6(c) for c in K.LONG_TERM[:4]])


@query("k3_category_rank", f"select {POS}, lt_cat_rank::BIGINT as lt_cat_rank from eimp join docs using (article_id) left join ltrank using (user_id, category)")
def _(v):
    return _out(K.category_rank(v.eimp, v.ehist, v.docs, v.vocab), i64("lt_cat_rank"))


@query("k3_category_rank_orders", """with ov as (select category, row_number() over (order by category) - 1 as code from (select distinct category from art)),
    w as (select user_id, category, sum(1e0 + ln(1e0 + least(read_time, 600e0))) as s from hist join art using (article_id) group by all),
    r as (select user_id, category, row_number() over (partition by user_id order by coalesce(s, 0e0) desc, code) - 1 as rk
      from (select distinct user_id from hist) cross join ov left join w using (user_id, category))
    select impression_id, position::BIGINT as position, rk as lt_cat_rank from imp join art using (article_id) left join r using (user_id, category)""")
def _(v):
    """On orders most users have read only some of the categories."""
    from presslens.operators.prepare import fit_vocab
    return _out(K.category_rank(v.imp, v.hist, v.art, fit_vocab(v.art, "category")), i64("lt_cat_rank"))


@query("k4_sentiment_distance", f"""select {POS}, round(abs(sentiment_score - mean_sentiment), 9) as lt_sentiment_distance
    from eimp left join docs using (article_id) left join usersent using (user_id)""")
def _(v):
    return _out(K.sentiment_distance(v.eimp, v.ehist, v.docs), F.round("lt_sentiment_distance", 9).alias("lt_sentiment_distance"))


@query("k5_recent_categories", f"""select {POS}, coalesce(b = 1, false)::BIGINT as is_last_clicked_category, (b is not null)::BIGINT as in_recent_categories
    from eimp left join docs using (article_id) left join lastcats using (user_id, category)""")
def _(v):
    return _out(K.recent_categories(v.eimp, v.ehist, v.docs), "is_last_clicked_category", "in_recent_categories")


def _short(v, rows):
    return K.short_term_features(rows, v.ehist, v.docs, v.subcats, v.topics, v.dvecs, v.vocab)


@query("k6_short_term_features", f"""select {POS}, round(st_cat_affinity, 6) as st_cat_affinity, round(st_subcat_affinity, 6) as st_subcat_affinity,
    round(st_topic_affinity, 6) as st_topic_affinity, round(st_embed_sim, 6) as st_embed_sim, st_cat_rank::BIGINT as st_cat_rank
    from eimp join stf using (user_id, p, article_id)""")
def _(v):
    return _out(_short(v, v.eimp), r6("st_cat_affinity"), r6("st_subcat_affinity"), r6("st_topic_affinity"), r6("st_embed_sim"), i64("st_cat_rank"))


@query("k7_clicks_last_24h", f"select {POS}, n as user_clicks_last_24h from eimp left join day_clicks using (user_id, p)")
def _(v):
    return _out(K.clicks_last_24h(v.eimp, v.ehist, v.docs), i64("user_clicks_last_24h"))


@query("k8_drift", f"""select {POS}, round(st_cat_affinity - lt_cat_affinity, 6) as cat_affinity_drift, round(st_embed_sim - lt_embed_sim, 6) as embed_sim_drift,
    round(st_topic_affinity - lt_topic_affinity, 6) as topic_affinity_drift from eimp join stf using (user_id, p, article_id) join ltf using (user_id, article_id)""")
def _(v):
    rows = K.with_second(K.long_term_features(v.eimp, v.ehist, v.docs, v.subcats, v.topics, v.dvecs))
    rows = rows.join(K.short_term_moments(v.eimp, v.ehist, v.docs, v.subcats, v.topics, v.dvecs, v.vocab), K.MOMENT)
    return _out(K.drift_features(rows), *[r6(c) for c in K.DRIFT])


_USER = ["log_history_len", "user_mean_read_time", "user_median_read_time", "user_mean_article_age_h", "user_history_span_h"]


@query("k9_user_features", f"select {POS}, " + ", ".join(f"round({c}, 6) as {c}" for c in _USER)
       + ", user_distinct_categories, round((p - last_t) / 3600e0, 6) as hours_since_last_click from eimp left join userprof using (user_id)")
def _(v):
    rows = K.user_features(v.eimp, v.ehist, v.docs)
    return _out(rows, *[r6(c) for c in _USER], i64("user_distinct_categories"), r6("hours_since_last_click"))


@query("k9_user_medians_hot", "select user_id, round(user_median_read_time, 6) as read_time from userprof")
def _(v):
    """Medians with every user above ten clicks sent through the path for oversized groups."""
    from presslens.functions.grouping import medians
    return medians(v.ehist, ["user_id"], ["read_time"], hot_limit=10).select("user_id", r6("read_time"))


@query("k10_item_features", f"""select {POS}, round((p - epoch(published_at)) / 3600e0, 6) as article_age_h, ((p - epoch(published_at)) / 3600e0 < 6)::BIGINT as is_fresh_6h,
    sentiment_score, premium::BIGINT as is_premium, length(title)::BIGINT as title_len, nt as n_topics, vocab.code::BIGINT as category_code,
    round(ln(1e0 + coalesce(clicks, 0)), 6) as log_history_popularity, round(ln(1e0 + coalesce(decayed, 0e0)), 6) as log_history_popularity_decayed
    from eimp join docs using (article_id) join vocab using (category) join (select article_id, count(*) as nt from topics group by article_id) using (article_id)
    left join hpop using (article_id)""")
def _(v):
    rows = K.item_features(v.eimp, v.docs, v.topics, v.vocab, PR.history_popularity(v.ehist))
    return _out(rows, r6("article_age_h"), "is_fresh_6h", "sentiment_score", "is_premium", "title_len", i64("n_topics"), "category_code",
                r6("log_history_popularity"), r6("log_history_popularity_decayed"))


@query("k11_context_features", f"""select {POS}, 8::BIGINT as n_candidates, hour(impression_time)::BIGINT as hour_of_day, (isodow(impression_time) - 1)::BIGINT as day_of_week,
    (isodow(impression_time) >= 6)::BIGINT as is_weekend, (context_article_id is null)::BIGINT as is_front_page, -1::BIGINT as device_type,
    round(position / 7e0, 6) as relative_position_in_view from eimp""")
def _(v):
    return _out(K.context_features(v.eimp), "n_candidates", "hour_of_day", "day_of_week", "is_weekend", "is_front_page", "device_type",
                r6("relative_position_in_view"))


@query("k12_context_article", f"""with seen as materialized (select distinct article_id as aid, context_article_id as cid from eimp where context_article_id is not null),
    named as materialized (select article_id, topic from topics),
    own as materialized (select aid, cid, topic from seen join named on article_id = aid),
    shared as materialized (select aid, cid, count(*) as n from own join named on named.article_id = cid and named.topic = own.topic group by aid, cid),
    known as materialized (select article_id, vec from dvecs),
    pair as materialized (select aid, cid, a.category = c.category as same, list_inner_product(av.vec, cv.vec) as sim from seen left join docs a on a.article_id = aid
      left join docs c on c.article_id = cid left join known av on av.article_id = aid left join known cv on cv.article_id = cid)
    select {POS}, coalesce(same, false)::BIGINT as context_category_match, coalesce(n, 0)::BIGINT as context_topic_overlap, round(sim, 6) as context_embed_sim
    from eimp e left join pair p on p.aid = e.article_id and p.cid = e.context_article_id left join shared o on o.aid = e.article_id and o.cid = e.context_article_id""")
def _(v):
    rows = K.context_article_features(v.eimp, v.docs, v.topics, v.dvecs)
    return _out(rows, "context_category_match", i64("context_topic_overlap"), r6("context_embed_sim"))


@query("k13_session_features", "select impression_id, session_position, round(session_start_gap_h, 6) as session_start_gap_h from sess")
def _(v):
    return v.sessions.select("impression_id", i64("session_position"), r6("session_start_gap_h"))


def _pct(col: str) -> str:
    return f"""case when count(*) over (partition by impression_id) <= 1 or count({col}) over (partition by impression_id) <= 1 then 0.5e0 else
      (row_number() over (partition by impression_id order by {col} nulls first, position) - 1) / (count(*) over (partition by impression_id) - 1e0) end"""


@query("k14_rank_in_impression", f"""select {POS}, round({_pct('lt_cat_affinity')}, 6) as cat_rank, round({_pct('age')}, 6) as age_rank from (
    select impression_id, position, lt_cat_affinity, (p - epoch(published_at)) / 3600e0 as age from eimp join ltf using (user_id, article_id) join docs using (article_id))""")
def _(v):
    clicks, cats = K.engaged_clicks(v.ehist, v.docs), K.category_of(v.docs)
    affinity = K.value_affinity(K.pairs_of(v.eimp), K.long_term_affinity(clicks, cats, "category"), cats, "category", "lt_cat_affinity")
    rows = v.eimp.join(affinity, K.PAIR, "left").fillna(0.0, ["lt_cat_affinity"])
    rows = K.item_features(rows, v.docs, v.topics, v.vocab, PR.history_popularity(v.ehist))
    rows = K.rank_in_impression(rows, {"lt_cat_affinity": "cat_rank", "article_age_h": "age_rank"})
    return _out(rows, r6("cat_rank"), r6("age_rank"))


@whole_query("k14_rank_orders", f"""select impression_id, position::BIGINT as position, round({_pct('v')}, 6) as price_rank from (
    select impression_id, position, case when p_size > 10 then p_retailprice end as v from imp join part on p_partkey = article_id)""")
def _(v):
    part = v.table("part").select(F.col("p_partkey").alias("article_id"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("v"))
    rows = K.rank_in_impression(v.imp.join(part, "article_id"), {"v": "price_rank"})
    return _out(rows, r6("price_rank"))


@query("k15_impression_offsets", f"""select {POS}, round(age - min(age) over w, 6) as article_age_minus_imp_min, round(lt_embed_sim - max(lt_embed_sim) over w, 6) as lt_embed_sim_minus_imp_max
    from (select impression_id, position, lt_embed_sim, (p - epoch(published_at)) / 3600e0 as age from eimp join ltf using (user_id, article_id) join docs using (article_id))
    window w as (partition by impression_id)""")
def _(v):
    rows = K.long_term_features(v.eimp, v.ehist, v.docs, v.subcats, v.topics, v.dvecs)
    rows = K.item_features(rows, v.docs, v.topics, v.vocab, PR.history_popularity(v.ehist))
    return _out(K.impression_offsets(rows), r6("article_age_minus_imp_min"), r6("lt_embed_sim_minus_imp_max"))


def frame(v):
    return K.feature_frame(v.eimp, v.ehist, v.docs, v.subcats, v.topics, v.dvecs, v.vocab,
                           PR.history_popularity(v.ehist), v.sessions)


# the fill values stand for columns that the documents and events do not have; see the *_optional queries
_PLAIN_SQL = {
    "lt_cat_affinity": "ltf.lt_cat_affinity", "lt_subcat_affinity": "ltf.lt_subcat_affinity", "lt_topic_affinity": "ltf.lt_topic_affinity",
    "lt_embed_sim": "ltf.lt_embed_sim", "lt_cat_rank": "lt_cat_rank", "lt_sentiment_distance": "abs(d.sentiment_score - mean_sentiment)",
    "st_cat_affinity": "stf.st_cat_affinity", "st_subcat_affinity": "stf.st_subcat_affinity", "st_topic_affinity": "stf.st_topic_affinity",
    "st_embed_sim": "stf.st_embed_sim", "st_cat_rank": "stf.st_cat_rank",
    "is_last_clicked_category": "coalesce(b = 1, false)::INT", "in_recent_categories": "(b is not null)::INT",
    "cat_affinity_drift": "stf.st_cat_affinity - ltf.lt_cat_affinity", "embed_sim_drift": "stf.st_embed_sim - ltf.lt_embed_sim",
    "topic_affinity_drift": "stf.st_topic_affinity - ltf.lt_topic_affinity",
    "log_history_len": "log_history_len", "user_mean_read_time": "user_mean_read_time", "user_median_read_time": "user_median_read_time",
    "user_mean_scroll": "null", "user_distinct_categories": "user_distinct_categories", "user_clicks_last_24h": "day_clicks.n",
    "user_mean_article_age_h": "user_mean_article_age_h", "hours_since_last_click": "(e.p - last_t) / 3600e0", "user_history_span_h": "user_history_span_h",
    "article_age_h": "(e.p - epoch(d.published_at)) / 3600e0", "is_fresh_6h": "((e.p - epoch(d.published_at)) / 3600e0 < 6)::INT",
    "sentiment_score": "d.sentiment_score", "sentiment_label": "-1", "article_type": "-1", "is_premium": "d.premium::INT",
    "title_len": "length(d.title)", "body_len": "null", "n_topics": "nt.n", "n_entities": "0",
    "log_history_popularity": "ln(1e0 + coalesce(hpop.clicks, 0))", "log_history_popularity_decayed": "ln(1e0 + coalesce(hpop.decayed, 0e0))",
    "category_code": "vocab.code", "age_vs_user_appetite": "(e.p - epoch(d.published_at)) / 3600e0 - user_mean_article_age_h",
    "n_candidates": "8", "hour_of_day": "hour(impression_time)", "day_of_week": "isodow(impression_time) - 1",
    "is_weekend": "(isodow(impression_time) >= 6)::INT", "is_front_page": "(e.context_article_id is null)::INT", "device_type": "-1",
    "is_sso_user": "0", "is_subscriber": "0", "user_age": "null", "gender": "-1", "context_read_time": "null", "context_scroll_percentage": "null",
    "position_in_view": "position", "relative_position_in_view": "position / 7e0",
    "context_category_match": "coalesce(d.category = c.category, false)::INT", "context_topic_overlap": "coalesce(shared.n, 0)",
    "context_embed_sim": "list_inner_product(av.vec, cv.vec)", "session_position": "session_position", "session_start_gap_h": "session_start_gap_h"}
_PLAIN_FROM = """eimp e left join docs d on d.article_id = e.article_id left join docs c on c.article_id = e.context_article_id
    join ltf on ltf.user_id = e.user_id and ltf.article_id = e.article_id join stf on stf.user_id = e.user_id and stf.p = e.p and stf.article_id = e.article_id
    left join ltrank on ltrank.user_id = e.user_id and ltrank.category = d.category left join lastcats on lastcats.user_id = e.user_id and lastcats.category = d.category
    left join usersent on usersent.user_id = e.user_id left join userprof on userprof.user_id = e.user_id
    left join day_clicks on day_clicks.user_id = e.user_id and day_clicks.p = e.p left join hpop on hpop.article_id = e.article_id
    left join vocab on vocab.category = d.category left join (select article_id, count(*) as n from topics group by article_id) nt on nt.article_id = e.article_id
    left join dvecs av on av.article_id = e.article_id left join dvecs cv on cv.article_id = e.context_article_id
    left join (select z.article_id as aid, z.context_article_id as cid, count(*) as n from
      (select distinct article_id, context_article_id from eimp where context_article_id is not null) z join topics x on x.article_id = z.article_id
      join topics y on y.article_id = z.context_article_id and y.topic = x.topic group by all) shared on shared.aid = e.article_id and shared.cid = e.context_article_id
    join (select impression_id, session_position, session_start_gap_h from sess) s on s.impression_id = e.impression_id"""
_RELATIVE_SQL = {out: _pct(c) for c, out in K.RANKED.items()} | {
    "article_age_minus_imp_min": "article_age_h - min(article_age_h) over (partition by impression_id)",
    "lt_embed_sim_minus_imp_max": "lt_embed_sim - max(lt_embed_sim) over (partition by impression_id)"}


def _digits(c: str) -> int:
    return 9 if c == "lt_sentiment_distance" else 6


@query("k_feature_frame", "with plain as (select e.impression_id, e.position, " + ", ".join(f"({x})::DOUBLE as {c}" for c, x in _PLAIN_SQL.items()) + f" from {_PLAIN_FROM}), "
       + "relative as (select *, " + ", ".join(f"{x} as {c}" for c, x in _RELATIVE_SQL.items()) + " from plain) select "
       + f"{POS}, " + ", ".join(f"round({c}, {_digits(c)}) as {c}" for c in K.FEATURES) + " from relative")
def _(v):
    """All 65 features."""
    return _out(frame(v), *[F.round(F.col(c).cast("double"), _digits(c)).alias(c) for c in K.FEATURES])


@query("k9_scroll_optional", "select user_id, round(avg(read_time * 2e0), 6) as user_mean_scroll from ehist where article_id % 3 <> 0 group by user_id")
def _(v):
    """Scroll depth, which only some clicks have."""
    hist = v.ehist.withColumn("scroll", F.when(F.col("article_id") % 3 != 0, F.col("read_time") * 2.0))
    return K.user_profile(hist, v.docs).filter("user_mean_scroll is not null").select("user_id", r6("user_mean_scroll"))


@query("k10_item_optional", f"""select {POS}, case article_id % 4 when 0 then 0 when 1 then 1 when 2 then 2 else -1 end as sentiment_label,
    case when article_id % 5 = 0 then 0 when article_id % 5 = 1 then -1 else 1 end::BIGINT as article_type,
    case when article_id % 6 = 0 then 0 else length(category || title) end::BIGINT as body_len, least(article_id % 300, 127)::BIGINT as n_entities
    from eimp left join docs using (article_id)""")
def _(v):
    """Label, type (null and unseen ones too), body and entity count of the articles."""
    d = F.col("article_id")
    docs = v.docs.withColumns({
        "sentiment_label": F.element_at(F.array(*[F.lit(x) for x in ("Negative", "Neutral", "Positive", "other")]), (d % 4 + 1).cast("int")),
        "article_type": F.when(d % 5 == 0, F.lit(None).cast("string")).when(d % 5 == 1, "new").otherwise("b"),
        "body": F.when(d % 6 != 0, F.concat("category", "title")), "n_entities": d % 300})
    types = v.spark.createDataFrame([("__unknown__", 0), ("b", 1)], "value string, code long")
    rows = K.item_features(v.eimp, docs, v.topics, v.vocab, PR.history_popularity(v.ehist), types)
    return _out(rows, "sentiment_label", "article_type", "body_len", "n_entities")


@query("k11_context_optional", f"""select {POS}, case when impression_id % 4 = 3 then -1 else impression_id % 4 end as device_type,
    case when impression_id % 3 = 0 then 0 else impression_id % 2 end as is_sso_user, impression_id % 2 as is_subscriber,
    case when impression_id % 5 > 0 then 20e0 + impression_id % 50 end as user_age, case when impression_id % 3 = 2 then -1e0 else (impression_id % 3)::DOUBLE end as gender,
    case when impression_id % 7 > 0 then (impression_id % 90)::DOUBLE end as context_read_time, (impression_id % 101)::DOUBLE as context_scroll_percentage from eimp""")
def _(v):
    """The request columns that an event may carry, with nulls among them."""
    e = F.col("impression_id")
    rows = v.eimp.withColumns({
        "device_type": F.when(e % 4 != 3, e % 4), "is_sso_user": F.when(e % 3 != 0, e % 2 == 1), "is_subscriber": e % 2 == 1,
        "age": F.when(e % 5 > 0, 20 + e % 50), "gender": F.when(e % 3 != 2, (e % 3).cast("double")),
        "read_time": F.when(e % 7 > 0, (e % 90).cast("double")), "scroll_percentage": (e % 101).cast("double")})
    return _out(K.context_features(rows), *K.CONTEXT[5:12])


# --- fitted models ---------------------------------------------------------------------------
# Histories end where the impressions begin, so no feature looks past its impression. Models
# are fitted on the earlier impressions (stopped on their last day) and scored on the later.

CLICKS_END, FIT_END = "2024-01-11", "2024-01-24"


def _time(text):
    return F.lit(text).cast("timestamp_ntz")


def _split(v):
    """(past clicks, impressions to fit on, impressions to score)."""
    hist = v.ehist.filter(F.col("click_time") < _time(CLICKS_END))
    fit = v.eimp.filter((F.col("impression_time") >= _time(CLICKS_END)) & (F.col("impression_time") < _time(FIT_END)))
    return hist, fit, v.eimp.filter(F.col("impression_time") >= _time(FIT_END))


def _combiner_rows(v, imp, hist):
    uterms = T.ClickedTerms(hist, v.dterms)
    rows = C.combiner_features(imp, hist, v.docs, v.dvecs, E.entity_mentions(v.docs).select("article_id", "entity_id").distinct(),
                               PR.train_popularity(v.etrain, v.docs), uterms, v.postings)
    return checkpointed(rows.select("impression_id", "position", "user_id", "article_id", "clicked", *C.COMBINER))


def _auc(scored, **also):
    return M.auc_per_impression(scored).agg(*[F.lit(x).alias(n) for n, x in also.items()],
                                            F.round(F.avg("auc"), 6).alias("auc"), F.count("auc").alias("n_impressions"))


@query("c6_fit_logistic")
def _(v):
    """Coefficients of both arms and their AUC on later impressions."""
    hist, fit, late = _split(v)
    train, test = _combiner_rows(v, fit, hist), _combiner_rows(v, late, hist)
    values = C.scaler_values(C.fit_scaler(train, C.COMBINER))
    scaled, out = C.apply_scaler(train, values), None
    for name, balanced in (("plain", False), ("balanced", True)):
        model = C.fit_logistic(scaled, C.COMBINER, balanced)
        auc = _auc(C.apply_linear(test, C.COMBINER, model.coefficients, model.intercept, values), arm=name)
        part = C.coefficient_table(v.spark, C.COMBINER, model.coefficients, model.intercept).withColumn("arm", F.lit(name)).join(auc, "arm")
        out = part if out is None else out.unionByName(part)
    return out


def _gbt_frames(v):
    """The frames to fit on and to score, formed as one: a feature reads past clicks and its own list only."""
    hist, fit, late = _split(v)
    rows = K.feature_frame(fit.unionByName(late), hist, v.docs, v.subcats, v.topics, v.dvecs, v.vocab,
                           PR.history_popularity(hist), v.sessions)
    stored = checkpointed(rows.withColumn("_late", (F.col("impression_time") >= _time(FIT_END)).cast("int")), "_late")
    train, test = (stored.filter(F.col("_late") == part).drop("_late") for part in (0, 1))
    return recent_holdout(train, 24), test


def _fit_gbt(cols, rows):
    return C.fit_gbt(rows, cols, categorical=[c for c in K.CATEGORICAL if c in cols])


@query("c8_fit_gbt")
def _(v):
    """Scores of later impressions by trees on all features."""
    train, test = _gbt_frames(v)
    model, prepare, _ = _fit_gbt(K.FEATURES, train)
    return C.apply_model(model, prepare(test)).select("impression_id", i64("position"), r6("score"))


@query("c9_fit_pairwise_ranker")
def _(v):
    """AUC of the pairwise ranker on later impressions, beside random order."""
    hist, fit, late = _split(v)
    train, test = _combiner_rows(v, fit, hist), _combiner_rows(v, late, hist)
    values = C.scaler_values(C.fit_scaler(train, C.COMBINER))
    weights = C.fit_pairwise_ranker(C.apply_scaler(train, values), C.COMBINER)
    ranked = _auc(C.apply_linear(test, C.COMBINER, weights, 0.0, values), arm="pairwise")
    return ranked.unionByName(_auc(C.random_score(test), arm="random"))


_PAIR_X = ", ".join(f"p.{c} - n.{c} as x{i}" for i, c in enumerate(C.COMBINER))


@query("c9_pair_moments", f"""with d as (select {_PAIR_X} from combined p join combined n using (impression_id) where p.clicked = 1 and n.clicked = 0)
    """ + " union all ".join(f"select 'gram' as kind, {i} as i, {j} as j, round(sum(x{i} * x{j}), 4) as value from d" for i in range(len(C.COMBINER)) for j in range(len(C.COMBINER)))
       + " union all " + " union all ".join(f"select 'sum', {i}, null, round(sum(x{i}), 4) from d" for i in range(len(C.COMBINER)))
       + " union all select 'pairs', null, null, count(*)::DOUBLE from d")
def _(v):
    return C.pair_moments(_combined(v), C.COMBINER).select("kind", "i", "j", F.round("value", 4).alias("value"))


@query("c10_ablate_features")
def _(v):
    train, test = _gbt_frames(v)
    out = None
    for arm, cols in (("all", K.FEATURES), ("without_position", C.without_features(K.FEATURES))):
        model, prepare, _ = _fit_gbt(cols, train)
        part = _auc(C.apply_model(model, prepare(test)), arm=arm)
        out = part if out is None else out.unionByName(part)
    return out


@query("c11_feature_importance")
def _(v):
    train, test = _gbt_frames(v)
    model, prepare, inputs = _fit_gbt(K.FEATURES, train)
    importance = C.feature_importance(v.spark, model, inputs)
    small, prepare_small, _ = _fit_gbt(C.top_features(importance, 20), train)
    auc = {name: M.auc_per_impression(C.apply_model(m, p(test))).agg(F.avg("auc")).scalar()
           for name, m, p in (("auc_all", model, prepare), ("auc_top", small, prepare_small))}
    return importance.select("feature", r6("importance"), "rank", F.round(auc["auc_all"], 6).alias("auc_all"),
                             F.round(auc["auc_top"], 6).alias("auc_top"))
