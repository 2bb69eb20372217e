"""Ranking, metrics, slices, intervals and the end-to-end compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions.grouping import checkpointed
from presslens.operators import metrics as M, models as C, profiles as PR
from presslens.plans import evaluate as EV
from presslens.sources import readers as R, sinks as S
from suite.registry import i64, query, r6, whole_query
from suite.views import sql_weight

IMP_SQL = "impression_id, user_id"


def pop_scorer(v):
    return lambda rows: PR.popularity_score(rows, v.popularity)


@query("m1_rank_candidates", "select impression_id, article_id, position::BIGINT as position, round(score, 9) as score, rank::BIGINT as rank from ranked")
def _(v):
    return M.rank_candidates(v.scored, counted=v.imp).select("impression_id", "article_id", i64("position"), F.round("score", 9).alias("score"), i64("rank"))


@query("m1_rank_hot_groups", "select impression_id, article_id, position::BIGINT as position, rank::BIGINT as rank from ranked")
def _(v):
    """The same ranking with lists of six and more sent through the path for oversized groups."""
    return M.rank_candidates(v.scored, hot_limit=5).select("impression_id", "article_id", i64("position"), i64("rank"))


@query("m2_auc", f"select {IMP_SQL}, round(auc, 6) as auc from aucs")
def _(v):
    return M.auc_per_impression(v.scored, counted=v.imp).select("impression_id", "user_id", r6("auc"))


@query("m2_auc_hot_groups", f"select {IMP_SQL}, round(auc, 6) as auc from aucs")
def _(v):
    return M.auc_per_impression(v.scored, hot_limit=5).select("impression_id", "user_id", r6("auc"))


@query("m3_mrr", f"select {IMP_SQL}, round(mrr, 6) as mrr from rankmets")
def _(v):
    return M.mrr(M.rank_candidates(v.scored, counted=v.imp)).select("impression_id", "user_id", r6("mrr"))


@query("m4_ndcg", f"select {IMP_SQL}, round(ndcg5, 6) as ndcg5, round(ndcg10, 6) as ndcg10 from rankmets")
def _(v):
    return M.rank_metrics(M.rank_candidates(v.scored, counted=v.imp)).select("impression_id", "user_id", r6("ndcg5"), r6("ndcg10"))


@query("m5_official_scores", """select round(avg(auc), 6) as auc, round(avg(mrr_all), 6) as mrr, round(avg(ndcg5), 6) as ndcg5,
    round(avg(ndcg10), 6) as ndcg10, count(*) as n_impressions, count(*) - count(auc) as n_without_auc, count(*) - count(mrr_all) as n_without_click from (
    select impression_id, any_value(user_id) as user_id, sum(clicked * 1e0 / rank) / nullif(sum(clicked), 0) as mrr_all from ranked group by impression_id)
    join rankmets using (impression_id) join (
      select impression_id, case when p > 0 and n > 0 then (s - p * (p + 1) / 2e0) / (p * n) end as auc from (
        select impression_id, sum(clicked) as p, sum(1 - clicked) as n, sum(case when clicked = 1 then r end) as s from (
          select impression_id, clicked, row_number() over (partition by impression_id order by rank desc) as r from ranked) group by impression_id))
    using (impression_id)""")
def _(v):
    imp = checkpointed(v.imp)
    pred = R.parse_lines(S.prediction_lines(M.rank_candidates(PR.popularity_score(imp, v.popularity), counted=imp)).select("line"), "ranks")
    truth = R.parse_lines(S.truth_lines(imp).select("line"), "labels")
    scores = M.official_scores(R.read_predictions(pred, truth))
    return scores.select(r6("auc"), r6("mrr"), r6("ndcg5"), r6("ndcg10"), "n_impressions", "n_without_auc", "n_without_click")


@query("m6_diversity", f"select {IMP_SQL}, round(diversity10, 6) as diversity10 from divs")
def _(v):
    return M.diversity_at_k(M.rank_candidates(v.scored, counted=v.imp), v.art).select("impression_id", "user_id", r6("diversity10"))


@query("m7_novelty", f"select {IMP_SQL}, round(novelty10, 6) as novelty10 from novs")
def _(v):
    return M.novelty_at_k(M.rank_candidates(v.scored, counted=v.imp), v.popularity).select("impression_id", "user_id", r6("novelty10"))


@query("m8_catalog_coverage", """select coalesce(cohort, 'overall') as slice, count(distinct article_id) as n_seen,
    round(count(distinct article_id) * 1e0 / (select count(*) from art), 6) as coverage10
    from ranked join cohorts using (user_id) where rank <= 10 group by grouping sets ((), (cohort))""")
def _(v):
    return EV.evaluate_coverage(v.imp, pop_scorer(v), v.hist, v.art).select("slice", "n_seen", r6("coverage10"))


@query("m9_recall", """with top as (select user_id, article_id, row_number() over (partition by user_id order by count(*) desc, article_id) as rank
    from hist group by user_id, article_id)
    select impression_id, user_id, article_id, coalesce(rank <= 1, false)::DOUBLE as hit1, coalesce(rank <= 5, false)::DOUBLE as hit5,
    coalesce(rank <= 50, false)::DOUBLE as hit50 from imp left join top using (user_id, article_id) where clicked = 1""")
def _(v):
    from presslens.functions.grouping import top_k
    counts = v.hist.groupBy("user_id", "article_id").agg(F.count("*").alias("n"))
    top = top_k(counts, ["user_id"], [F.col("n").desc(), F.col("article_id")], 50, "rank")
    positives = v.imp.filter("clicked = 1").select("impression_id", "user_id", "article_id")
    return M.recall_at_k(top, positives, (1, 5, 50))


def _weights(n: int, seed: int = 0) -> str:
    draws = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT" for i in range(4))
    return f"""select user_id, b * 4 + i as replicate, {sql_weight('draws[i + 1]')} as w from (
        select user_id, b, [{draws}] as draws from (
        select user_id, b, md5(concat_ws(':', '{seed}', user_id::VARCHAR, b::VARCHAR)) as h from users, (select unnest(range(0, {n // 4})) as b))),
        (select unnest(range(0, 4)) as i)"""


def _recall_sql(top: str) -> str:
    """Recall of a top list by cohort, with the interval, over all clicked rows of the event impressions."""
    hits = ", ".join(f"coalesce(rank <= {k}, false)::DOUBLE as recall{k}" for k in (50, 100, 200))
    return f"""with top as ({top}), users as (select distinct user_id from eimp where clicked = 1), weights as ({_weights(2000)}),
    hits as (select user_id, case when coalesce(n_articles, 0) < 5 then 'cold' else 'warm' end as cohort, {hits}
      from eimp left join top using (user_id, article_id) left join hlen using (user_id) where clicked = 1),
    long as (select * from hits unpivot (x for metric in (recall50, recall100, recall200))),
    reps as (select coalesce(cohort, 'overall') as slice, metric, replicate, sum(w * s) / nullif(sum(w * n), 0) as r from (
      select user_id, cohort, metric, sum(x) as s, count(*) as n from long group by all) join weights using (user_id)
      group by grouping sets ((metric, replicate), (metric, cohort, replicate)))
    select * from (select coalesce(cohort, 'overall') as slice, metric, round(avg(x), 6) as value, count(*) as n_clicks, count(distinct user_id) as n_users
      from long group by grouping sets ((metric), (metric, cohort))) join (
      select slice, metric, round(quantile_cont(r, 0.025), 6) as ci_low, round(quantile_cont(r, 0.975), 6) as ci_high from reps group by slice, metric) using (slice, metric)"""


_EVENT_TIE = "('0x' || substr(md5(article_id::VARCHAR), 1, 8))::BIGINT"


def _recall(v, top):
    rows = EV.evaluate_recall(top, v.eimp.filter("clicked = 1").select("impression_id", "user_id", "article_id"), v.ehist)
    return rows.select("slice", "metric", r6("value"), "n_clicks", "n_users", r6("ci_low"), r6("ci_high"))


def _readers(v, rows):
    return rows.join(v.eimp.filter("clicked = 1").select("user_id").distinct(), "user_id", "left_semi")


@query("m9_recall_vectors", _recall_sql(f"""select user_id, article_id, row_number() over (partition by user_id order by round(s, 9) desc, {_EVENT_TIE}, article_id) as rank
    from (select user_id, article_id, sum(pooled.x * dvlong.x) as s from pooled join dvlong using (d)
      where user_id in (select user_id from eimp where clicked = 1) group by all) qualify rank <= 200"""))
def _(v):
    """Nearest 200 articles to the user's pooled vector."""
    from presslens.operators import vectors as E
    pooled = _readers(v, E.pool_mean(v.ehist, v.dvecs))
    return _recall(v, E.knn(pooled, v.dvecs, 200, key="user_id"))


@query("m9_recall_bm25", _recall_sql(f"""select user_id, article_id, row_number() over (partition by user_id order by round(s, 9) desc, {_EVENT_TIE}, article_id) as rank
    from (select user_id, article_id, coalesce(s, 0e0) as s from (select distinct user_id from uterms where user_id in (select user_id from eimp where clicked = 1))
      cross join (select article_id from docs) left join (
      select user_id, article_id, sum(qtf * weight) as s from uterms join postings using (term)
      where user_id in (select user_id from eimp where clicked = 1) group by all) using (user_id, article_id)) qualify rank <= 200"""))
def _(v):
    """Best 200 articles for the words of the user's history."""
    from presslens.operators import text as T
    return _recall(v, T.bm25_top_k(_readers(v, v.uterms), v.postings, v.docs, 200, key="user_id"))


def _per(v):
    return EV.per_impression_metrics(v.scored, v.hist, v.art, v.popularity)


@query("m10_metric_by_slice", """select coalesce(cohort, 'overall') as slice, metric, round(avg(x), 6) as value, count(x) as n_impressions,
    count(distinct case when x is not null then user_id end) as n_users, count(*) - count(x) as n_skipped
    from permetric group by grouping sets ((metric), (metric, cohort))""")
def _(v):
    rows = M.metric_by_slice(_per(v), EV.VALUES)
    return rows.select("slice", "metric", r6("value"), "n_impressions", "n_users", "n_skipped")


_BOOT = f"""with users as (select distinct user_id from imp), weights as ({_weights(2000)}),
    sums as (select coalesce(cohort, 'overall') as slice, metric, replicate, sum(w * s) / nullif(sum(w * n), 0) as r from (
      select user_id, cohort, metric, coalesce(sum(x), 0) as s, count(x) as n from permetric group by all)
      join weights using (user_id) group by grouping sets ((metric, replicate), (metric, cohort, replicate)))
    select slice, metric, round(quantile_cont(r, 0.025), 6) as ci_low, round(quantile_cont(r, 0.975), 6) as ci_high from sums group by slice, metric"""


@query("m11_bootstrap_ci", _BOOT)
def _(v):
    users = M.per_user_sums(_per(v), EV.VALUES, ["cohort"])
    return M.bootstrap_ci(users, EV.VALUES).select("slice", "metric", r6("ci_low"), r6("ci_high"))


_PAIRED = f"""with users as (select distinct user_id from imp), weights as ({_weights(2000)}),
    per as (select user_id, sum(mrr - ndcg5) as dd, count(*) as n from rankmets where ndcg5 is not null group by user_id),
    reps as (select replicate, sum(w * dd) / sum(w * n) as r from per join weights using (user_id) where w > 0 group by replicate)
    select round((select sum(dd) / sum(n) from per), 6) as diff, (select sum(n) from per)::BIGINT as n_impressions, (select count(*) from per) as n_users,
    round(quantile_cont(r, 0.025), 6) as ci_low, round(quantile_cont(r, 0.975), 6) as ci_high from reps"""


@query("m12_paired_bootstrap", _PAIRED)
def _(v):
    rows = M.paired_bootstrap(M.rank_metrics(M.rank_candidates(v.scored, counted=v.imp)), "mrr", "ndcg5")
    return rows.select(r6("diff"), "n_impressions", "n_users", r6("ci_low"), r6("ci_high"))


_RAND = "('0x' || substr(md5(concat_ws(':', '0', impression_id::VARCHAR, article_id::VARCHAR, position::VARCHAR)), 1, 8))::BIGINT / 4294967296e0"


def _arm_auc(score: str) -> str:
    return f"""select impression_id, user_id, case when p > 0 and n > 0 then (s - p * (p + 1) / 2e0) / (p * n) end as auc from (
        select impression_id, user_id, sum(clicked) as p, sum(1 - clicked) as n, sum(case when clicked = 1 then r end) as s from (
        select impression_id, user_id, clicked, rank() over (partition by impression_id order by sc)
          + (count(*) over (partition by impression_id, sc) - 1) / 2e0 as r from (select *, {score} as sc from scored)) group by impression_id, user_id)"""


_ARMS = f"""with users as (select distinct user_id from imp), weights as ({_weights(2000)}),
    arms as (select 'popularity' as arm, * from ({_arm_auc('score')}) union all select 'random', * from ({_arm_auc(_RAND)})
      union all select 'last_first', * from ({_arm_auc('position::DOUBLE')})),
    pairs as (select a.arm, b.arm as baseline, a.user_id, a.auc - b.auc as dd from arms a join arms b using (impression_id)
      where a.arm <> b.arm and b.arm in ('popularity', 'random') and a.auc is not null and b.auc is not null),
    reps as (select arm, baseline, replicate, sum(w * dd) / sum(w * n) as r from (select arm, baseline, user_id, sum(dd) as dd, count(*) as n from pairs group by all)
      join weights using (user_id) where w > 0 group by all),
    own as (select arm, quantile_cont(r, 0.025) as lo from (select arm, replicate, sum(w * auc) / sum(w) as r from arms join weights using (user_id)
      where auc is not null and w > 0 group by all) group by arm)
    select p.arm, p.baseline, round(p.diff, 6) as diff, round(lo2, 6) as ci_low, round(hi2, 6) as ci_high, p.n_impressions, p.n_users,
      (lo2 > 0 or hi2 < 0)::BIGINT as excludes_zero, (own.lo > (select avg(auc) from arms where arm = p.baseline))::BIGINT as clear_win
    from (select arm, baseline, avg(dd) as diff, count(*) as n_impressions, count(distinct user_id) as n_users from pairs group by all) p
    join (select arm, baseline, quantile_cont(r, 0.025) as lo2, quantile_cont(r, 0.975) as hi2 from reps group by all) q using (arm, baseline)
    join own using (arm)"""


@query("m13_compare_arms", _ARMS)
def _(v):
    scorers = {"popularity": pop_scorer(v), "random": C.random_score,
               "last_first": lambda rows: rows.withColumn("score", F.col("position").cast("double"))}
    rows = EV.evaluate_arms(v.imp, scorers, ["popularity", "random"])
    return rows.select("arm", "baseline", r6("diff"), r6("ci_low"), r6("ci_high"), "n_impressions", "n_users",
                       i64(F.col("excludes_zero").cast("int"), "excludes_zero"), i64(F.col("clear_win").cast("int"), "clear_win"))


@query("m14_evaluate", _BOOT.replace("select slice, metric, round(quantile_cont(r, 0.025), 6) as ci_low, round(quantile_cont(r, 0.975), 6) as ci_high from sums group by slice, metric",
    """select * from (select coalesce(cohort, 'overall') as slice, metric, round(avg(x), 6) as value, count(x) as n_impressions,
    count(distinct case when x is not null then user_id end) as n_users, count(*) - count(x) as n_skipped
    from permetric group by grouping sets ((metric), (metric, cohort))) join (
    select slice, metric, round(quantile_cont(r, 0.025), 6) as ci_low, round(quantile_cont(r, 0.975), 6) as ci_high from sums group by slice, metric) using (slice, metric)"""))
def _(v):
    rows = EV.evaluate(v.imp, pop_scorer(v), v.hist, v.art, v.popularity)
    return rows.select("slice", "metric", r6("value"), "n_impressions", "n_users", "n_skipped", r6("ci_low"), r6("ci_high"))


@query("m15_predict", """select impression_id, impression_id::VARCHAR || ' [' || string_agg(rank::VARCHAR, ',' order by position) || ']' as line
    from ranked group by impression_id""")
def _(v):
    return EV.predict(v.imp.drop("clicked"), pop_scorer(v))


@query("f6_train_popularity", "select article_id, round(popularity, 9) as popularity from pop union all select null, round(v, 9) from pop_floor")
def _(v):
    return v.popularity.select("article_id", F.round("popularity", 9).alias("popularity"))


@whole_query("f7_popularity_score", "select impression_id, article_id, round(score, 9) as score from scored")
def _(v):
    return v.scored.select("impression_id", "article_id", F.round("score", 9).alias("score"))


@whole_query("c1_minmax_in_group", """select impression_id, article_id, round(case when hi - lo < 1e-12 then 0e0 else (score - lo) / (hi - lo) end, 6) as score_mm
    from (select *, min(score) over (partition by impression_id) as lo, max(score) over (partition by impression_id) as hi from scored)""")
def _(v):
    return C.minmax_in_group(v.scored, "score").select("impression_id", "article_id", r6("score_mm"))


_UNKNOWN = "select *, case when article_id % 7 = 0 then null else score end as known from scored"


@query("c2_blend_unknown", f"""select impression_id, position::BIGINT as position, round(0.7e0 * mm + 0.3e0 * pm, 6) as score,
    row_number() over (partition by impression_id order by round(0.7e0 * mm + 0.3e0 * pm, 9) desc nulls last, position) as place from (
    select *, case when known is null then null when hi - lo < 1e-12 then 0e0 else (known - lo) / (hi - lo) end as mm,
      case when ph - pl < 1e-12 then 0e0 else (position - pl) / (ph - pl) end as pm from (
    select *, min(known) over w as lo, max(known) over w as hi, min(position::DOUBLE) over w as pl, max(position::DOUBLE) over w as ph
    from ({_UNKNOWN}) window w as (partition by impression_id)))""")
def _(v):
    """Candidates outside the index keep -inf, stand last, and do not touch the scale of the others."""
    from presslens.functions.grouping import row_numbers
    score = F.when(F.col("article_id") % 7 == 0, float("-inf")).otherwise(F.col("score"))
    rows = v.scored.withColumns({"known": score, "place": F.col("position").cast("double")})
    rows = C.blend(rows, {"known": 0.7, "place": 0.3}, out="blended")
    rows = row_numbers(rows.drop("place"), ["impression_id"], [F.round("blended", 9).desc(), F.col("position")], "place")
    shown = F.when(F.col("blended") > float("-inf"), F.col("blended"))
    return rows.select("impression_id", i64("position"), r6(shown, "score"), "place")


@query("c5_scaler_unknown", f"select round(avg(known), 9) as mean, round(stddev_pop(known), 9) as scale from ({_UNKNOWN})")
def _(v):
    score = F.when(F.col("article_id") % 7 == 0, float("-inf")).otherwise(F.col("score"))
    return C.fit_scaler(v.scored.withColumn("known", score), ["known"]).select(F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale"))


@whole_query("c12_cohort", "select impression_id, article_id, cohort from imp join cohorts using (user_id)")
def _(v):
    return C.cohort(v.imp, v.hist).select("impression_id", "article_id", "cohort")


@whole_query("c14_random_score", f"select impression_id, article_id, round({_RAND}, 9) as score from imp")
def _(v):
    return C.random_score(v.imp).select("impression_id", "article_id", F.round("score", 9).alias("score"))


@whole_query("k16_labels", "select impression_id, article_id, clicked::BIGINT as clicked from imp")
def _(v):
    from presslens.operators.features import labels
    return labels(v.imp.drop("clicked"), v.imp.filter("clicked = 1")).select("impression_id", "article_id", "clicked")


# --- training tables ---------------------------------------------------------------------

_NEG = """with neg as (select impression_id, article_id as negative, row_number() over (partition by impression_id order by
      sha256(concat_ws(':', '0', impression_id::VARCHAR, article_id::VARCHAR, position::VARCHAR)), position) as i,
      count(*) over (partition by impression_id) as n from imp where clicked = 0),
    pos as (select impression_id, user_id, article_id as positive, position, n, draw from imp
      join (select distinct impression_id, n from neg) using (impression_id), (select unnest(range(0, 4)) as draw) where clicked = 1)
    select impression_id, user_id, position::BIGINT as position, positive, draw, negative from (select *, 1 + case when n >= 4
      then (('0x' || substr(md5(concat_ws(':', '0', impression_id::VARCHAR, positive::VARCHAR, position::VARCHAR)), 1, 8))::BIGINT % n + draw) % n
      else ('0x' || substr(md5(concat_ws(':', '0', impression_id::VARCHAR, positive::VARCHAR, position::VARCHAR, draw::VARCHAR)), 1, 8))::BIGINT % n end as i
      from pos) join neg using (impression_id, i)"""


@whole_query("n3_negative_samples", _NEG)
def _(v):
    from presslens.operators.training import negative_samples
    return negative_samples(v.imp, 4).select("impression_id", "user_id", i64("position"), "positive", i64("draw"), "negative")


@query("n4_pad_history", """select user_id, string_agg(id::VARCHAR, ' ' order by k) as ids, any_value(least(n, 6)) as length from (
    select user_id, n, k, coalesce(ids[greatest(n - 6, 0) + k], -1) as id from (
      select user_id, count(*) as n, list(article_id order by pos) as ids from hist group by user_id), (select unnest(range(1, 7)) as k)) group by user_id""")
def _(v):
    from presslens.operators.training import pad_history
    rows = pad_history(v.hist, 6, -1)
    return rows.select("user_id", F.array_join(F.transform("article_ids", lambda x: x.cast("string")), " ").alias("ids"), "length")
