"""Sources, sinks, preparation, audits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions.expr import epoch_seconds, prefix_id
from presslens.functions.grouping import checkpointed, scratch_folder
from presslens.operators import audit as V, prepare as P, profiles as PR, sampling as L
from presslens.sources import readers as R, sinks as S
from suite.registry import i64, long_vec, query, r6, whole_query

CAND_SQL = "impression_id::BIGINT as impression_id, user_id::BIGINT as user_id, article_id::BIGINT as article_id"


def _cand(df, *extra):
    return df.select(i64("impression_id"), i64("user_id"), i64("article_id"), *extra)


@query("s1_read_catalog_tsv", """select article_id::VARCHAR as id, category, subcategory, title,
    case when article_id % 2 = 0 then 'about ' || title end as abstract from art""")
def _(v):
    path = scratch_folder(v.spark, "catalog")
    even = F.when(F.col("article_id") % 2 == 0, F.concat(F.lit("about "), "title")).otherwise("")
    fields = [F.col("article_id").cast("string"), "category", "subcategory", "title", even, F.lit("http://x"), F.lit("[]"), F.lit("")]
    v.art.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return R.read_catalog_tsv(v.spark, path).select("id", "category", "subcategory", "title", "abstract")


@query("s2_read_behaviors_tsv", """select impression_id::VARCHAR as impression_id, user_id::VARCHAR as user_id, any_value(p) as seconds,
    string_agg(article_id::VARCHAR || '-' || clicked::VARCHAR, ' ' order by position) as impressions from eimp group by impression_id, user_id""")
def _(v):
    path = scratch_folder(v.spark, "behaviors")
    tok = F.concat_ws("-", F.col("article_id").cast("string"), F.col("clicked").cast("string"))
    packed = v.eimp.groupBy("impression_id", "user_id", "impression_time").agg(
        F.array_sort(F.collect_list(F.struct("position", tok.alias("t")))).alias("_t"))
    fields = [F.col("impression_id").cast("string"), F.col("user_id").cast("string"),
              F.date_format("impression_time", R.TIME_FORMAT), F.lit(""), F.array_join(F.transform("_t", lambda x: x["t"]), " ")]
    packed.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return R.read_behaviors_tsv(v.spark, path).filter(F.col("history").isNull()).select(
        "impression_id", "user_id", epoch_seconds("impression_time").alias("seconds"), "impressions")


@query("s3_read_columns", """select user_id, epoch_us(ts) as us, round(value, 6) as value from events
    where event_type = 'click' and value > 20 and user_id in (select user_id from events where event_type = 'purchase')""")
def _(v):
    users = v.table("events").filter("event_type = 'purchase'").select("user_id")
    df = R.read_columns(v.spark, f"{v.sf_dir}/events.parquet", ["user_id", "ts", "value"],
                        (F.col("event_type") == "click") & (F.col("value") > 20), users)
    return df.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), r6("value"))


@query("s4_tolerant_columns", """select c_custkey, c_name, null::DOUBLE as age, c_acctbal from customer""")
def _(v):
    return R.tolerant(v.table("customer"), {"c_custkey": "long", "c_name": "string"},
                      {"age": "double", "c_acctbal": "double"}, "customer")


_EVENT_COLUMNS = ["event_id", "user_id", "event_type", "ts", "value"]


@query("s5_forbid_columns", " union all ".join(
    [f"select '{c}' as name, 0 as refused, count({c}) as n_values from events" for c in _EVENT_COLUMNS]
    + [f"select '{c}', 1, null" for c in ("total_inviews", "total_pageviews", "total_read_time", "next_read_time", "next_scroll_percentage")]))
def _(v):
    """Every column asked of a log that has columns known only afterwards: refused, or its number of values."""
    path = scratch_folder(v.spark, "log")
    v.table("events").withColumns({c: F.lit(1.0) for c in R.FORBIDDEN_COLUMNS}).write.parquet(path)
    out = None
    for name in [*_EVENT_COLUMNS, *R.FORBIDDEN_COLUMNS]:
        try:
            part = R.read_columns(v.spark, path, [name]).agg(F.lit(name).alias("name"), F.lit(0).alias("refused"), F.count(name).alias("n_values"))
        except ValueError:
            part = v.spark.range(1).select(F.lit(name).alias("name"), F.lit(1).alias("refused"), F.lit(None).cast("long").alias("n_values"))
        out = part if out is None else out.unionByName(part)
    return out


@whole_query("s8_prediction_lines", """select impression_id::VARCHAR as impression_id,
    impression_id::VARCHAR || ' [' || string_agg(rank::VARCHAR, ',' order by position) || ']' as line from ranked group by impression_id""")
def _(v):
    from presslens.operators.metrics import rank_candidates
    return S.prediction_lines(rank_candidates(v.scored, counted=v.imp)).select(F.col("impression_id").cast("string").alias("impression_id"), "line")


@whole_query("s9_truth_lines", """select impression_id::VARCHAR as impression_id,
    impression_id::VARCHAR || ' [' || string_agg(clicked::VARCHAR, ',' order by position) || ']' as line from imp group by impression_id""")
def _(v):
    return S.truth_lines(v.imp).select(F.col("impression_id").cast("string").alias("impression_id"), "line")


@whole_query("s10_read_predictions", """select impression_id::VARCHAR as impression_id, position::BIGINT as position,
    clicked::BIGINT as label, rank::BIGINT as rank from ranked""")
def _(v):
    from presslens.operators.metrics import rank_candidates
    pred = R.parse_lines(S.prediction_lines(rank_candidates(v.scored, counted=v.imp)).select("line"), "ranks")
    truth = R.parse_lines(S.truth_lines(v.imp).select("line"), "labels")
    return R.read_predictions(pred, truth).select("impression_id", i64("position"), i64("label"), i64("rank"))


@query("s6_read_vectors", "select article_id::VARCHAR as id, generate_subscripts(vec, 1) as d, round(unnest(vec), 6) as x from vecs")
def _(v):
    path = scratch_folder(v.spark, "vectors")
    values = F.transform("embedding", lambda x: x.cast("string"))
    line = F.concat(F.col("vec_id").cast("string"), F.lit("\t"), F.array_join(values, "\t"), F.lit("\t"))
    v.table("embeddings").select(line.alias("value")).write.text(path)
    return long_vec(R.read_vectors(v.spark, path), "id")


@whole_query("s7_write_store", """select impression_id::VARCHAR as impression_id, user_id::VARCHAR as user_id, article_id::VARCHAR as article_id,
    clicked::BIGINT as clicked, 'eval' as split from imp""")
def _(v):
    text = [F.col(c).cast("string").alias(c) for c in ("impression_id", "user_id", "article_id")]
    rows = v.imp.select(*text, F.lit("mind").alias("dataset"), "impression_time", F.col("clicked").cast("boolean").alias("clicked"), "position")
    null = {"session_id": "string", "dwell_time": "double", "scroll_percentage": "double", "is_front_page": "boolean"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in null.items()})
    stored = S.write_store(rows, V.IMPRESSIONS, "mind", scratch_folder(v.spark, "store"), "orders", "eval", "impressions",
                           ["impression_id", "article_id"])
    return stored.select("impression_id", "user_id", "article_id", i64(F.col("clicked").cast("int"), "clicked"), "split")


@whole_query("w1_stream_predictions", """select impression_id, impression_id::VARCHAR || ' [' || string_agg(rank::VARCHAR, ',' order by position) || ']' as line
    from ranked group by impression_id""")
def _(v):
    """All orders arrive as files and are scored by a stream that stops when none is left."""
    from presslens.streaming.predictions import read_stream_predictions, stream_predictions
    base = scratch_folder(v.spark, "stream")
    packed = v.imp.groupBy("impression_id", "user_id", "impression_time").agg(
        F.array_sort(F.collect_list(F.struct("position", "article_id"))).alias("_a"))
    packed.select("impression_id", "user_id", "impression_time", F.transform("_a", lambda x: x["article_id"]).alias("article_ids_inview")
                  ).write.parquet(f"{base}/in")
    stream_predictions(v.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint",
                       lambda rows: PR.popularity_score(rows, v.popularity), max_files=4)
    return read_stream_predictions(v.spark, f"{base}/out").select("impression_id", "line")


@whole_query("w1_stream_restarted", """select impression_id, impression_id::VARCHAR || ' [' || string_agg(rank::VARCHAR, ',' order by position) || ']' as line
    from ranked group by impression_id""")
def _(v):
    """The checkpoint is lost twice, files arrive (some with orders that came before) and batches change their size: still one line for each order."""
    from presslens.streaming.predictions import read_stream_predictions, stream_predictions
    base = scratch_folder(v.spark, "stream")
    packed = v.imp.groupBy("impression_id", "user_id", "impression_time").agg(
        F.array_sort(F.collect_list(F.struct("position", "article_id"))).alias("_a"))
    packed = checkpointed(packed.select("impression_id", "user_id", "impression_time", F.transform("_a", lambda x: x["article_id"]).alias("article_ids_inview")))
    part = F.pmod(F.col("impression_id"), F.lit(5))
    for arriving, name, files in ((part < 3, "first", 1), (part.isin(2, 3), "second", 3), (part.isin(0, 4), "third", 2)):
        packed.filter(arriving).repartition(3).write.mode("append").parquet(f"{base}/in")
        stream_predictions(v.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint-{name}",
                           lambda rows: PR.popularity_score(rows, v.popularity), max_files=files)
    return read_stream_predictions(v.spark, f"{base}/out").select("impression_id", "line")


# --- preparation -------------------------------------------------------------------------

@whole_query("p1_prefix_id", """select 'shop:eval:' || impression_id as impression_id, 'shop:' || user_id as user_id,
    'shop:' || article_id as article_id from imp""")
def _(v):
    return v.imp.select(prefix_id("shop", "impression_id", "eval").alias("impression_id"),
                        prefix_id("shop", "user_id").alias("user_id"), prefix_id("shop", "article_id").alias("article_id"))


def _entity(confidence: str, n: int) -> str:
    return f"""'[{{"Confidence":{confidence},"WikidataId":"Q' || (article_id % {n}) || '"}}]'"""


_TITLE, _ABSTRACT = _entity("0.9", 50), _entity("0.5", 13)


@query("p2_combine_entities", f"""select article_id, '{{"abstract_entities":' || {_ABSTRACT} || ',"title_entities":' || {_TITLE} || '}}' as entities from docs""")
def _(v):
    return v.docs.select("article_id", P.combine_entities("title_entities", "abstract_entities").alias("entities"))


@query("p2_broken_entities", f"""select article_id, '{{"abstract_entities":' || case when article_id % 3 = 0 then '[]' else {_ABSTRACT} end
    || ',"title_entities":' || case when article_id % 5 < 2 then '[]' else {_TITLE} end || '}}' as entities from docs""")
def _(v):
    """Broken, null and blank entries on one side leave the other as it is."""
    d = F.col("article_id")
    title = F.when(d % 5 == 0, '[{"WikidataId":').when(d % 5 == 1, F.lit(None).cast("string")).otherwise(F.col("title_entities"))
    abstract = F.when(d % 3 == 0, "  ").otherwise(F.col("abstract_entities"))
    return v.docs.select("article_id", P.combine_entities(title, abstract).alias("entities"))


@query("p3_unify_articles", """select 'shop:' || article_id as article_id, 'shop' as dataset, title, '' as abstract, category,
    subcategory, 0::BIGINT as n_topics from art""")
def _(v):
    raw = v.art.select(F.col("article_id").alias("id"), "title", F.lit(None).cast("string").alias("abstract"), "category",
                       "subcategory", F.lit(None).cast("string").alias("title_entities"),
                       F.lit(None).cast("string").alias("abstract_entities"))
    return P.unify_catalog(raw, "shop").select("article_id", "dataset", "title", "abstract", "category",
                                               F.array_join("subcategory", " ").alias("subcategory"),
                                               i64(F.coalesce(F.size("topics"), F.lit(0)), "n_topics"))


@whole_query("p4_explode_impressions", f"select {CAND_SQL}, position::BIGINT as position, clicked::BIGINT as clicked from imp")
def _(v):
    return _cand(P.explode_impressions(v.rawbeh), i64("position"), i64(F.col("clicked").cast("int"), "clicked"))


@whole_query("p4_explode_unlabelled", f"select {CAND_SQL}, position::BIGINT as position from imp")
def _(v):
    bare = v.rawbeh.withColumn("impressions", F.regexp_replace("impressions", "-[01]", ""))
    return _cand(P.explode_impressions(bare, labelled=False), i64("position"))


@whole_query("p5_explode_inview", f"""select {CAND_SQL}, position::BIGINT as position, clicked::BIGINT as clicked,
    (impression_id % 3 <> 0)::BIGINT as is_front_page from imp""")
def _(v):
    packed = v.imp.groupBy("impression_id", "user_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "article_id"))).alias("_a"),
        F.collect_set(F.when(F.col("clicked") == 1, F.col("article_id"))).alias("article_ids_clicked"))
    beh = packed.select("impression_id", "user_id", F.transform("_a", lambda x: x["article_id"]).alias("article_ids_inview"),
                        "article_ids_clicked", F.when(F.col("impression_id") % 3 == 0, F.col("user_id")).alias("article_id"))
    return _cand(P.explode_inview(beh), i64("position"), i64(F.col("clicked").cast("int"), "clicked"),
                 i64(F.col("is_front_page").cast("int"), "is_front_page"))


_HISTORY_TEXT = """select c_custkey as user_id, string_agg(article_id::VARCHAR, ' ' order by pos) as history
    from customer left join hist on user_id = c_custkey group by c_custkey"""


def _history_text(v):
    packed = v.hist.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "article_id"))).alias("_h"))
    text = packed.select("user_id", F.array_join(F.transform("_h", lambda x: x["article_id"].cast("string")), " ").alias("history"))
    return v.table("customer").select(F.col("c_custkey").alias("user_id")).join(text, "user_id", "left")


@query("p6_parse_history", f"""select user_id, len(ids)::BIGINT as n, coalesce(ids[1], '') as first_id, coalesce(ids[-1], '') as last_id
    from (select user_id, case when history is null then [] else string_split(history, ' ') end as ids from ({_HISTORY_TEXT}))""")
def _(v):
    parsed = _history_text(v).select("user_id", P.parse_history("history").alias("ids"))
    return parsed.select("user_id", i64(F.size("ids"), "n"), F.coalesce(F.get("ids", F.lit(0)), F.lit("")).alias("first_id"),
                         F.coalesce(F.get("ids", F.size("ids") - 1), F.lit("")).alias("last_id"))


@whole_query("p7_static_history", f"""select user_id, coalesce(history, '') as history, 1::BIGINT as n_variants
    from (select distinct user_id from imp) join ({_HISTORY_TEXT}) using (user_id)""")
def _(v):
    beh = v.rawbeh.join(_history_text(v), "user_id")
    return P.static_history(beh).join(P.history_variants(beh), "user_id").select(
        "user_id", F.coalesce("history", F.lit("")).alias("history"), i64("n_variants"))


def _history_arrays(v):
    return P.recover_history_arrays(v.hist, {"article_id": "article_ids", "click_time": "click_times", "read_time": "read_times"})


@query("p8_explode_history", """select user_id, pos::BIGINT as pos, article_id, epoch(click_time)::BIGINT as t, read_time from hist""")
def _(v):
    rows = P.explode_history(_history_arrays(v), {"article_ids": "article_id", "click_times": "click_time", "read_times": "read_time"})
    return rows.select("user_id", i64("pos"), "article_id", epoch_seconds("click_time").alias("t"), "read_time")


@query("p9_recover_history_arrays", """select user_id, 0::BIGINT as part, count(*) as n, string_agg(article_id::VARCHAR, ' ' order by pos) as ids,
    string_agg(read_time::BIGINT::VARCHAR, ' ' order by pos) as reads from hist group by user_id""")
def _(v):
    return _history_arrays(v).select(
        "user_id", i64("part"), i64(F.size("article_ids"), "n"),
        F.array_join(F.transform("article_ids", lambda x: x.cast("string")), " ").alias("ids"),
        F.array_join(F.transform("read_times", lambda x: x.cast("long").cast("string")), " ").alias("reads"))


@query("p8_history_parts", "select user_id, pos::BIGINT as pos, article_id, epoch(click_time)::BIGINT as t from hist")
def _(v):
    """Histories in parts of four clicks and back to rows: positions go on over the parts."""
    arrays = {"article_id": "article_ids", "click_time": "click_times"}
    parts = P.recover_history_arrays(v.hist, arrays, part_size=4)
    rows = P.explode_history(parts, {o: a for a, o in arrays.items()})
    return rows.select("user_id", i64("pos"), "article_id", epoch_seconds("click_time").alias("t"))


@query("p9_history_parts", """select user_id, (pos // 4)::BIGINT as part, string_agg(article_id::VARCHAR, ' ' order by pos) as ids
    from hist group by user_id, pos // 4""")
def _(v):
    rows = P.recover_history_arrays(v.hist, {"article_id": "article_ids"}, part_size=4)
    return rows.select("user_id", i64("part"), F.array_join(F.transform("article_ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("p10_temporal_split", """select impression_id, user_id, article_id, case when impression_time < timestamp '1999-01-01' then 'history'
    when impression_time < timestamp '2000-01-01' then 'train' else 'validation' end as split from lines
    where impression_time < timestamp '2001-01-01'""")
def _(v):
    cuts = {"history": (None, "1999-01-01"), "train": ("1999-01-01", "2000-01-01"), "validation": ("2000-01-01", "2001-01-01")}
    return P.temporal_split(v.lines, "impression_time", cuts).select("impression_id", "user_id", "article_id", "split")


@query("p11_vocabulary", """select art.article_id, coalesce(code, -1)::BIGINT as code from art left join (
    select title, row_number() over (order by title) - 1 as code from (
      select distinct title from art join train_imp using (article_id) where clicked = 1 and impression_id in
        (select impression_id from train_imp group by impression_id having count(*) >= 7)))
    using (title)""")
def _(v):
    big = v.train_imp.groupBy("impression_id").agg(F.count("*").alias("n")).filter(F.col("n") >= 7)
    seen = v.train_imp.join(big, "impression_id", "left_semi").filter(F.col("clicked") == 1)
    vocab = P.fit_vocab(seen.join(v.art, "article_id"), "title")
    return P.apply_vocab(v.art, "title", vocab, "code").select("article_id", "code")


@query("p12_multi_hot", """select article_id, code::BIGINT as code from topics join (select topic, row_number() over (order by topic) - 1 as code
    from (select distinct topic from topics join ehist using (article_id) where read_time > 90)) using (topic)""")
def _(v):
    lists = v.topics.groupBy("article_id").agg(F.collect_list("topic").alias("topics"))
    read = v.topics.join(v.ehist.filter(F.col("read_time") > 90), "article_id")
    return P.multi_hot(lists, "article_id", "topics", P.fit_vocab(read, "topic", None))


@query("p13_epoch_seconds", "select event_id, floor(epoch(ts))::BIGINT as seconds from events")
def _(v):
    return v.table("events").select("event_id", epoch_seconds("ts").alias("seconds"))


# --- audits ------------------------------------------------------------------------------

@whole_query("v1_table_violations", """select field, rule, n_rows from (
    select 'article_id' as field, 'null in mandatory field' as rule, count(*) filter (where position = 0) as n_rows from imp
    union all select 'user_id', 'null in mandatory field', count(*) filter (where clicked = 1) from imp
    union all select 'session_id', 'only ebnerd may fill this field', count(*) filter (where position > 2) from imp
    union all select 'clicked', 'missing column', 1) where n_rows > 0""")
def _(v):
    broken = v.imp.select(
        "impression_id", F.lit("mind").alias("dataset"), F.when(F.col("clicked") != 1, F.col("user_id")).alias("user_id"),
        F.when(F.col("position") != 0, F.col("article_id")).alias("article_id"), "impression_time",
        F.when(F.col("position") > 2, F.lit("s")).alias("session_id"), F.lit(None).cast("double").alias("dwell_time"),
        F.lit(None).cast("double").alias("scroll_percentage"), F.lit(None).cast("boolean").alias("is_front_page"))
    return V.table_violations(broken, V.IMPRESSIONS, "mind")


@query("v2_history_leakage", """select user_id, floor(epoch(l))::BIGINT as last_click, floor(epoch(f))::BIGINT as first_impression from
    (select user_id, max(click_time) as l from ehist group by user_id) join
    (select user_id, min(impression_time) as f from eimp group by user_id) using (user_id) where l >= f""")
def _(v):
    return V.history_leakage(v.ehist, v.eimp).select(
        "user_id", epoch_seconds("last_click").alias("last_click"), epoch_seconds("first_impression").alias("first_impression"))


@query("v2_window_leakage", """select epoch(max(click_time))::BIGINT as last_click, (select epoch(min(impression_time))::BIGINT from imp) as first_impression,
    (max(click_time) >= (select min(impression_time) from imp))::BIGINT as leaks from hist""")
def _(v):
    return V.window_leakage(v.hist, v.imp).select(
        epoch_seconds("last_click").alias("last_click"), epoch_seconds("first_impression").alias("first_impression"),
        i64(F.col("leaks").cast("int"), "leaks"))


@query("v3_referential_integrity", """with cat as (select distinct article_id from train_imp where clicked = 1) select * from (
    select 'imp' as source, article_id, count(*) as n_rows from imp where article_id not in (select article_id from cat) group by article_id
    union all select 'hist', article_id, count(*) from hist where article_id not in (select article_id from cat) group by article_id)""")
def _(v):
    return V.referential_integrity(v.train_imp.filter("clicked = 1"), imp=v.imp, hist=v.hist)


@whole_query("v4_row_conservation", "select count(*) as expected_rows, count(*) as n_rows, 1::BIGINT as conserved from imp")
def _(v):
    packed = v.rawbeh.withColumn("tokens", F.split("impressions", " "))
    rows = V.row_conservation(packed, "tokens", P.explode_impressions(v.rawbeh))
    return rows.select("expected_rows", "n_rows", i64(F.col("conserved").cast("int"), "conserved"))


@whole_query("v4_population_counts", """select 'impressions' as name, count(distinct impression_id) as n from imp union all
    select 'users', count(distinct user_id) from imp union all select 'candidate_rows', count(*) from imp""")
def _(v):
    return V.population_counts(v.imp)


@query("v5_scale_report", """select split, count(distinct impression_id) as n_impressions, count(*) as n_candidates,
    round(count(*) * 1e0 / count(distinct impression_id), 6) as candidates_per_impression, count(*) * 260 as feature_bytes
    from (select case when impression_time < timestamp '2000-01-01' then 'train' else 'validation' end as split, impression_id from lines) group by split""")
def _(v):
    rows = P.temporal_split(v.lines, "impression_time", {"train": (None, "2000-01-01"), "validation": ("2000-01-01", None)})
    return V.scale_report(rows).select("split", "n_impressions", "n_candidates", r6("candidates_per_impression"), i64("feature_bytes"))


@query("v6_negative_age_rate", """select round(avg((age < 0)::INT), 6) as negative_rate, round(median(age), 6) as median_age_h, count(*) as n_candidates
    from (select (p - epoch(published_at)) / 3600e0 as age from eimp join docs using (article_id))""")
def _(v):
    return V.negative_age_rate(v.eimp, v.docs).select(r6("negative_rate"), r6("median_age_h"), "n_candidates")


@query("v7_popularity_bound", """select sum(clicks)::BIGINT as total, (select count(*) from ehist) as n_clicks, max(clicks) as max_raw,
    round(max(decayed), 6) as max_decayed, min(clicks) as min_raw, 1::BIGINT as ok from hpop""")
def _(v):
    from presslens.operators.profiles import history_popularity
    rows = V.popularity_bound(history_popularity(v.ehist), v.ehist)
    return rows.select("total", "n_clicks", "max_raw", r6("max_decayed"), "min_raw", i64(F.col("ok").cast("int"), "ok"))


@query("v8_coverage", """select round(avg((article_id in (select article_id from train_imp))::INT), 6) as coverage, count(*) as n_ids
    from (select distinct article_id from art)""")
def _(v):
    return V.coverage(v.art, v.train_imp).select(r6("coverage"), "n_ids")


# --- sampling ----------------------------------------------------------------------------

_SYSTEMATIC = """select {key} from (select {key}, row_number() over (order by {key}) - 1 as i, count(*) over () as total
    from (select distinct {key} from imp)) where i in (select floor(j * ((select count(distinct {key}) from imp) / {n}e0))::BIGINT
    + {offset} from (select unnest(range(0, {n})) as j))"""


@whole_query("l1_sample_impressions", f"select {CAND_SQL} from imp where impression_id in ({_SYSTEMATIC.format(key='impression_id', n=300, offset='7 % floor((select count(distinct impression_id) from imp) / 300e0)::BIGINT')})")
def _(v):
    return _cand(L.sample_impressions(v.imp, 300, seed=7))


@whole_query("l2_sample_users", f"select {CAND_SQL} from imp where user_id in ({_SYSTEMATIC.format(key='user_id', n=90, offset='3 % floor((select count(distinct user_id) from imp) / 90e0)::BIGINT')})")
def _(v):
    return _cand(L.sample_users(v.imp, 90, seed=3))


@whole_query("l2_sample_fidelity", f"""with kept as (select * from imp where user_id in ({_SYSTEMATIC.format(key='user_id', n=90, offset='3 % floor((select count(distinct user_id) from imp) / 90e0)::BIGINT')}))
    select 'sample' as source, count(distinct user_id) as n_users, count(distinct impression_id) as n_impressions,
    round(count(distinct impression_id) * 1e0 / count(distinct user_id), 6) as impressions_per_user from kept
    union all select 'population', count(distinct user_id), count(distinct impression_id),
    round(count(distinct impression_id) * 1e0 / count(distinct user_id), 6) from imp""")
def _(v):
    rows = L.sample_fidelity(L.sample_users(v.imp, 90, seed=3), v.imp)
    return rows.select("source", "n_users", "n_impressions", r6("impressions_per_user"))


@whole_query("l3_subsample_impressions", f"""select {CAND_SQL} from imp where impression_id in (select impression_id from
    (select distinct impression_id from imp) order by sha256(concat_ws(':', '5', impression_id::VARCHAR)), impression_id limit 250)""")
def _(v):
    return _cand(L.subsample_impressions(v.imp, 250, seed=5))


_DRAW = "('0x' || substr(md5(concat_ws(':', '11', user_id::VARCHAR)), 1, 8))::BIGINT / 4294967296e0"


@whole_query("l4_user_holdout", f"""select {CAND_SQL}, case when {_DRAW} < 0.2 or user_id = (select user_id from imp order by {_DRAW}, user_id limit 1)
    then 'holdout' else 'fit' end as part from imp""")
def _(v):
    return _cand(L.user_holdout(v.imp, 0.2, seed=11), "part")


@query("l5_recent_holdout", f"""select {CAND_SQL}, (impression_time >= (select max(impression_time) from eimp) - interval 24 hour)::BIGINT as is_stop from eimp""")
def _(v):
    return _cand(L.recent_holdout(v.eimp, 24), i64(F.col("is_stop").cast("int"), "is_stop"))


@query("l6_select_rows", """select w as wanted, event_id, user_id from (select row_number() over (order by event_id desc) - 1 as w, event_id // 2 as row_no
    from events) join (select event_id, user_id, event_id as row_no from events) using (row_no)""")
def _(v):
    events = v.table("events").select("event_id", "user_id")
    total = v.table("events").agg(F.count("*")).scalar()
    # events are numbered 0..n-1, so the wanted order (newest first, every id twice) needs no sort
    wanted = events.select((total - 1 - F.col("event_id")).alias("wanted"), F.floor(F.col("event_id") / 2).alias("row_no"))
    return L.select_rows(events.withColumn("row_no", F.col("event_id")), wanted).select(i64("wanted"), "event_id", "user_id")
