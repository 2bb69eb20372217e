"""The test tables reshaped as articles, impressions, histories and vectors, in both engines.

An order is an impression, its parts are the candidates, returned parts are clicks.
Purchase events are impressions over documents, views and clicks are histories.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from presslens.functions.expr import doubles
from presslens.functions.grouping import checkpointed, row_numbers
from presslens.operators import prepare as P, profiles as PR, text as T


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str, whole: bool = False):
        self.spark, self.sf_dir, self.whole = spark, sf_dir, whole

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_docs(self):
        return self.table("documents").count()

    @cached_property
    def n_vecs(self):
        return self.table("embeddings").count()

    # --- orders ------------------------------------------------------------------------
    @cached_property
    def art(self):
        return self.table("part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"),
                                         F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"))

    @cached_property
    def lines(self):
        joined = self.table("orders").join(self.table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.groupBy(
            F.col("o_orderkey").alias("impression_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("impression_time"), F.col("l_partkey").alias("article_id")).agg(
            F.min("l_linenumber").alias("ln"), F.max("l_quantity").alias("read_time"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("clicked"))

    @cached_property
    def imp(self):
        order = W.partitionBy("impression_id").orderBy("ln", "article_id")
        rows = self.lines if self.whole else self.lines.filter(F.col("impression_time") >= F.lit("2000-01-01").cast("timestamp_ntz"))
        return rows.select("impression_id", "user_id", "impression_time", "article_id", "clicked",
                           (F.row_number().over(order) - 1).alias("position"))

    @cached_property
    def train_imp(self):
        return self.lines.filter((F.col("impression_time") >= F.lit("1999-01-01").cast("timestamp_ntz"))
                                 & (F.col("impression_time") < F.lit("2000-01-01").cast("timestamp_ntz"))
                                 ).select("impression_id", "user_id", "article_id", "clicked")

    @cached_property
    def hist(self):
        old = checkpointed(self.lines.filter((F.col("impression_time") < F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("clicked") == 1)))
        order = [F.col(c) for c in ("impression_time", "impression_id", "ln", "article_id")]
        return row_numbers(old, ["user_id"], order, "pos").select(
            "user_id", "article_id", F.col("impression_time").alias("click_time"), "read_time", (F.col("pos") - 1).alias("pos"))

    @cached_property
    def rawbeh(self):
        tok = F.concat(F.col("article_id").cast("string"), F.lit("-"), F.col("clicked").cast("string"))
        packed = self.imp.groupBy("impression_id", "user_id").agg(
            F.array_sort(F.collect_list(F.struct("position", tok.alias("tok")))).alias("_t"))
        return packed.select("impression_id", "user_id",
                             F.array_join(F.transform("_t", lambda x: x["tok"]), " ").alias("impressions"))

    @cached_property
    def popularity(self):
        return PR.train_popularity(self.train_imp, self.art)

    @cached_property
    def scored(self):
        return PR.popularity_score(self.imp, self.popularity)

    # --- documents, vectors, events ------------------------------------------------------
    @cached_property
    def docs(self):
        d = F.col("doc_id")

        def entity(n, conf):
            return F.concat(F.lit('[{"WikidataId":"Q'), (d % n).cast("string"), F.lit(f'","Confidence":{conf}}}]'))

        return self.table("documents").select(
            d.alias("article_id"), F.col("text").alias("title"), F.col("lang").alias("category"),
            F.col("source").alias("subcategory"),
            (F.lit("2023-12-20").cast("timestamp_ntz") + F.make_dt_interval(hours=(d % 720).cast("int"))).alias("published_at"),
            (d % 10 == 0).alias("premium"), ((d % 100).cast("double") / 100.0).alias("sentiment_score"),
            entity(50, 0.9).alias("title_entities"), entity(13, 0.5).alias("abstract_entities"),
            F.concat(F.lit('{"title_entities":'), entity(50, 0.9), F.lit(',"abstract_entities":'), entity(13, 0.5),
                     F.lit("}")).alias("entities"))

    @cached_property
    def subcats(self):
        return self.docs.select("article_id", "subcategory")

    @cached_property
    def topics(self):
        d = F.col("doc_id")
        both = F.array(F.concat(F.lit("a"), (d % 7).cast("string")), F.concat(F.lit("b"), (d % 11).cast("string")))
        return self.table("documents").select(d.alias("article_id"), F.explode(both).alias("topic")).distinct()

    @cached_property
    def vecs(self):
        return self.table("embeddings").select(F.col("vec_id").alias("article_id"), doubles("embedding").alias("vec"))

    @cached_property
    def dvecs(self):
        ids = self.table("documents").select(F.col("doc_id").alias("_d"), (F.col("doc_id") % self.n_vecs).alias("article_id"))
        return ids.join(self.vecs, "article_id").select(F.col("_d").alias("article_id"), "vec")

    @cached_property
    def entity_vecs(self):
        return self.table("embeddings").select(F.concat(F.lit("Q"), F.col("vec_id").cast("string")).alias("entity_id"),
                                               doubles("embedding").alias("vec"))

    @cached_property
    def queries(self):
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @cached_property
    def ehist(self):
        nd = self.n_docs
        rows = self.table("events").filter(F.col("event_type").isin("view", "click")).select("user_id", "event_id", "ts", "value")
        return row_numbers(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "pos").select(
            "user_id", (F.col("event_id") % nd).alias("article_id"), F.col("ts").alias("click_time"),
            F.col("value").alias("read_time"), (F.col("pos") - 1).alias("pos"))

    @cached_property
    def eimp(self):
        nd = self.n_docs
        e = F.col("event_id")
        rows = self.table("events").filter(F.col("event_type") == "purchase").withColumn(
            "position", F.explode(F.sequence(F.lit(0), F.lit(7))))
        return rows.select(
            e.alias("impression_id"), "user_id", F.col("ts").alias("impression_time"), "position",
            ((e * 7 + F.col("position") * 131) % nd).alias("article_id"),
            F.when((e + F.col("position")) % 5 == 0, 1).otherwise(0).alias("clicked"),
            F.when(e % 3 == 0, (e * 11) % nd).alias("context_article_id"))

    @cached_property
    def etrain(self):
        return self.eimp.filter(F.col("impression_time") < F.lit("2024-01-11").cast("timestamp_ntz"))

    @cached_property
    def epopularity(self):
        return PR.train_popularity(self.etrain, self.docs)

    @cached_property
    def vocab(self):
        return P.fit_vocab(self.docs, "category")

    @cached_property
    def dterms(self):
        return checkpointed(T.doc_terms(self.docs))

    @cached_property
    def postings(self):
        return checkpointed(T.bm25_index(self.docs, terms=self.dterms))

    @cached_property
    def uterms(self):
        return T.user_query(self.ehist, self.dterms)

    @cached_property
    def clicked_terms(self):
        return T.ClickedTerms(self.ehist, self.dterms)

    @cached_property
    def sessions(self):
        from presslens.operators.features import session_features
        rows = self.eimp.select("impression_id", "user_id", "impression_time").distinct()
        return session_features(rows.withColumn("session_id", F.to_date("impression_time")))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def sql_hash32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def sql_key(*parts) -> str:
    return "concat_ws(':', " + ", ".join(f"'{p}'" if isinstance(p, int) else f"{p}::VARCHAR" for p in parts) + ")"


def sql_weight(draw: str) -> str:
    """Poisson(1) weight of a 32-bit draw, from the distribution function as SQL arithmetic."""
    term, total, cuts = "exp(-1e0)", "exp(-1e0)", []
    for k in range(1, 13):
        cuts.append(f"floor(({total}) * 4294967296e0)::BIGINT")
        term = f"({term}) / {k}e0"
        total = f"({total}) + ({term})"
    return "(" + " + ".join(f"(case when {draw} >= {c} then 1 else 0 end)" for c in cuts) + ")"


SQL_VIEWS = {
    "art": "select p_partkey as article_id, p_name as title, p_brand as category, p_type as subcategory from part",
    "lines": """select o_orderkey as impression_id, o_custkey as user_id, o_orderdate as impression_time,
        l_partkey as article_id, min(l_linenumber) as ln, max(l_quantity) as read_time,
        max(case when l_returnflag = 'R' then 1 else 0 end) as clicked
        from orders join lineitem on l_orderkey = o_orderkey group by all""",
    "imp": """select impression_id, user_id, impression_time, article_id, clicked,
        row_number() over (partition by impression_id order by ln, article_id) - 1 as position
        from lines where impression_time >= timestamp '2000-01-01'""",
    "train_imp": """select impression_id, user_id, article_id, clicked from lines
        where impression_time >= timestamp '1999-01-01' and impression_time < timestamp '2000-01-01'""",
    "hist": """select user_id, article_id, impression_time as click_time, read_time,
        row_number() over (partition by user_id order by impression_time, impression_id, ln, article_id) - 1 as pos
        from lines where impression_time < timestamp '2000-01-01' and clicked = 1""",
    "rawbeh": """select impression_id, user_id,
        string_agg(article_id::VARCHAR || '-' || clicked::VARCHAR, ' ' order by position) as impressions
        from imp group by impression_id, user_id""",
    "pop": """select article_id, (sum(clicked) + 1e0) / ((select sum(clicked) from train_imp) + 1e0 * (select count(*) from art)) as popularity
        from train_imp group by article_id having sum(clicked) > 0""",
    "pop_floor": "select 1e0 / ((select sum(clicked) from train_imp) + 1e0 * (select count(*) from art)) as v",
    "scored": """select imp.*, coalesce(popularity, (select v from pop_floor)) as score
        from imp left join pop using (article_id)""",
    "ranked": f"""select *, row_number() over (partition by impression_id order by score desc,
        sha256({sql_key(0, 'impression_id', 'article_id', 'position')}), position) as rank from scored""",
    "cohorts": """select user_id, case when coalesce(n, 0) < 5 then 'cold' else 'warm' end as cohort
        from (select distinct user_id from imp) left join (select user_id, count(*) as n from hist group by user_id) using (user_id)""",
    "aucs": """select impression_id, user_id, case when p > 0 and n > 0 then (s - p * (p + 1) / 2e0) / (p * n) end as auc from (
        select impression_id, user_id, sum(clicked) as p, sum(1 - clicked) as n, sum(case when clicked = 1 then r end) as s from (
        select impression_id, user_id, clicked, rank() over (partition by impression_id order by score)
          + (count(*) over (partition by impression_id, score) - 1) / 2e0 as r from scored) group by impression_id, user_id)""",
    "rankmets": """select impression_id, user_id, coalesce(1e0 / min(case when clicked = 1 then rank end), 0e0) as mrr,
        case when sum(clicked) > 0 then coalesce(sum(case when rank <= 5 then clicked / log2(rank + 1) end), 0)
          / list_sum(list_transform(range(1, least(sum(clicked), 5)::BIGINT + 1), lambda i: 1e0 / log2(i + 1))) end as ndcg5,
        case when sum(clicked) > 0 then coalesce(sum(case when rank <= 10 then clicked / log2(rank + 1) end), 0)
          / list_sum(list_transform(range(1, least(sum(clicked), 10)::BIGINT + 1), lambda i: 1e0 / log2(i + 1))) end as ndcg10
        from ranked group by impression_id, user_id""",
    "divs": """select impression_id, user_id, case when n >= 2 then 1e0 - same / (n * (n - 1e0)) end as diversity10 from (
        select impression_id, user_id, sum(c) as n, sum(c * (c - 1)) as same from (
        select impression_id, user_id, category, count(*) as c from ranked left join art using (article_id)
        where rank <= 10 group by all) group by impression_id, user_id)""",
    "novs": """select impression_id, user_id, avg(-log2(coalesce(popularity, (select v from pop_floor)))) as novelty10
        from ranked left join pop using (article_id) where rank <= 10 group by impression_id, user_id""",
    "perimp": """select * from aucs join rankmets using (impression_id, user_id) join divs using (impression_id, user_id)
        join novs using (impression_id, user_id) join cohorts using (user_id)""",
    "permetric": """select * from (select impression_id, user_id, cohort, auc, mrr, ndcg5, ndcg10, diversity10, novelty10 from perimp)
        unpivot include nulls (x for metric in (auc, mrr, ndcg5, ndcg10, diversity10, novelty10))""",
    "docs": """select doc_id as article_id, text as title, lang as category, source as subcategory,
        timestamp '2023-12-20' + (doc_id % 720) * interval '1' hour as published_at,
        doc_id % 10 = 0 as premium, cast(doc_id % 100 as double) / 100e0 as sentiment_score,
        concat('[{"WikidataId":"Q', doc_id % 50, '","Confidence":0.9}]') as title_entities,
        concat('[{"WikidataId":"Q', doc_id % 13, '","Confidence":0.5}]') as abstract_entities from documents""",
    "topics": """select distinct doc_id as article_id, topic from (select doc_id, concat('a', doc_id % 7) as topic from documents
        union all select doc_id, concat('b', doc_id % 11) as topic from documents)""",
    "vecs": "select vec_id as article_id, embedding::DOUBLE[] as vec from embeddings",
    "dvecs": """select doc_id as article_id, embedding::DOUBLE[] as vec from documents
        join embeddings on vec_id = doc_id % (select count(*) from embeddings)""",
    "dvlong": "select article_id, generate_subscripts(vec, 1) as d, unnest(vec) as x from dvecs",
    "queries": "select item_id as query_id, text from benchmark",
    "ehist": """select user_id, event_id % (select count(*) from documents) as article_id, ts as click_time, value as read_time,
        row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
        floor(epoch(ts))::BIGINT as t from events where event_type in ('view', 'click')""",
    "eimp": """select event_id as impression_id, user_id, ts as impression_time, position,
        (event_id * 7 + position * 131) % (select count(*) from documents) as article_id,
        case when (event_id + position) % 5 = 0 then 1 else 0 end as clicked,
        case when event_id % 3 = 0 then (event_id * 11) % (select count(*) from documents) end as context_article_id,
        floor(epoch(ts))::BIGINT as p from events, (select unnest(range(0, 8)) as position) where event_type = 'purchase'""",
    "etrain": "select * from eimp where impression_time < timestamp '2024-01-11'",
    "epop": """select article_id, (sum(clicked) + 1e0) / ((select sum(clicked) from etrain) + 1e0 * (select count(*) from docs)) as popularity
        from etrain group by article_id having sum(clicked) > 0""",
    "epop_floor": "select 1e0 / ((select sum(clicked) from etrain) + 1e0 * (select count(*) from docs)) as v",
    "vocab": "select category, row_number() over (order by category) - 1 as code from (select distinct category from docs)",
    # text
    "dtok": f"""select * from (select article_id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+')) as term from docs)
        where term not in ({_STOP})""",
    "dlen": "select article_id, count(term) as doc_len from docs left join dtok using (article_id) group by article_id",
    "dterms": "select article_id, term, count(*) as tf, any_value(doc_len) as doc_len from dtok join dlen using (article_id) group by article_id, term",
    "idf0": """select term, ln((select count(*) from docs) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) as idf from dterms group by term""",
    "idfs": "select term, case when idf < 0 then 0.25e0 * (select avg(idf) from idf0) else idf end as idf from idf0",
    "postings": """select term, article_id, idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * doc_len / (select avg(doc_len) from dlen))) as weight
        from dterms join idfs using (term)""",
    "qterms": f"""select query_id, term, count(*) as qtf from (select query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as term from queries)
        where term not in ({_STOP}) group by all""",
    "uterms": "select user_id, term, sum(tf)::BIGINT as qtf from ehist join dterms using (article_id) group by all",
    "epairs": "select distinct user_id, article_id from eimp",
    "bm25c": """select user_id, article_id, coalesce(s, 0e0) as bm25 from epairs left join (
        select user_id, article_id, sum(qtf * weight) as s from epairs join postings using (article_id)
        join uterms using (user_id, term) group by all) using (user_id, article_id)""",
    # pooled vectors, long form
    "pooled": """select user_id, d, s / sqrt(sum(s * s) over (partition by user_id)) as x from (
        select user_id, d, sum(x) as s from ehist join dvlong using (article_id) group by all)""",
    "rpooled": """select user_id, d, s / sqrt(sum(s * s) over (partition by user_id)) as x from (
        select user_id, d, sum(x * power(0.9e0, back)) as s from (
          select *, row_number() over (partition by user_id order by pos desc) - 1 as back from ehist
          where article_id in (select article_id from dvecs))
        join dvlong using (article_id) group by all)""",
    "cosc": """select user_id, article_id, coalesce(sum(pooled.x * dvlong.x), 0e0) as cosine from epairs
        join dvlong using (article_id) left join pooled using (user_id, d) group by all""",
    "recc": """select user_id, article_id, coalesce(sum(rpooled.x * dvlong.x), 0e0) as recency_cosine from epairs
        join dvlong using (article_id) left join rpooled using (user_id, d) group by all""",
    "hlen": "select user_id, count(*) as n_articles from ehist group by user_id",
    "entities": """select article_id, 'Q' || (article_id % 50) as entity_id, 0.9e0 as confidence from docs
        union all select article_id, 'Q' || (article_id % 13), 0.5e0 from docs""",
    "esets": "select distinct article_id, entity_id from entities",
    "pcat": "select user_id, category, count(*) as n from ehist join docs using (article_id) group by all",
    "psub": "select user_id, subcategory, count(*) as n from ehist join docs using (article_id) group by all",
    "pent": "select user_id, entity_id, count(*) as n from ehist join esets using (article_id) group by all",
    "catm": """select user_id, article_id, coalesce(pcat.n * 1e0 / n_articles, 0e0) as category_match,
        coalesce(psub.n * 1e0 / n_articles, 0e0) as subcategory_match
        from epairs left join docs using (article_id) left join pcat using (user_id, category)
        left join psub using (user_id, subcategory) left join hlen using (user_id)""",
    "eov": """select user_id, article_id, coalesce(s, 0)::BIGINT as entity_overlap from epairs left join (
        select user_id, article_id, sum(n) as s from epairs join esets using (article_id) join pent using (user_id, entity_id)
        group by all) using (user_id, article_id)""",
    "combined": """select impression_id, user_id, article_id, position, clicked, impression_time, bm25, cosine, recency_cosine,
        category_match, subcategory_match, ln(1e0 + entity_overlap) as log_entity_overlap,
        ln(coalesce(popularity, (select v from epop_floor))) as log_popularity
        from eimp join bm25c using (user_id, article_id) join cosc using (user_id, article_id) join recc using (user_id, article_id)
        join catm using (user_id, article_id) join eov using (user_id, article_id) left join epop using (article_id)""",
    # long-term profile
    "engaged": """select user_id, article_id, sum(1e0 + ln(1e0 + least(greatest(coalesce(read_time, 0e0), 0e0), 600e0))) as w
        from ehist where article_id in (select article_id from docs) group by all""",
    "acat": """select user_id, category, s / sum(s) over (partition by user_id) as affinity from (
        select user_id, category, sum(w) as s from engaged join docs using (article_id) group by all)""",
    "asub": """select user_id, subcategory, s / sum(s) over (partition by user_id) as affinity from (
        select user_id, subcategory, sum(w) as s from engaged join docs using (article_id) group by all)""",
    "atop": """select user_id, topic, s / sum(s) over (partition by user_id) as affinity from (
        select user_id, topic, sum(w) as s from engaged join topics using (article_id) group by all)""",
    "ltvec": """select user_id, d, s / sqrt(sum(s * s) over (partition by user_id)) as x from (
        select user_id, d, sum(w * x) as s from engaged join dvlong using (article_id) group by all)""",
    "eusers": "select distinct user_id from ehist",
    "ltf": """select e.user_id, e.article_id, coalesce(acat.affinity, 0e0) as lt_cat_affinity,
        coalesce(asub.affinity, 0e0) as lt_subcat_affinity, coalesce(tp.s, 0e0) as lt_topic_affinity, sim.s as lt_embed_sim
        from epairs e left join docs d on d.article_id = e.article_id
        left join acat on acat.user_id = e.user_id and acat.category = d.category
        left join asub on asub.user_id = e.user_id and asub.subcategory = d.subcategory
        left join (select user_id, article_id, sum(affinity) as s from epairs join topics using (article_id)
          join atop using (user_id, topic) group by all) tp on tp.user_id = e.user_id and tp.article_id = e.article_id
        left join (select user_id, article_id, sum(ltvec.x * dvlong.x) as s from epairs join dvlong using (article_id)
          join ltvec using (user_id, d) group by all) sim on sim.user_id = e.user_id and sim.article_id = e.article_id""",
    "ltrank": """select user_id, category, row_number() over (partition by user_id order by coalesce(affinity, 0e0) desc, code) - 1 as lt_cat_rank
        from eusers cross join vocab left join acat using (user_id, category)""",
    # short-term: plain interval join
    "moments": "select distinct user_id, p from eimp",
    "recent": f"""select m.user_id, m.p, h.article_id, sum(exp(-ln(2e0) / 86400e0 * (m.p - h.t))) as w, count(*) as n
        from moments m join ehist h on h.user_id = m.user_id and h.t < m.p and h.t >= m.p - 604800 group by all""",
    "stcat": """select user_id, p, category, s / sum(s) over (partition by user_id, p) as aff, s from (
        select user_id, p, category, sum(w) as s from recent join docs using (article_id) group by all)""",
    "strank": """select user_id, p, category, row_number() over (partition by user_id, p order by coalesce(s, 0e0) desc, code) - 1 as st_cat_rank
        from (select distinct user_id, p from stcat) cross join vocab left join stcat using (user_id, p, category)""",
    "stsub": """select user_id, p, subcategory, s / sum(s) over (partition by user_id, p) as aff from (
        select user_id, p, subcategory, sum(w) as s from recent join docs using (article_id) group by all)""",
    "sttop": """select user_id, p, topic, s / sum(s) over (partition by user_id, p) as aff from (
        select user_id, p, topic, sum(w) as s from recent join topics using (article_id) group by all)""",
    "stvec": """select user_id, p, d, s / sqrt(sum(s * s) over (partition by user_id, p)) as x from (
        select user_id, p, d, sum(w * x) as s from recent join dvlong using (article_id) group by all)""",
    "epa": "select distinct user_id, p, article_id from eimp",
    "stf": """select e.user_id, e.p, e.article_id, coalesce(stcat.aff, 0e0) as st_cat_affinity,
        coalesce(stsub.aff, 0e0) as st_subcat_affinity, coalesce(tp.s, 0e0) as st_topic_affinity, sim.s as st_embed_sim,
        strank.st_cat_rank
        from epa e left join docs d on d.article_id = e.article_id
        left join stcat on stcat.user_id = e.user_id and stcat.p = e.p and stcat.category = d.category
        left join strank on strank.user_id = e.user_id and strank.p = e.p and strank.category = d.category
        left join stsub on stsub.user_id = e.user_id and stsub.p = e.p and stsub.subcategory = d.subcategory
        left join (select user_id, p, article_id, sum(aff) as s from epa join topics using (article_id)
          join sttop using (user_id, p, topic) group by all) tp on tp.user_id = e.user_id and tp.p = e.p and tp.article_id = e.article_id
        left join (select user_id, p, article_id, sum(stvec.x * dvlong.x) as s from epa join dvlong using (article_id)
          join stvec using (user_id, p, d) group by all) sim on sim.user_id = e.user_id and sim.p = e.p and sim.article_id = e.article_id""",
    "usersent": "select user_id, avg(sentiment_score) as mean_sentiment from ehist join docs using (article_id) group by user_id",
    "lastcats": """select user_id, category, min(b) as b from (select user_id, category,
        row_number() over (partition by user_id order by pos desc) as b from ehist join docs using (article_id)) where b <= 5 group by all""",
    "day_clicks": """select m.user_id, m.p, count(h.t) as n from moments m join eusers using (user_id)
        left join ehist h on h.user_id = m.user_id and h.t < m.p and h.t >= m.p - 86400 group by all""",
    "userprof": """select user_id, ln(1e0 + count(*)) as log_history_len, avg(read_time) as user_mean_read_time,
        quantile_cont(read_time, 0.5) as user_median_read_time, count(distinct category) as user_distinct_categories,
        avg(t - epoch(published_at)) / 3600e0 as user_mean_article_age_h, (max(t) - min(t)) / 3600e0 as user_history_span_h,
        max(t) as last_t from ehist left join docs using (article_id) group by user_id""",
    "hpop": """select article_id, count(*) as clicks,
        sum(exp(-ln(2e0) / 86400e0 * greatest((select max(t) from ehist) - t, 0))) as decayed from ehist group by article_id""",
    "sess": """select impression_id, user_id, row_number() over (partition by user_id, d order by impression_time, impression_id) as session_position,
        (epoch_us(impression_time) - min(epoch_us(impression_time)) over (partition by user_id, d)) / 3.6e9 as session_start_gap_h
        from (select distinct impression_id, user_id, impression_time, impression_time::DATE as d from eimp)""",
}


def with_views(sql: str, whole: bool = False) -> str:
    """Put the views a statement needs in front of it, in order of dependency."""
    needed: list[str] = []
    texts = SQL_VIEWS | ({"imp": SQL_VIEWS["imp"].split(" where ")[0]} if whole else {})

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in SQL_VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text) and name not in needed:
                visit(texts[name], (*seen, name))
                if name not in needed:
                    needed.append(name)

    visit(sql, ())
    if not needed:
        return sql
    head = "with " + ",\n".join(f"{n} as ({texts[n]})" for n in needed)
    if sql.lstrip().startswith("with "):
        return head + ",\n" + sql.lstrip()[5:]
    return head + "\n" + sql
