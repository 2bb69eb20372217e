"""Readers, writers, schema contracts and the restartable stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from presslens.operators import audit as V, metrics as M, prepare as P
from presslens.plans import evaluate as EV
from presslens.sources import readers as R, sinks as S
from presslens.streaming import predictions as W

ENT = '[{"Label":"X","Type":"P","WikidataId":"Q1","Confidence":0.9,"OccurrenceOffsets":[1],"SurfaceForms":["x"]}]'


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def bundle(tmp_path):
    news = write(tmp_path / "news.tsv", f'N1\tsport\tgolf\tA "quoted\tabout\thttp://a\t{ENT}\t[]', "N2\tnews\tlocal\tB\t\thttp://b\t\t")
    beh = write(tmp_path / "behaviors.tsv", "1\tU1\t11/09/2019 8:00:00 AM\tN1 N2\tN1-1 N-2-0",
                "2\tU1\t11/10/2019 1:30:05 PM\tN1 N2\tN2-0 N1-1", "3\tU2\t11/10/2019 12:00:00 AM\t\tN1-0 N2-1")
    return news, beh


def test_tsv_readers(spark, bundle):
    art = {r.id: r for r in R.read_catalog_tsv(spark, bundle[0]).collect()}
    assert art["N1"].title == 'A "quoted' and art["N2"].abstract is None and art["N2"].title_entities is None
    beh = {r.impression_id: r for r in R.read_behaviors_tsv(spark, bundle[1]).collect()}
    assert str(beh["2"].impression_time) == "2019-11-10 13:30:05" and str(beh["3"].impression_time) == "2019-11-10 00:00:00"
    assert beh["3"].history is None


def test_unified_tables_pass_their_contracts(spark, bundle, tmp_path):
    articles = P.unify_catalog(R.read_catalog_tsv(spark, bundle[0]), "mind")
    rows = {r.article_id: r for r in articles.collect()}
    assert rows["mind:N2"].abstract == "" and json.loads(rows["mind:N2"].entities) == {"title_entities": [], "abstract_entities": []}
    assert json.loads(rows["mind:N1"].entities)["title_entities"][0]["SurfaceForms"] == ["x"]
    beh = R.read_behaviors_tsv(spark, bundle[1])
    imp = P.unify_impressions(P.explode_impressions(beh), "mind", "dev")
    got = {(r.impression_id, r.position): (r.article_id, r.clicked) for r in imp.collect()}
    assert got[("mind:dev:1", 1)] == ("mind:N-2", False) and got[("mind:dev:3", 1)] == ("mind:N2", True)
    V.validate_table(articles, V.ARTICLES, "mind")
    again = S.write_store(imp, V.IMPRESSIONS, "mind", str(tmp_path / "store"), "small", "dev", "impressions",
                          ["impression_id", "article_id"])
    assert again.count() == 6
    S.write_store(imp, V.IMPRESSIONS, "mind", str(tmp_path / "store"), "small", "train", "impressions", ["impression_id"])
    assert spark.read.parquet(str(tmp_path / "store/impressions")).count() == 12


def test_validation_lists_every_violation(spark):
    df = spark.createDataFrame([("a", None, "t", "x")], "article_id string, dataset string, title string, body string")
    with pytest.raises(V.SchemaError) as e:
        V.validate_table(df, V.ARTICLES, "mind")
    text = str(e.value)
    assert "dataset: null" in text and "body: only ebnerd" in text and "abstract: missing" in text and "category: missing" in text


def test_empty_list_is_not_null(spark):
    df = spark.createDataFrame([("u", "mind", [])], "user_id string, dataset string, article_ids array<string>")
    V.validate_table(df, {k: v for k, v in V.USER_HISTORY.items() if k in df.columns}, "mind")


def test_static_history(spark, bundle):
    beh = R.read_behaviors_tsv(spark, bundle[1])
    hist = {r.user_id: r.ids for r in P.static_history(beh).select("user_id", P.parse_history("history", "mind").alias("ids")).collect()}
    assert hist == {"U1": ["mind:N1", "mind:N2"], "U2": []}
    with pytest.raises(Exception, match="user U1"):
        P.static_history(beh.withColumn("history", F.concat("history", F.lit(" "), "impression_id"))).collect()


def test_tolerant_and_forbidden(spark):
    df = spark.createDataFrame([(1, [1, 2])], "user_id long, article_id_fixed array<bigint>")
    with pytest.raises(ValueError, match="impression_time_fixed"):
        R.tolerant(df, R.HISTORY_REQUIRED, R.HISTORY_OPTIONAL)
    full = df.withColumn("impression_time_fixed", F.array().cast("array<timestamp_ntz>"))
    out = R.tolerant(full, R.HISTORY_REQUIRED, R.HISTORY_OPTIONAL)
    assert out.columns == [*R.HISTORY_REQUIRED, *R.HISTORY_OPTIONAL] and out.first().read_time_fixed is None
    with pytest.raises(ValueError, match="next_read_time"):
        R.read_columns(spark, "/nowhere", ["user_id", "next_read_time"])


def test_bundle_articles_and_inview(spark):
    raw = spark.sql("""select 1 as article_id, 'T' as title, 'S' as subtitle, 'B' as body, 'cat' as category_str, array(3, 4) as subcategory,
        array('n') as ner_clusters, cast(null as array<string>) as entity_groups, array('t') as topics, timestamp_ntz'2023-01-01 00:00:00' as published_time""")
    row = P.unify_bundle_articles(raw, "ebnerd").first()
    assert json.loads(row.entities) == {"entity_groups": [], "ner_clusters": ["n"]} and row.subcategory == ["3", "4"]
    beh = spark.sql("""select 7 as impression_id, 9 as user_id, cast(null as double) as article_id, array(5, 6) as article_ids_inview,
        array(6) as article_ids_clicked union all select 8, 9, 5.0, array(5), cast(null as array<int>)""")
    got = {(r.impression_id, r.position): (r.article_id, r.clicked, r.is_front_page) for r in P.explode_inview(beh).collect()}
    assert got == {(7, 0): (5, False, True), (7, 1): (6, True, True), (8, 0): (5, False, False)}


def test_vectors_file(spark, tmp_path):
    path = write(tmp_path / "v.vec", "Q1\t1.0\t2.0\t", "Q2\t0.5\tx", "Q3\t3\t4", "lonely")
    got = {r.id: r.vec for r in R.read_vectors(spark, path).collect()}
    assert got == {"Q1": [1.0, 2.0], "Q3": [3.0, 4.0]}
    glove = write(tmp_path / "g.txt", "the 1 2", ". . 1 2", "of 3 4")
    assert {r.id for r in R.read_vectors(spark, glove, " ", 2, skip_blank=False).collect()} == {"the", "of"}


def test_prediction_files_round_trip(spark, tmp_path):
    imp = spark.createDataFrame([(i, 1, 10 * i + p, p, int(p == i % 3)) for i in range(1, 40) for p in range(3)],
                                "impression_id long, user_id long, article_id long, position int, clicked int")
    ranked = M.rank_candidates(imp.withColumn("score", F.col("article_id") % 4))
    path = str(tmp_path / "pred")
    assert S.write_predictions(ranked, path) == 39
    lines = [line for f in sorted(os.listdir(path)) if f.startswith("part") for line in open(f"{path}/{f}").read().split("\n") if line]
    assert [int(x.split()[0]) for x in lines] == list(range(1, 40)) and " [" in lines[0] and ", " not in lines[0]
    S.write_truth(imp, str(tmp_path / "truth"))
    joined = R.read_predictions(R.read_line_file(spark, path, "ranks"), R.read_line_file(spark, str(tmp_path / "truth"), "labels"))
    assert joined.count() == 117 and joined.filter("rank < 1").count() == 0


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def test_read_predictions_rules(spark):
    truth = R.parse_lines(lines(spark, "1 [0,1]", "2 []", "3 [1,0,0]"), "labels")
    pred = R.parse_lines(lines(spark, "1 [2,1]", "2 [1]"), "ranks")
    got = sorted(tuple(r) for r in R.read_predictions(pred, truth).collect())
    assert got == [("1", 0, 0, 2), ("1", 1, 1, 1), ("3", 0, 1, 1), ("3", 1, 0, 1), ("3", 2, 0, 1)]
    for bad in ("9 [1]", "1 [1]", "1 [0,1]"):
        with pytest.raises(Exception, match="for impression"):
            R.read_predictions(R.parse_lines(lines(spark, bad), "ranks"), truth).collect()
    with pytest.raises(Exception, match="malformed"):
        R.parse_lines(lines(spark, "1 [1, 2]"), "ranks").collect()


@pytest.fixture
def stream(spark, tmp_path):
    """Folders, and functions to add one input file and to run the stream."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*ids):
        rows = spark.createDataFrame([(i, i % 3) for i in ids], "impression_id long, user_id long")
        rows.selectExpr("impression_id", "user_id", "timestamp_ntz'2024-01-01 00:00:00' as impression_time",
                        "array(impression_id, impression_id + 1) as article_ids_inview").coalesce(1).write.mode("append").parquet(source)

    def run(checkpoint, max_files=None, fail_on=None):
        def scorer(rows):
            if fail_on is not None and not rows.filter(F.col("impression_id") == fail_on).isEmpty():
                raise RuntimeError("the scorer broke")
            return rows.withColumn("score", F.col("article_id").cast("double"))
        W.stream_predictions(spark, source, out, str(tmp_path / checkpoint), scorer, max_files=max_files)

    def written():
        return sorted(r.impression_id for r in W.read_stream_predictions(spark, out).collect())

    return source, out, put, run, written


def test_stream_continues_after_restart(spark, stream, tmp_path):
    source, out, put, run, written = stream
    put(*range(0, 10))
    run("ckpt")
    assert written() == list(range(10))
    put(*range(10, 15))
    run("ckpt")
    run("ckpt")
    got = {r.impression_id: r.line for r in W.read_stream_predictions(spark, out).collect()}
    assert written() == list(range(15)) and got[3] == "3 [2,1]"
    with pytest.raises(ValueError, match="other input"):
        W.stream_predictions(spark, str(tmp_path / "elsewhere"), out, str(tmp_path / "ckpt"), lambda rows: rows)


def test_stream_loses_nothing_with_its_checkpoint(stream):
    """Other batch sizes, added files, ids that come again: each id once, whatever checkpoint is used."""
    source, out, put, run, written = stream
    put(1, 2)
    put(3, 4)
    put(5, 6)
    run("first", max_files=1)
    put(7, 8, 1)
    put(9, 10, 7)
    run("second", max_files=3)
    assert written() == list(range(1, 11))
    put(11, 3, 9)
    run("third", max_files=2)
    run("second", max_files=1)  # an older checkpoint, found again
    assert written() == list(range(1, 12))


def test_stream_goes_on_after_a_failure(stream):
    source, out, put, run, written = stream
    for i in range(4):
        put(2 * i, 2 * i + 1)
    with pytest.raises(Exception, match="the scorer broke"):
        run("ckpt", max_files=1, fail_on=5)
    assert 5 not in written()
    run("ckpt", max_files=2)
    assert written() == list(range(8))


def test_stream_shows_only_what_the_manifest_names(spark, stream):
    """Lines of a batch that never committed neither count nor keep their impressions from being scored."""
    source, out, put, run, written = stream
    put(1, 2)
    run("first")
    spark.createDataFrame([(3, "3 [9]"), (2, "2 [9]")], "impression_id long, line string").write.parquet(f"{out}/lines/run=lost/batch=7")
    assert written() == [1, 2]
    put(3, 4)
    run("second")
    assert written() == [1, 2, 3, 4]
    assert W.read_stream_predictions(spark, out).filter("line like '%[9]'").isEmpty()


def test_predict_uses_candidate_order(spark):
    cand = spark.createDataFrame([("a", 1, 5, 0), ("a", 1, 6, 1), ("a", 1, 7, 2)],
                                 "impression_id string, user_id long, article_id long, position int")
    out = EV.predict(cand, lambda d: d.withColumn("score", F.when(F.col("article_id") == 6, 2.0).otherwise(F.col("article_id") / 10.0)))
    assert out.first().line == "a [3,1,2]"
