"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

from presslens.llm import queries

from .conftest import SF, needs_tables

COLUMNS = {
    "op1": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op2": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op3": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op4": {"doc_id", "class_id"},
    "op5": {"doc_id", "held_out", "score", "predicted"},
    "op6": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op7": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op9": {"vec_id", "n_links", "component_id", "kept"},
    "op10": {"doc_id", "size", "source_size", "target", "taken"},
    "op11": {"item_id", "rank", "doc_id", "score"},
    "op12": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
}


def test_one_query_an_operator():
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(COLUMNS)


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_over_the_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    table, key = {"op9": ("embeddings", "vec_id"), "op11": ("benchmark", "item_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    ids = {r[0] for r in duckdb.execute(f"select {key} from '{SF}/{table}.parquet'").fetchall()}
    assert {r[sorted(df.columns).index(key)] for r in rows} == ids
    if not name.startswith(("op6_", "op11_")):
        assert len(rows) == len(ids)
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(queries.ORACLES[name])
        names = [d[0] for d in want.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert sorted(names) == sorted(df.columns)
        assert sorted(rows) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline
    from presslens.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = [n for n, _ in corpus_pipeline.STAGES], []
    assert names == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] > 0
    pieces = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert corpus_pipeline.ORACLE_SQL is None
