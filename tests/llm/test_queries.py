import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import nbest_pieces, registry
from sparkloom.llm.common import load, stash
from tests.llm.test_duplicates import linked
from tests.llm.test_rules_and_lines import lines_of, rules_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    pick = [df.columns.index(c) for c in want.columns]
    assert sorted(tuple(r[i] for i in pick) for r in df.collect()) == sorted(want.fetchall())


def test_stages_against_plain_python(spark):
    docs = load(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    take = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    kept = stash(stages["quality rules"](spark, docs, SF))
    rows = [(d, t) for d, t in rows if not (rules_of(t)[0] < 50 or 100 * rules_of(t)[4] > 50 * rules_of(t)[0])]
    assert kept.columns == docs.columns and take(kept) == sorted(rows)

    thin = stash(stages["line dedup"](spark, kept, SF))
    rows = [(d, t) for d, _, _, t in lines_of(rows)]
    assert take(thin) == sorted(rows) and thin.where(F.length("text") != F.col("n_chars")).count() == 0

    single = stash(stages["n-gram Jaccard join"](spark, thin, SF))
    classes = {d: c for d, c, _ in linked(rows)}
    rows = [(d, t) for d, t in rows if classes[d] == d]
    assert single.columns == docs.columns and take(single) == sorted(rows)

    clean = stash(stages["benchmark decontamination"](spark, single, SF))
    items = [" ".join(r.text.split()) for r in load(spark, SF, "benchmark").collect()]
    holds = lambda t: any(i in " ".join(t.split()) for i in items)
    assert {d for d, t in rows if holds(t)} <= {d for d, _ in rows} - {r.doc_id for r in clean.collect()}

    last = stages["SentencePiece encoding"](spark, clean, SF)
    model = nbest_pieces.model(nbest_pieces.default_model())
    assert {r.doc_id: model.decode(bytes(r.ids)) for r in last.collect()} == {r.doc_id: r.text for r in clean.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200 and "ids" in out.columns


def test_stages_on_odd_and_empty_rows(spark, odd, none, tmp_path):
    """Null and empty texts, repeated rows and columns with the operators' own names through each stage and on to the last one."""
    bench = spark.createDataFrame([(1, "too short"), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, none):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            alone = stage(spark, rows, str(tmp_path))
            docs = stash(stage(spark, docs, str(tmp_path)))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert alone.columns == rows.columns == docs.columns
            assert alone.count() <= rows.count() and (rows is odd or docs.count() == 0)
    assert docs.columns == ["doc_id", "n_pieces", "scores", "ids", "ids_crc32", "text_crc32"]
