"""The corpus pipeline, stage by stage and as a whole, and queries against their SQL."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from pitpanel.llm.queries import ORACLE_SQL, QUERIES
from pitpanel.llm.toxicity import THRESHOLD, fit, scored

from .odd import documents
from .test_minhash import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows, names: sorted(str([r[i] for i in sorted(range(len(names)), key=lambda i: names[i])]) for r in rows)
    assert key(df.collect(), df.columns) == key(result.fetchall(), columns)


def test_run_against_the_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out, score = scored(docs, model)
    rows = [(r.doc_id, r.text) for r in out.where(out[score] < THRESHOLD).collect()]
    groups = brute(rows, 5)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(w) for w in windows}
    clean = {i for i, t in rows if not any(tuple(words(t)[k : k + n]) in windows for n in sizes for k in range(len(words(t)) - n + 1))}
    kept = {r.doc_id for r in corpus_pipeline.mix(spark, docs.where(docs.doc_id.isin(list(clean))), SF).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == kept and len(got) == len(kept)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_takes_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = documents(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert 0 < len(rows) <= docs.count()
    assert stage(spark, docs.limit(0), SF).collect() == []
