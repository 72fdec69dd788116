"""Mixing, sharding, the registered queries and the pipeline."""

import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tributary.llm import queries
from tributary.llm.mixing import mix, source_targets
from tributary.llm.sharding import external_shuffle, record_bytes

SF_DIR = "/root/testdata/sf0.001"


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, fixed = {}, set()
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in fixed)
        target = {s: most * sizes[s] for s in fixed} | {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        fixed |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1}, {None: 50, "é": 70, "Z": 70, "z": 0}, {"one": 9}, {"a": 7, "b": 7, "c": 700, "d": 3}])
def test_targets_equal_rounds(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_mix_meets_targets_with_nulls_and_repeats(spark):
    rows = [(i, "word " * (i % 50), "big" if i % 2 else f"s{i % 4}", 1) for i in range(4_000)]
    rows += [(None, "no id", None, 2), (77, None, None, 3), (78, "", None, 4), (78, "", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)
    again = mix(df.repartition(3))
    key = lambda r: str((r.doc_id, r.text, r.source, r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    assert mix(df.limit(0)).count() == 0


def test_shuffle_keeps_records_and_balances(spark):
    rows = [(i if i % 3 else None, None if i == 4 else f"text {i % 5}" * (i % 7), i) for i in range(1_003)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = external_shuffle(df.withColumnRenamed("slot", "n"), size=record_bytes(df["text"]), bucket_bytes=2_000).collect()
    assert Counter((r.doc_id, r.text, r.n) for r in got) == Counter(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())
    order = [r.n for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    runs = sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False))
    assert runs < 40
    assert external_shuffle(df.limit(0), size=record_bytes(df["text"])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_answer_for_every_row(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    table = "pages" if name.startswith("op3") else "documents"
    if name.startswith("op1_"):
        assert df.groupBy("query_id").count().where("count <> 20").count() == 0
        return
    key = "page_id" if table == "pages" else "doc_id"
    ids = sorted(r[0] for r in df.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    mine = queries.QUERIES[name](spark, SF_DIR).select(*columns).collect()
    assert sorted(repr(tuple(r)) for r in mine) == sorted(repr(r) for r in cursor.fetchall())


def test_digests_of_shuffled_documents(spark):
    name = next(n for n in queries.QUERIES if n.startswith("op5_"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.QUERIES[name](spark, SF_DIR).collect():
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", "src0", 0), (90_001, "", "en", "src0", 0)], docs.schema)
    stage = docs.unionByName(odd)
    for i, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = f(spark, stage, SF_DIR)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        stage = spark.read.parquet(str(tmp_path / str(i)))
        assert stage.count() > 0
        empty = f(spark, docs.limit(0), SF_DIR)
        assert empty.columns == docs.columns and empty.count() == 0
    assert "token_ids" in corpus_pipeline.tokens(spark, stage, SF_DIR).columns


def test_pipeline_rows_follow_from_the_operators(spark):
    """Stages applied by hand, each from its operator's own result."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF_DIR)
    kept = corpus_pipeline.quality(spark, docs, SF_DIR)
    one = corpus_pipeline.near_copies(spark, kept, SF_DIR)
    copies = {r.doc_id: r.copies for r in mix(corpus_pipeline.privacy(spark, one, SF_DIR)).collect()}
    got = Counter(r.doc_id for r in rows.select("doc_id").collect())
    assert got == Counter({d: c for d, c in copies.items() if c})
    assert rows.where(F.col("n_tokens") != F.size("token_ids")).count() == 0


def test_entry_lists_the_queries():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
