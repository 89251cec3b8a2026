import random

import duckdb
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import corpus_pipeline
from tablesight.llm import mixing
from tablesight.llm.queries import ORACLES, QUERIES

from .test_links import shingles


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir).sql(ORACLES[name])) is None


def test_targets_fill_up_to_the_caps(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 5000, "d": 0, "e": 300}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", "e", None]
    weight, total = dict(zip(names, [5, 2, 1, 5, 2, 1])), 1.5 * sum(sizes.values())
    want, free = {}, set(names)
    while True:  # share by weight, fix what exceeds its cap, share the rest again
        level = (total - sum(want.values())) / sum(weight[n] for n in free)
        above = {n for n in free if weight[n] * level > 2 * sizes[n]}
        if not above:
            break
        want |= {n: 2.0 * sizes[n] for n in above}
        free -= above
    want |= {n: weight[n] * level for n in free}
    assert {n: got[n].target for n in names} == pytest.approx(want) and sum(want.values()) == pytest.approx(total)


def test_mix_comes_near_its_targets(documents):
    rng = random.Random(1)
    rows = [(i, "word " * rng.choice([0, 1, 3, 10, 200]), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(None, "some words", "a"), (None, None, "b"), (5, rows[5][1], rows[5][2]), (700, "w " * 50_000, "d"), (701, "x", "z"), (702, None, "empty")]
    docs = documents(rows).withColumnRenamed("size", "size_").withColumn("size", F.lit("x"))
    got = mixing.mix(docs)
    rows_got = got.collect()
    assert len(rows_got) == len(rows) and sorted(map(repr, rows_got)) == sorted(map(repr, mixing.mix(docs).collect()))
    by_target = {}
    for r in rows_got:
        assert r.taken == r["size"] * r.times <= 2 * r["size"] and r.target <= 2 * r.source_size
        by_target.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), held in by_target.items():
        assert sum(r["size"] for r in held) == size
        assert abs(sum(r.taken for r in held) - target) <= max(r["size"] for r in held) / 2 + 1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.times for r in rows_got)
    assert mixing.mix(docs.where("false")).count() == mixing.mixed(docs.where("false")).count() == 0


def test_tied_draws_are_taken_apart(spark, documents, tmp_path):
    rows = [(None, "one two three", "c")] * 1_000 + [(None, f"one two {i % 7:03d}", "d") for i in range(1_000)] + [(i, "one two three", "a") for i in range(300)]
    got = mixing.mix(documents(rows).repartition(5)).collect()
    for source_size, target in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if (r.source_size, r.target) == (source_size, target)) - target) <= 1.5
    assert mixing.mixed(documents(rows).repartition(3)).count() == sum(r.times for r in got)
    documents(rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert difference(QUERIES["op4_mixing"](spark, str(tmp_path)), con.sql(ORACLES["op4_mixing"])) is None


def test_heavier_documents_come_first(spark):
    rows = spark.range(20_000).withColumn("weight", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25))
    first = rows.withColumn("key", -F.log(mixing.draw(F.col("id").cast("string"))) / F.col("weight")).orderBy("key").limit(2_000)
    assert 0.74 < first.where("weight = 1.0").count() / 2_000 < 0.86


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns on the labelled test tables."""
    sf_dir = "/root/testdata/sf0.01"
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(_stored(stage(spark, out[-1], sf_dir)))
    return out


def _stored(df):
    from tablesight.functions.storage import store

    return store(df)


def test_columns_and_names(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secrets", "mixing", "packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[1:5])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert sum((r.doc_id in kept) == (r.toxic == 0) for r in labels) >= 0.95 * len(labels)
    assert len(kept) >= 0.85 * stages[0].count()


def test_one_document_of_each_group_stays(stages):
    rows = sorted((r.doc_id, shingles(r.text, 5)) for r in stages[1].collect())
    parent = {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (a, x) in enumerate(rows):
        for b, y in rows[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({root(i) if x else i for i, x in rows})


def test_numbers_of_rows_outlive_another_split(spark, documents, tmp_path, monkeypatch):
    rng = random.Random(7)
    words = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(60)]
    documents([(i, words[i % 60], "a") for i in range(240)]).repartition(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    docs, link, size = spark.read.parquet(f"{tmp_path}/documents.parquet"), corpus_pipeline.jaccard.link, "spark.sql.files.maxPartitionBytes"

    def link_and_split_anew(rows, **options):  # as when executors come or go between two jobs
        groups = _stored(link(rows, **options))
        spark.conf.set(size, "2k")
        return groups

    monkeypatch.setattr(corpus_pipeline.jaccard, "link", link_and_split_anew)
    before = spark.conf.get(size)
    spark.conf.set(size, "1g")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        kept = sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect())
    finally:
        spark.conf.set(size, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert kept == list(range(60))


def test_own_columns_with_the_names_of_helpers_stay(spark):
    docs = spark.createDataFrame([(1, "password = hunter2hunter2 and more words", None, "a", 40, 7, 3), (2, "other text altogether, five words", None, "a", 34, 8, 4)],
                                 "doc_id long, text string, lang string, source string, n_chars long, _row int, _before int")
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r._row) for r in kept.collect()) == [(1, 7), (2, 8)]
    masked = corpus_pipeline.mask_secrets(spark, docs, "")
    assert masked.columns == docs.columns and sorted((r.doc_id, r._before) for r in masked.collect()) == [(1, 3), (2, 4)]


def test_secrets_are_masked(stages):
    from tablesight.llm import secrets

    before, after = {r.doc_id: r for r in stages[2].collect()}, {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not secrets.base_spans(r.text or "") and r.text == (secrets.masked(before[i].text) if before[i].text else before[i].text)
        assert r.n_chars == (len(r.text) if r.text != before[i].text else before[i].n_chars)


def test_mix_and_packing_hold_every_copy(stages):
    times = {}
    for r in mixing.mix(stages[3]).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + r.times
    copies = {}
    for r in stages[4].select("doc_id").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in times.items() if n}
    firsts = {}
    for r in stages[5].where("piece = 0").collect():
        firsts[r.doc_id] = firsts.get(r.doc_id, 0) + 1
    assert firsts == copies


def test_awkward_rows_pass_through_all_stages(spark, documents, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "fine words here to keep for all", "a"), (1, "fine words here to keep for all", "a"), (None, None, None), (None, "", "a"), (2, "password=abcdefgh12", None),
            (None, "the same text of no id at all", "b"), (None, "the same text of no id at all", "b"), (9, "w " * 30_000, "c")]
    for some in (rows, []):
        df = documents(some)
        for _, stage in corpus_pipeline.STAGES[:4]:
            after = _stored(stage(spark, df, str(tmp_path)))
            assert after.columns == df.columns
            df = after
        assert _stored(corpus_pipeline.pack_sequences(spark, df, str(tmp_path))).count() >= (4 if some else 0)
