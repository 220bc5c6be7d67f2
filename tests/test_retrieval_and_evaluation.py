import numpy as np
import pytest

from folioscope.errors import EvaluationError, IndexingError, RetrievalError
from folioscope.operators import evaluation as E
from folioscope.operators import indexing as I
from folioscope.operators import retrieval as R
from folioscope.operators.encoders import HashEncoder, HashTokenEncoder, ModelEncoder, encode_column

SCORED = [(0, "a", [10], 0.9), (0, "b", [10, 11], 0.8), (0, "c", [12], 0.3)]


def scored(spark, rows=SCORED):
    return spark.createDataFrame(rows, "query_id long, chunk_id string, page_ids array<long>, score double")


@pytest.mark.parametrize("how,expected", [("max", {10: 0.9, 11: 0.8, 12: 0.3}), ("sum", {10: 1.7, 11: 0.8, 12: 0.3}), ("mean", {10: 0.85, 11: 0.8, 12: 0.3})])
def test_aggregations(spark, how, expected):
    got = {r.page_id: r.score for r in R.aggregate_pages(scored(spark), how).collect()}
    assert got == pytest.approx(expected)


def test_custom_aggregations_agree(spark):
    from pyspark.sql import functions as F

    ranked = R.rank_chunks(scored(spark))
    column = R.aggregate_pages(ranked, lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["score"] / x["rank"]))
    python = R.aggregate_with_python(ranked, lambda rows: sum(r["score"] / r["rank"] for r in rows))
    a = {r.page_id: r.score for r in column.collect()}
    assert a[10] == pytest.approx(0.9 + 0.8 / 2)
    assert a == pytest.approx({r.page_id: r.score for r in python.collect()})
    with pytest.raises(Exception, match="finite"):
        R.aggregate_with_python(ranked, lambda rows: float("nan")).collect()


def test_ties_go_to_the_smaller_page_and_top_k_counts_pages(spark):
    rows = [(0, "a", [11, 10], 0.9), (0, "b", [12], 0.8), (0, "c", [13], 0.2)]
    ranked = R.rank_chunks(scored(spark, rows))
    top = R.with_contributors(R.rank_pages(R.aggregate_pages(ranked), 2), ranked).orderBy("rank").collect()
    assert [(r.page_id, r.rank, r.chunks[0].chunk_id) for r in top] == [(10, 1, "a"), (11, 2, "a")]


@pytest.mark.parametrize("bad", [0, -1, True, 1.5])
def test_bad_top_k(bad):
    with pytest.raises(RetrievalError):
        R.check_top_k(bad)


def test_dense_scores_are_cosines(spark):
    rng = np.random.default_rng(0)
    m, q = rng.standard_normal((30, 8)), rng.standard_normal((3, 8))
    index = spark.createDataFrame([(f"c{i:02}", [i], v.tolist()) for i, v in enumerate(m)], "chunk_id string, page_ids array<long>, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    got = {(r.query_id, r.chunk_id): r.score for r in R.score_dense(index, asked, block=2).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit(q) @ unit(m).T
    assert len(got) == 90
    assert max(abs(got[i, f"c{j:02}"] - want[i, j]) for i in range(3) for j in range(30)) < 1e-6


@pytest.mark.parametrize("top_k", [1, 3, 100])
def test_pruned_pages_equal_the_whole_ranking(spark, top_k):
    rng = np.random.default_rng(1)
    m, q = rng.integers(-2, 3, (80, 4)), rng.integers(-2, 3, (5, 4))
    rows = [(f"c{i:02}", [int(p) for p in rng.choice(12, rng.integers(0, 3), replace=False)], [float(x) for x in v]) for i, v in enumerate(m)]
    index = spark.createDataFrame(rows, "chunk_id string, page_ids array<long>, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    whole = R.rank_pages(R.aggregate_pages(R.score_dense(index, asked, decimals=6)), top_k)
    got = R.retrieve(index, asked, top_k, decimals=6)
    key = lambda f: sorted((r.query_id, r.page_id, r.rank, r.score) for r in f.collect())
    assert key(got) == key(whole)


def _small_index(spark, seed=2, hot=None):
    rng = np.random.default_rng(seed)
    m, q = rng.integers(-2, 3, (90, 4)), rng.integers(-2, 3, (5, 4))
    m[(m == 0).all(axis=1)] = 1
    rows = [(f"c{i:02}", sorted({int(p) for p in rng.choice(12, rng.integers(1, 3), replace=False)} | ({hot} if hot is not None and i % 3 else set())), [float(x) for x in v]) for i, v in enumerate(m)]
    index = spark.createDataFrame(rows, "chunk_id string, page_ids array<long>, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    return index, asked


@pytest.mark.parametrize("hot", [None, 3])
@pytest.mark.parametrize("how", ["sum", "mean"])
def test_sums_by_page_equal_the_whole_ranking(spark, how, hot):
    index, asked = _small_index(spark, hot=hot)
    whole = R.rank_pages(R.aggregate_pages(R.score_dense(index, asked, decimals=6), how, 6), 4)
    sums = R.page_sums_dense(index, asked, 4, how, block=2, decimals=6, salts=3, margin=1e-6)
    got = R.rank_pages(sums.withColumn("score", R.F.round("score", 6)), 4)
    key = lambda f: sorted((r.query_id, r.page_id, r.rank, r.score) for r in f.collect())
    assert key(got) == key(whole) == key(R.retrieve(index, asked, 4, how, decimals=6, page_decimals=6))


@pytest.mark.parametrize("most", [7, 500_000])
@pytest.mark.parametrize("how", ["max", "sum"])
def test_contributors_have_their_ranks_among_all_chunks(spark, how, most):
    index, asked = _small_index(spark, 3)
    ranked = R.rank_chunks(R.score_dense(index, asked, decimals=6))
    pages = R.rank_pages(R.aggregate_pages(ranked, how, 6), 3).cache()
    key = lambda f: sorted((r.query_id, r.page_id, r.rank, [(c.rank, c.chunk_id, c.score, list(c.page_ids)) for c in r.chunks]) for r in f.collect())
    want = key(R.with_contributors(pages, ranked))
    assert key(R.contributors_dense(index, asked, pages, block=2, decimals=6, most_ranked=most)) == want


def test_retrieval_shuffles_no_row_per_query_and_chunk(spark):
    index, asked = _small_index(spark)
    plan = R.retrieve(index, asked, 3, "sum")._jdf.queryExecution().toString()
    assert "chunk_id" not in plan.split("MapInPandas")[0] and "page_ids" not in plan.split("MapInPandas")[0]


def test_late_scores_keep_the_first_of_a_batch(spark):
    rows = [(f"c{i:03}", [i], [[float(i % 7), 1.0]]) for i in range(40)]
    index = spark.createDataFrame(rows, "chunk_id string, page_ids array<long>, tokens array<array<float>>").coalesce(1)
    asked = spark.createDataFrame([(7, [[1.0, 0.0]])], "query_id long, tokens array<array<float>>")
    whole = R.rank_chunks(R.score_late(index, asked), 8).select("chunk_id", "rank")
    kept = R.score_late(index, asked, keep=8)
    assert kept.count() == 10 and R.rank_chunks(kept, 8).select("chunk_id", "rank").exceptAll(whole).count() == 0


def test_late_scores_are_max_sim(spark):
    index = spark.createDataFrame([("a", [1], [[1.0, 0.0], [0.0, 1.0]]), ("b", [2], [[0.5, 0.5]])], "chunk_id string, page_ids array<long>, tokens array<array<float>>")
    asked = spark.createDataFrame([(7, [[1.0, 0.0], [0.0, 2.0]])], "query_id long, tokens array<array<float>>")
    assert {r.chunk_id: r.score for r in R.score_late(index, asked).collect()} == pytest.approx({"a": 3.0, "b": 1.5})


def test_index_build_checks(spark):
    chunks = spark.createDataFrame([("d:00000000", "d", [1], "one two"), ("d:00000001", "d", [2], "three")], "chunk_id string, doc_id string, page_ids array<long>, content string")
    built = I.build_dense(chunks, HashEncoder(16)).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in built)
    assert all(len(t) == 4 for r in I.build_late(chunks, HashTokenEncoder(4)).collect() for t in r.tokens)
    with pytest.raises(IndexingError):
        I.build_dense(chunks.union(chunks), HashEncoder(16))
    with pytest.raises(IndexingError):
        I.build_dense(chunks, HashTokenEncoder(4))
    with pytest.raises(IndexingError):
        I.IndexingConfig("m", options={"batch_size": True})
    got = I.index_positions(chunks).orderBy("index_position").collect()
    assert [(r.index_position, r.chunk_id) for r in got] == [(0, "d:00000000"), (1, "d:00000001")]


def test_precomputed_embeddings_are_guarded(spark):
    schema = "chunk_id string, doc_id string, page_ids array<long>, content string, metadata map<string,string>, embedding array<float>"
    row = lambda i, model, v: (f"d:{i}", "d", [i], "text", {"embedding_model": model}, v)
    good = spark.createDataFrame([row(0, "m", [3.0, 4.0]), row(1, "m", [0.0, 2.0])], schema)
    assert np.allclose(sorted(list(r.embedding) for r in I.build_dense(good, None, model_name="m").collect()), [[0.0, 1.0], [0.6, 0.8]])
    for rows, model in (
        ([row(0, "m", [3.0, 4.0]), row(1, "n", [0.0, 2.0])], None),
        ([row(0, "m", [3.0, 4.0])], "other"),
        ([row(0, "m", [3.0, 4.0]), row(1, "m", [0.0, 0.0])], "m"),
        ([row(0, "m", [3.0, 4.0]), row(1, "m", [0.0])], "m"),
    ):
        for check in (True, False):
            with pytest.raises(IndexingError):
                I.build_dense(spark.createDataFrame(rows, schema), None, check=check, model_name=model)


def test_index_conflicts(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert I.index_conflicts(I.index_positions(chunks), chunks).count() == 0
    wrong = spark.createDataFrame([(0, "a"), (2, "a"), (1, "c")], "index_position long, chunk_id string")
    assert {r.rule for r in I.index_conflicts(wrong.where("index_position <> 1"), chunks).collect()} == {"positions", "id twice", "not in both"}


def test_encoders_of_queries_and_tokens(spark, monkeypatch):
    class Asking:
        kind, dimension = "dense", 1

        def encode(self, texts):
            return [[1.0]] * len(texts)

        def encode_query(self, texts):
            return [[2.0]] * len(texts)

    rows = spark.createDataFrame([(0, "x")], "query_id long, text string")
    assert encode_column(rows, "text", "v", Asking(), query=True).first().v == [2.0]
    assert encode_column(rows, "text", "v", Asking()).first().v == [1.0]

    class Model:
        def encode(self, texts, output_value=None):
            return [np.ones((3, 2))] * len(texts) if output_value == "token_embeddings" else np.zeros((len(texts), 2))

    monkeypatch.setattr("folioscope.operators.encoders._model", lambda *a: Model())
    assert ModelEncoder("m", 2).encode_query(["a"]) == [[0.0, 0.0]]
    assert ModelEncoder("m", 2, "late_interaction").encode(["a"]) == [[[1.0, 1.0]] * 3]


def test_runs_are_checked(spark):
    run, _ = run_and_qrels(spark)
    queries, pages = spark.createDataFrame([(0,), (1,)], "query_id long"), spark.createDataFrame([(10,), (11,), (20,), (21,)], "page_id long")
    E.require_run(run, queries, pages)
    for bad in (run.limit(0), run.union(run), run.withColumn("query_id", run["query_id"] + 7)):
        with pytest.raises(EvaluationError):
            E.require_run(bad, queries, pages)


def run_and_qrels(spark):
    run = spark.createDataFrame([(0, 10, 1), (0, 11, 2), (1, 21, 1), (1, 20, 2)], "query_id long, page_id long, rank int")
    qrels = spark.createDataFrame([(0, 10, 2), (0, 11, 1), (1, 20, 1), (5, 1, 1)], "query_id long, page_id long, score int")
    return run, qrels


def test_metric_anchor(spark):
    values = E.metric_values(*run_and_qrels(spark), cutoffs=(1, 5))
    means = {(r.family, r.k): r.value for r in E.aggregate_metrics(values).collect()}
    assert [means[f, 1] for f in E.FAMILIES] == [0.5, 0.25, 0.5, 0.5]
    assert means["RR", 5] == 0.75 and means["Recall", 5] == 1.0
    rows = {r.query_id: r.metrics for r in E.per_query(values).collect()}
    assert set(rows[0]) == {f"{f}@{k}" for f in E.FAMILIES for k in (1, 5)}


def test_grades_below_one_are_not_relevant(spark):
    run = spark.createDataFrame([(0, 1, 1)], "query_id long, page_id long, rank int")
    qrels = spark.createDataFrame([(0, 1, 0), (0, 2, -1), (0, 3, None)], "query_id long, page_id long, score int")
    assert {r.value for r in E.metric_values(run, qrels).collect()} == {0.0}


@pytest.mark.parametrize("bad", [[0], [-1], [True], [1.5], []])
def test_bad_cutoffs(bad):
    with pytest.raises(EvaluationError):
        E.check_cutoffs(bad)


def test_cutoffs_within_depth():
    assert E.check_cutoffs([10, 1, 1]) == [1, 10]
    with pytest.raises(EvaluationError):
        E.check_cutoffs([20], top_k=10)
    with pytest.raises(EvaluationError):
        E.check_metrics(["MAP"])
