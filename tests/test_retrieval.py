import math


import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.plugins import embedder
from lectern.operators import evaluation as ev
from lectern.operators import lexical as lx
from lectern.operators import retrieval as rt
from lectern.sources import index_store as ix

PASSAGES = [(0, "A", "harbour lights harbour", [1.0, 0.0]), (1, "B", "harbour fog", [0.9, 0.1]), (2, "C", "macula", [0.5, 0.5]), (3, "D", "", [0.0, 1.0])]


@pytest.fixture(scope="module")
def passages(spark):
    return spark.createDataFrame(PASSAGES, "passage_id bigint, doc_id string, text string, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(7, "harbour lights", [1.0, 0.0])], "query_id bigint, query string, vector array<float>")


def ranked(df, key="passage_id"):
    return [r[key] for r in df.orderBy("rank").collect()]


def test_modes(passages, queries):
    assert ranked(rt.retrieve(passages, queries, "vector", 3)) == [0, 1, 2]
    assert ranked(rt.retrieve(passages, queries, "bm25", 3)) == [0, 1]  # only passages that share a term
    fused = rt.retrieve(passages, queries, "hybrid", 4).orderBy("rank").collect()
    assert [round(r.score, 9) for r in fused[:2]] == [round(2 / 61, 9), round(2 / 62, 9)]
    with pytest.raises(ValueError):
        rt.retrieve(passages, queries, "other")


def test_results_do_not_depend_on_partitions(passages, queries):
    for mode in rt.MODES:
        a, b = (sorted(map(tuple, rt.retrieve(passages.repartition(n), queries, mode, 3).collect())) for n in (1, 7))
        assert a == b


def test_query_blocks(passages, queries):
    more = queries.unionByName(queries.withColumn("query_id", F.lit(8).cast("bigint")))
    one, two = (sorted(map(tuple, rt.vector_search(passages, more, 2, "passage_id", sent_bytes=n).collect())) for n in (1 << 20, 0))
    assert one == two and len(one) == 4


def test_top_n_sizes(spark):
    scored = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.1, 0.9, 0.5, 0.7))], "query_id int, item int, score double")
    assert [ranked(lx.top_k(scored, n), "item") for n in (3, 10, 0)] == [[1, 3, 2], [1, 3, 2, 0], []]


def test_weights(spark):
    p = spark.createDataFrame([(0, "harbour harbour fog")], "passage_id int, text string")
    got = {r.term: r.weight for r in lx.postings(p, ["passage_id"]).collect()}
    assert got == {"harbour": pytest.approx(2 * 2.5 / 3.5), "fog": pytest.approx(1.0)}


def test_no_cartesian_product_and_no_python_in_bm25(passages, queries):
    plan = lx.bm25_search(passages, queries, ["passage_id"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "MapIn" not in plan


def test_scores_are_summed_where_a_passage_is(spark, passages, queries):
    """Rows of a query and a passage are as many as all pairs; none but the k best of a task are moved, and no text twice."""
    plan = lx.bm25_search(passages, queries, ["passage_id"], 2)._jdf.queryExecution().executedPlan().toString()
    moved = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sorted(set(moved)) == ["passage_id", "query_id", "term"] and moved.count("passage_id") == moved.count("query_id") == 1


def exchanges(df):
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line.split("partitioning(")[1].split("], [plan")[0].split(", [plan")[0] for line in lines if "Exchange hash" in line or "Exchange range" in line]


def test_postings_are_moved_once_by_key(spark, passages):
    moved = exchanges(lx.sparse_vectors(lx.postings(passages, ["passage_id"]), ["passage_id"]))
    assert len(moved) == 1 and "term" not in moved[0]


def test_stored_postings_are_moved_once_and_summed_where_a_passage_is(spark, passages, queries):
    blocks = lx.lexical_blocks(passages, ["passage_id"])
    assert len([x for x in exchanges(blocks) if "part" in x]) == 1
    assert not [x for x in exchanges(lx.block_search(blocks, queries, ["passage_id"], 2)) if "query_id" in x and "passage_id" in x]


def test_blocks_of_queries_give_the_same_hits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passages = spark.createDataFrame([(i, words_of(rng, 20)) for i in range(200)], "passage_id int, text string")
    queries = spark.createDataFrame([(i, words_of(rng, 4)) for i in range(25)], "query_id int, query string")
    hits = lambda: sorted(map(tuple, lx.bm25_search(passages, queries, ["passage_id"], 3).collect()))
    want = hits()
    monkeypatch.setattr(lx, "SCORES", 240 * 9)
    monkeypatch.setattr(lx, "PART_PASSAGES", 80)
    assert hits() == want and len({r[0] for r in want}) == 25


def test_rerank_orders_on_the_logit(spark):
    hits = spark.createDataFrame([(1, i, r) for i, r in ((0, 1), (1, 2), (2, 3))], "query_id int, item int, rank int").withColumn("l", F.element_at(F.array(F.lit(30.0), F.lit(50.0), F.lit(40.0)), F.col("rank")))
    out = rt.rerank(hits, F.col("l")).orderBy("rank").collect()
    assert [r["item"] for r in out] == [1, 2, 0] and out[0].score == 1.0
    assert rt.rerank(hits.limit(0), F.col("l")).count() == 0
    assert rt.rerank(hits, F.lit(0.0), 2).orderBy("rank").first().score == 0.5


def test_pooled_searches_stop_at_a_repeat(spark):
    rounds = spark.createDataFrame([(1, 1, "q"), (1, 2, "other"), (1, 3, " Q "), (1, 4, "more"), (2, 1, "x"), *[(3, k, f"q{k}") for k in range(1, 8)]], "question int, round int, query string")
    got = sorted((r.question, r.round) for r in rt.pooled(rounds).collect())
    assert got == [(1, 1), (1, 2), (2, 1), *[(3, k) for k in range(1, 6)]]
    hits = spark.createDataFrame([(1, 1, 1, "a", "t"), (1, 1, 2, "b", "t"), (1, 2, 1, "b", "t"), (1, 2, 2, "c", "t")], "question int, round int, rank int, doc_id string, text string")
    assert ranked(rt.pool(hits), "doc_id") == ["a", "b", "c"]


def test_passage_texts(spark):
    hits = spark.createDataFrame([(1, 2, "T", "", "two"), (1, 1, "T", "S", "one")], "query_id int, rank int, title string, section string, text string")
    got = dict(map(tuple, rt.format_passages(spark.createDataFrame([(1,), (2,)], "query_id int"), hits).collect()))
    assert got == {1: "[1] (T - S)\none\n\n[2] (T)\ntwo", 2: "No relevant passages found."}


def test_metrics_by_hand(spark):
    text = "the evidence is here in the passage text"
    hits = spark.createDataFrame([(1, 1, "X", "no"), (1, 2, "S", "no match"), (1, 3, "S", text)], "question_id int, rank int, doc_id string, text string")
    questions = spark.createDataFrame([(1, "S", text), (2, "S", text)], "question_id int, source_doc_id string, evidence string")
    gold = spark.createDataFrame([(1, "S", "no match")], "question_id int, doc_id string, text string")
    flagged = ev.flags(hits, questions, gold).select("question_id", "rank", "article", "evidence", "answer")
    got = {(r.question_id, r.level): r for r in ev.scores(flagged, questions).collect()}
    assert got[1, "article"].mrr == 0.5 and got[1, "evidence"].mrr == pytest.approx(1 / 3) and got[1, "answer"].mrr == 0.5
    assert got[1, "article"].ndcg_at_k == pytest.approx((1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert got[2, "article"].hit_at_k == 0 and (2, "answer") not in got


def test_bootstrap(spark):
    """Near a plain bootstrap, and the same however the rows are dealt."""
    rng = np.random.default_rng(1)
    d = [*rng.choice([-1.0, 0.0, 1.0], 300, p=[0.2, 0.3, 0.5]).tolist()]
    rows = [("a", 0.0, x) for x in d] + [("b", 1.0, 1.0 + x / 7) for x in d[:60]] + [("a", None, 1.0), (None, 0.0, 2.0)]
    pairs = spark.createDataFrame(rows, "cfg string, before double, after double")
    got = {r.cfg: r for r in ev.paired_difference(pairs.repartition(5), ["cfg"]).collect()}
    again = {r.cfg: r for r in ev.paired_difference(pairs.coalesce(1), ["cfg"]).collect()}
    for cfg, own in (("a", np.array(d)), ("b", np.array(d[:60]) / 7)):
        plain = np.sort(own[rng.integers(0, len(own), (4_000, len(own)))].mean(axis=1))
        r, error = got[cfg], own.std() / np.sqrt(len(own))
        assert r.diff == pytest.approx(own.mean()) and (r.gained, r.lost) == ((own > 0).sum(), (own < 0).sum())
        assert abs(r.ci_low - plain[100]) < 0.3 * error and abs(r.ci_high - plain[3_899]) < 0.3 * error
        assert (again[cfg].ci_low, again[cfg].ci_high) == (pytest.approx(r.ci_low), pytest.approx(r.ci_high))
    assert (got[None].ci_low, got[None].diff, got[None].ci_high) == (2, 2, 2)


def words_of(rng, n):
    return " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 400))


@pytest.mark.parametrize("size", [1_024, 5])
def test_stored_search_equals_search(spark, size):
    rng = np.random.default_rng(4)
    texts = [words_of(rng, int(rng.integers(1, 80))) for _ in range(400)] + ["", None, "w1 " * 500, "w1 " * 500]
    passages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, chunk_index int, text string")
    queries = spark.createDataFrame([(i, words_of(rng, 4)) for i in range(30)] + [(90, "unknown"), (91, ""), (92, "w1 w1 w2")], "query_id int, query string")
    blocks = lx.lexical_blocks(passages, ["doc_id", "chunk_index"], size)
    assert blocks.selectExpr("max(n)").first()[0] < 4 * size + 50
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_index, round(r.score, 6)) for r in df.collect())
    assert rows(lx.block_search(blocks, queries, ["doc_id", "chunk_index"], 5)) == rows(lx.bm25_search(passages, queries, ["doc_id", "chunk_index"], 5))


def test_stored_search_leaves_blocks_out(spark, tmp_path):
    """A word that 20,000 passages hold once and a few hold often: only the few are read."""
    many = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.when(F.col("id") % 1_000 == 7, F.repeat(F.lit("oct "), 30)).otherwise(F.lit("oct " + "fill " * 20)).alias("text"))
    lx.lexical_blocks(many, ["doc_id", "chunk_index"]).write.parquet(str(tmp_path / "b"))
    blocks, queries = spark.read.parquet(str(tmp_path / "b")), spark.createDataFrame([(1, "oct")], "query_id int, query string")
    hits = lx.block_search(blocks, queries, ["doc_id", "chunk_index"], 5).collect()
    assert [r.chunk_index for r in sorted(hits, key=lambda r: r["rank"])] == [7, 1007, 2007, 3007, 4007]
    read = lx.needed_blocks(blocks, queries, ["doc_id", "chunk_index"], 5).selectExpr("sum(n)").first()[0]
    assert read < 100 and blocks.filter("term = 'oct'").selectExpr("sum(n)").first()[0] == 20_000


def test_grid_and_index_table(spark, tmp_path, passages):
    pairs = spark.createDataFrame([(s, e) for s in "abc" for e in "xyz"], "strategy string, embedder string")
    grid = ix.configuration_grid(pairs, rt.MODES, ("none", "gte", "ms-marco"))
    assert grid.count() == 63 and grid.select("run_name").distinct().count() == 63
    path, rows = str(tmp_path / "index"), passages.select("doc_id", F.col("passage_id").cast("int").alias("chunk_index"), "text")
    assert ix.embed_missing(rows, embedder(), path, "m/1") == 4
    assert ix.embed_missing(rows, embedder(), path, "m/1") == 0
    assert ix.embed_missing(rows, embedder(), path, "n") == 4 and ix.embed_missing(rows.limit(2), embedder(), path, "n", "fixed") == 2
    with pytest.raises(ValueError):
        ix.embed_missing(rows.limit(2), embedder(), path, "m/1")
    stamps = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "index/passages").rglob("*.parquet")}
    before = stamps()
    assert ix.embed_missing(rows.limit(3), embedder(), path, "n", "fixed", replace=True) == 3
    kept = {f for f in before if "strategy=fixed" not in str(f)}
    assert {f: t for f, t in stamps().items() if f in kept} == {f: before[f] for f in kept}
    got = sorted(map(tuple, ix.whole_indexes(spark, path).collect()))
    assert got == [("fixed", "n", 3), ("section", "m/1", 4), ("section", "n", 4)]
    plan = ix.read_index(spark, path, "section", "n")._jdf.queryExecution().executedPlan().toString()
    assert "strategy" in plan.split("PartitionFilters: ")[1].split("DataFilters")[0].split("PushedFilters")[0] and ix.read_index(spark, path, "section", "n").count() == 4
    ix.copy_index(spark, path, str(tmp_path / "copy"))
    assert ix.read_index(spark, str(tmp_path / "copy"), "section", "m/1").count() == 4
    assert spark.read.parquet(str(tmp_path / "copy/postings/strategy=section")).selectExpr("sum(n)").first()[0] == 5
    (m,) = ix.manifest(ix.read_index(spark, path, "section", "n"), "n", chunk_strategy="section").collect()
    assert (m.dim, m.n_chunks, m.extras) == (64, 4, {"chunk_strategy": "section"})


def test_a_broken_index_build_goes_on(spark, tmp_path, passages):
    path, rows = str(tmp_path / "index"), passages.select("doc_id", F.col("passage_id").cast("int").alias("chunk_index"), "text")
    ix.embed_missing(rows, embedder(), path, "m")
    whole = ix.read_index(spark, path).collect()
    half = sorted((tmp_path / "index/passages").rglob("*.parquet"))[0]
    half.unlink()
    assert ix.embed_missing(rows, embedder(), path, "m") > 0
    assert sorted(map(tuple, ix.read_index(spark, path).collect())) == sorted(map(tuple, whole))


def test_cached_passages(spark, tmp_path):
    a = spark.createDataFrame([("d", 0, "t")], "doc_id string, chunk_index int, text string")
    made = ix.cached_passages(spark, str(tmp_path / "c"), "section", lambda: a)
    again = ix.cached_passages(spark, str(tmp_path / "c"), "section", lambda: a.limit(0))
    assert made.collect() == again.collect() and again.first().strategy == "section"
    ix.write_passages(a.withColumn("strategy", F.lit("fixed")), str(tmp_path / "w"))
    assert (tmp_path / "w/strategy=fixed").exists()


def test_holders_of_short_and_long_texts(spark):
    from lectern.plans import views

    texts = ["one two three", "xone twoy and more one  two", "a", "", "  ", "tab\there", "ünïcode wörds", None, "three"] + [f"bulk{i} word{i % 7}" for i in range(500)]
    asked = ["one two", "one two three", "o", "", " ", "\t", "here", "wö", "ord5", "missing here", "  two", "two ", "hre", *(f"ulk{i}" for i in range(1_500)), None]
    items = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted(map(tuple, views.holders(items, docs).collect()))
    assert got == sorted((q, d) for q, a in enumerate(asked) for d, t in enumerate(texts) if a is not None and t is not None and a in t)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_dense_search_moves_rows_only_for_many_queries(spark, sent):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "item_id bigint, embedding array<double>")
    asked = rows.filter("item_id % 9 = 0").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = rt.vector_search(rows, asked, 4, sent_bytes=sent, without_self=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("FlatMapCoGroups" in plan) == (sent == 0) and plan.count("Exchange hash") == (1 if sent else 3)
    x = {r.item_id: np.array(r.embedding) for r in rows.collect()}
    want = [(q, i) for q in sorted(x) if q % 9 == 0 for i in sorted((i for i in x if i != q), key=lambda i: (-round(float(x[q] @ x[i]), 6), i))[:4]]
    assert [(r.query_id, r.item) for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"]))] == want
