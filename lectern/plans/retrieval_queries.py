"""Index tables, searches of all queries at once and their evaluation over the given tables (X, R and E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.plugins import embedder, overlap_logit
from lectern.operators import evaluation as ev
from lectern.operators import lexical as lx
from lectern.operators import questions as qs
from lectern.operators import retrieval as rt
from lectern.operators.durable import durable, stored
from lectern.operators.sizes import hinted, small
from lectern.plans import views as v
from lectern.plans.book import Book

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL
KEYS = ["doc_id", "chunk_index"]
P = "WITH RECURSIVE " + v.PASSAGES


def sql_postings(source: str, keys: str) -> str:
    return f"""tok AS MATERIALIZED (SELECT {keys}, {v.sql_tokens('text')} AS t FROM {source}),
size AS (SELECT avg(len(t)) AS avgdl, count(*) AS n FROM tok),
tf AS MATERIALIZED (SELECT {keys}, term, count(*) AS tf, max(dl) AS dl FROM (SELECT {keys}, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
post AS MATERIALIZED (SELECT {keys}, term, tf, dl, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight FROM tf, size),
df AS MATERIALIZED (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, size GROUP BY term)"""


def sql_bm25(queries: str, keys: str, k: int, name: str = "hits") -> str:
    return f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({v.sql_tokens('query')}) AS term FROM {queries}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {keys})::INT AS rank FROM (
  SELECT query_id, {keys}, round(sum(qtf * idf * weight), 9) AS score FROM qt JOIN df USING (term) JOIN post USING (term) GROUP BY query_id, {keys})) WHERE rank <= {k})"""


POSTINGS = f"{P}, {sql_postings('passages', 'doc_id, chunk_index')}"
HITS = f"{POSTINGS}, {v.QUESTIONS}, asked AS (SELECT question_id AS query_id, question AS query FROM questions), {sql_bm25('asked', 'doc_id, chunk_index', 5)}"


def _asked(spark, sf):
    return v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hits(spark, sf, k=5, passages=None):
    """Hits of the benchmark items with passage texts."""
    p = v.stored_passages(spark, sf) if passages is None else passages
    asked = _asked(spark, sf)
    found = hinted(lx.bm25_search(p, asked, KEYS, k), k * asked.count())
    return p.join(found, KEYS)


@book.add("x1_passage_labels", f"{P} SELECT doc_id, chunk_index, md5(CASE WHEN chunk_index % 2 = 0 THEN 'title: ' || section || ' | text: ' || text ELSE text END) AS label_md5 FROM passages")
def _(spark, sf):
    model = F.when(F.col("chunk_index") % 2 == 0, lx.LABELLED_MODEL).otherwise("all-MiniLM-L6-v2")
    return v.passages(spark, sf).select(*KEYS, F.md5(lx.passage_text(model, F.col("section"), F.col("text"))).alias("label_md5"))


@book.add("x2_embed", f"{P}, {v.POLY}, {v.sql_vectors('vectors', 'passages', 'doc_id, chunk_index', 'text')} SELECT doc_id, chunk_index, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '+' WHEN x < 0 THEN '-' ELSE '0' END), '') AS signs FROM vectors")
def _(spark, sf):
    sign = lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")
    return v.passages(spark, sf).select(*KEYS, F.array_join(F.transform(embedder()(F.col("text")), sign), "").alias("signs"))


@book.add("x3_normalise", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def _(spark, sf):
    e = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return v.table(spark, sf, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.round(rt.normalise(e)[0], 6).alias("first"))


@book.add("x4_tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS all_md5 FROM (SELECT doc_id, {v.sql_tokens('text')} AS t FROM documents)")
def _(spark, sf):
    t = tx.tokens(F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(t, " ")).alias("all_md5"))


@book.add("x5_postings", f"{POSTINGS} SELECT doc_id, chunk_index, term, tf, round(weight, 6) AS weight FROM post")
def _(spark, sf):
    return lx.postings(v.stored_passages(spark, sf), KEYS).select(*KEYS, "term", F.col("tf").cast("bigint").alias("tf"), F.round("weight", 6).alias("weight"))


@book.add("x6_sparse_vectors", f"{POSTINGS} SELECT doc_id, chunk_index, count(*) AS n_ids, round(sum(weight), 6) AS total FROM post GROUP BY 1, 2")
def _(spark, sf):
    ids = lx.sparse_vectors(lx.postings(v.stored_passages(spark, sf), KEYS), KEYS)
    return ids.groupBy(*KEYS).agg(F.count("*").alias("n_ids"), F.round(F.sum("weight"), 6).alias("total"))


@book.add("x7_query_terms", f"SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({v.sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL")
def _(spark, sf):
    return lx.query_terms(_asked(spark, sf), "query_id", "query")


@book.add("x8_idf", f"{POSTINGS}, raw AS MATERIALIZED (SELECT term, df, idf, ln((n - df + 0.5) / (df + 0.5)) AS r FROM df, size) SELECT term, df, round(idf, 6) AS idf, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS okapi FROM raw")
def _(spark, sf):
    p = v.stored_passages(spark, sf)
    df = durable(lx.document_frequencies(p).crossJoin(F.broadcast(lx.mean_length(p))))
    plain = lx.idf(df, F.col("n_passages")).select("term", "df", F.round("idf", 6).alias("idf"))
    return plain.join(lx.idf(df, F.col("n_passages"), okapi=True).select("term", F.round("idf", 6).alias("okapi")), "term")


@book.add("x9_mean_length", f"{POSTINGS} SELECT round(avgdl, 6) AS avgdl, n AS n_passages FROM size")
def _(spark, sf):
    return lx.mean_length(v.passages(spark, sf)).select(F.round("avgdl", 6).alias("avgdl"), "n_passages")


@book.add("x10_manifest", "SELECT 'given' AS model_name, max(len(embedding))::INT AS dim, count(*) AS n_chunks, 'fixed' AS chunk_strategy FROM embeddings")
def _(spark, sf):
    from lectern.sources.index_store import manifest

    made = manifest(v.table(spark, sf, "embeddings"), "given", chunk_strategy="fixed")
    return made.select("model_name", "dim", "n_chunks", F.col("extras")["chunk_strategy"].alias("chunk_strategy"))


@book.add("x11_resume", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf):
    from lectern.sources.index_store import missing

    done = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return missing(v.table(spark, sf, "documents").select("doc_id", "lang"), done, ["doc_id"])


@book.add("x12_complete", "WITH m AS (SELECT label, count(*) + (label % 2) AS n_chunks FROM embeddings GROUP BY label), c AS (SELECT label, count(*) AS stored FROM embeddings GROUP BY label) SELECT c.label, stored FROM c JOIN m USING (label) WHERE stored = n_chunks")
def _(spark, sf):
    from lectern.sources.index_store import complete

    stored = v.table(spark, sf, "embeddings").withColumnRenamed("label", "name")
    manifest = stored.groupBy("name").agg(F.count("*").alias("n")).select("name", (F.col("n") + F.col("name") % 2).alias("n_chunks"))
    return complete(stored, manifest).withColumnRenamed("name", "label")


@book.add("x13_build_grid", "SELECT s.strategy, n.n_name AS model FROM (VALUES ('fixed'), ('section'), ('semantic')) s(strategy), nation n WHERE NOT EXISTS (SELECT 1 FROM region r WHERE r.r_regionkey = n.n_regionkey AND s.strategy = 'fixed' AND r.r_regionkey < 2)")
def _(spark, sf):
    from lectern.sources.index_store import to_build

    models = v.table(spark, sf, "nation")
    built = models.filter("n_regionkey < 2").select(F.lit("fixed").alias("strategy"), F.col("n_name").alias("model"))
    return to_build(("fixed", "section", "semantic"), models.select(F.col("n_name").alias("model")), built)


NEAR = """near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10)"""


def _near(spark, sf, k=10):
    e = v.table(spark, sf, "embeddings")
    return rt.vector_search(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k, "vec_id", without_self=True)


@book.add("r1_vector_search", f"WITH {NEAR} SELECT query_id, item, score, rank FROM near")
def _(spark, sf):
    return _near(spark, sf)


@book.add("r2_bm25_search", f"{HITS} SELECT query_id, doc_id, chunk_index, round(score, 6) AS score, rank FROM hits")
def _(spark, sf):
    return lx.bm25_search(v.stored_passages(spark, sf), _asked(spark, sf), KEYS, 5).withColumn("score", F.round("score", 6))


@book.add("r2_stored_search", f"{HITS} SELECT query_id, doc_id, chunk_index, round(score, 6) AS score, rank FROM hits")
def _(spark, sf):
    """The same hits from an index of postings in blocks, written and read again."""
    path = v.folder(spark, "postings")
    lx.lexical_blocks(v.stored_passages(spark, sf), KEYS).write.parquet(path)
    return lx.block_search(spark.read.parquet(path), _asked(spark, sf), KEYS, 5).withColumn("score", F.round("score", 6))


CARDS = f"cards AS MATERIALIZED (SELECT doc_id AS passage_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id), asked AS MATERIALIZED (SELECT passage_id AS query_id, array_to_string({v.sql_tokens('text')}, ' ') AS query, embedding FROM cards WHERE passage_id % 50 = 0)"
FUSED = f"""WITH {CARDS}, {sql_postings('cards', 'passage_id')}, {sql_bm25('asked', 'passage_id', 50, 'words')},
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (
  SELECT q.query_id, c.passage_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM asked q, cards c)) WHERE rank <= 50),
fused AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, a NULLS LAST, b NULLS LAST)::INT AS rank FROM (
  SELECT query_id, passage_id, n.rank AS a, w.rank AS b, coalesce(1.0 / (60 + n.rank), 0) + coalesce(1.0 / (60 + w.rank), 0) AS score FROM near n FULL JOIN words w USING (query_id, passage_id))) WHERE rank <= 50)"""


#: Ids that are sent to every executor; a long each.
SENT_IDS = 1_000_000


def _cards(spark, sf):
    """Documents with an embedding, written once, as searches read them several times; texts without one are not moved."""
    e = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("passage_id"), "embedding")
    texts = v.table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    cards = stored(texts.join(small(e.select("passage_id"), SENT_IDS), "passage_id", "left_semi").join(e, "passage_id"), "cards")
    asked = cards.filter("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), F.array_join(tx.tokens(F.col("text")), " ").alias("query"), F.col("embedding").alias("vector"))
    return cards, asked


@book.add("r4_hybrid_search", f"{FUSED} SELECT query_id, passage_id, round(score, 6) AS score, rank FROM fused")
def _(spark, sf):
    cards, asked = _cards(spark, sf)
    return rt.retrieve(cards, asked, "hybrid").withColumn("score", F.round("score", 6))


@book.add("r3_rrf", f"WITH {NEAR}, back AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY item) AS rank FROM near) SELECT query_id, item, rank FROM (SELECT n.query_id, n.item, row_number() OVER (PARTITION BY n.query_id ORDER BY round(1.0 / (60 + n.rank) + 1.0 / (60 + b.rank), 9) DESC, n.rank, b.rank)::INT AS rank FROM near n JOIN back b USING (query_id, item)) WHERE rank <= 5")
def _(spark, sf):
    near = _near(spark, sf)
    back = lx.top_k(near.drop("rank"), 10, "query_id", [F.col("item")])
    return rt.rrf(near, back, ["item"], 5).select("query_id", "item", "rank")


@book.add("r5_retrieve_bm25", f"{FUSED} SELECT query_id, passage_id, round(score, 6) AS score, rank FROM words WHERE rank <= 10")
def _(spark, sf):
    cards, asked = _cards(spark, sf)
    return rt.retrieve(cards, asked, "bm25", 10).withColumn("score", F.round("score", 6))


@book.add("r6_top_n", "SELECT user_id, event_id, value, rank FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 3")
def _(spark, sf):
    return lx.top_k(v.table(spark, sf, "events").select("user_id", "event_id", "value"), 3, "user_id", [F.desc("value"), F.col("event_id")])


SCORED = f"(2 * len(list_intersect(list_distinct({v.sql_plain('query')}), {v.sql_plain('text')})) - len(list_distinct({v.sql_plain('query')}))) / 4.0"


@book.add("r7_rerank", f"{HITS} SELECT query_id, doc_id, chunk_index, round(1 / (1 + exp(-logit)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, rank)::INT AS rank FROM (SELECT h.*, {SCORED} AS logit FROM hits h JOIN passages USING (doc_id, chunk_index) JOIN asked USING (query_id))")
def _(spark, sf):
    hits = _hits(spark, sf).join(small(_asked(spark, sf)), "query_id")
    return rt.rerank(hits, overlap_logit(F.col("query"), F.col("text"))).select("query_id", *KEYS, F.round("score", 6).alias("score"), "rank")


@book.add("r8_search_once", f"{FUSED}, once AS (SELECT query_id, passage_id, logit, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, rank)::INT AS r FROM (SELECT f.query_id, f.passage_id, f.rank, {SCORED} AS logit FROM fused f JOIN cards USING (passage_id) JOIN asked USING (query_id))) SELECT query_id, passage_id, round(1 / (1 + exp(-logit)), 6) AS score, r AS rank FROM once WHERE r <= 5")
def _(spark, sf):
    cards, asked = _cards(spark, sf)
    n = asked.count()
    found = rt.retrieve(cards, asked, "hybrid").join(hinted(asked.select("query_id", "query"), n), "query_id")
    hits = cards.select("passage_id", "text").join(hinted(found, n * rt.CANDIDATES), "passage_id")
    return rt.rerank(hits, overlap_logit(F.col("query"), F.col("text")), 5).select("query_id", "passage_id", F.round("score", 6).alias("score"), "rank")


ROUNDS = """rounds AS (SELECT conv_id AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS round, text AS query FROM conversations WHERE role = 'user'),
run AS (SELECT * FROM (SELECT *, max(stop) OVER (PARTITION BY question ORDER BY round) AS stopped FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY question, lower(trim(query)) ORDER BY round) > 1 OR lower(trim(query)) = '' THEN 1 ELSE 0 END AS stop FROM rounds)) WHERE stopped = 0 AND round <= 5)"""


def _rounds(spark, sf):
    users = v.table(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("question"), "turn", F.col("text").alias("query"))
    return lx.top_k(users, 1 << 30, "question", [F.col("turn")]).withColumnRenamed("rank", "round").drop("turn")


@book.add("r9_pooled_rounds", f"WITH {ROUNDS} SELECT question, round, md5(query) AS query_md5 FROM run")
def _(spark, sf):
    return rt.pooled(_rounds(spark, sf)).select("question", "round", F.md5("query").alias("query_md5"))


@book.add("r10_passage_texts", f"{HITS}, given AS (SELECT query_id, string_agg('[' || rank || '] (' || section || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t FROM hits JOIN passages USING (doc_id, chunk_index) GROUP BY 1) SELECT query_id, md5(coalesce(t, 'No relevant passages found.')) AS passages_md5 FROM asked LEFT JOIN given USING (query_id)")
def _(spark, sf):
    hits = _hits(spark, sf).withColumn("title", F.col("section")).withColumn("section", F.lit(""))
    return rt.format_passages(_asked(spark, sf), hits).select("query_id", F.md5("passages").alias("passages_md5"))


@book.add("r11_sources", f"{HITS} SELECT query_id, rank, h.doc_id, section, license, doi FROM hits h JOIN passages USING (doc_id, chunk_index) JOIN articles ON pmcid = h.doc_id")
def _(spark, sf):
    nested = _hits(spark, sf).select("query_id", "rank", F.struct("doc_id", "section", "license", "doi").alias("metadata"))
    return nested.select("query_id", "rank", "metadata.*")


@book.add("r12_source_summary", f"WITH {NEAR} SELECT query_id, count(*) AS passages, count(DISTINCT item // 5) AS articles, round(100 * max(score))::INT AS best_percent, CASE WHEN max(score) >= 0.8 THEN 'high' WHEN max(score) >= 0.5 THEN 'mid' ELSE 'low' END AS band FROM near GROUP BY 1")
def _(spark, sf):
    return rt.source_summary(_near(spark, sf).withColumn("doc_id", F.floor(F.col("item") / 5)))


@book.add("e1_shingles", f"SELECT item_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS all_md5 FROM (SELECT item_id, {v.sql_shingles('text')} AS s FROM benchmark)")
def _(spark, sf):
    s = tx.shingles(F.col("text"))
    return v.table(spark, sf, "benchmark").select("item_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort(s), "|")).alias("all_md5"))


SHARE = f"len(list_intersect({v.sql_shingles('p.text')}, {v.sql_shingles('q.question')})) / least(len({v.sql_shingles('p.text')}), len({v.sql_shingles('q.question')}))"
NORM = r"regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
#: Passages of a question's article that hold a sentence of it whole, else at least half of its shingles, else any.
GOLD = f"""each AS (SELECT question_id, source_doc_id AS doc_id, i AS no, {v.sql_sentences('question')}[i] AS sentence FROM questions, LATERAL unnest(range(1, len({v.sql_sentences('question')}) + 1)) t(i) WHERE source_doc_id IS NOT NULL),
held AS (SELECT question_id, no, doc_id, chunk_index, text, contains({NORM.format('text')}, {NORM.format('sentence')}) AS whole, len(list_intersect({v.sql_shingles('sentence')}, {v.sql_shingles('text')})) / len({v.sql_shingles('sentence')}) AS share FROM each JOIN passages USING (doc_id)),
marked AS (SELECT *, bool_or(whole) OVER (PARTITION BY question_id, no) AS any_whole, bool_or(share >= 0.5 OR whole) OVER (PARTITION BY question_id, no) AS any_half FROM held WHERE whole OR share > 0),
mapped AS MATERIALIZED (SELECT DISTINCT question_id, doc_id, chunk_index, text, CASE WHEN bool_and(any_whole) OVER (PARTITION BY question_id) THEN 'exact' ELSE 'split' END AS match, CASE WHEN any_whole THEN whole WHEN any_half THEN share >= 0.5 ELSE true END AS ok FROM marked),
gold AS MATERIALIZED (SELECT DISTINCT question_id, doc_id, chunk_index, text, match FROM mapped WHERE ok)"""
FLAGS = f"""{HITS}, {GOLD},
flags AS MATERIALIZED (SELECT question_id, rank, p.doc_id = coalesce(source_doc_id, '') AS article, p.doc_id = coalesce(source_doc_id, '') AND {SHARE} >= 0.5 AS evidence,
  CASE WHEN question_id IN (SELECT question_id FROM gold) THEN (question_id, p.doc_id, p.text) IN (SELECT question_id, doc_id, text FROM gold) END AS answer
  FROM hits h JOIN passages p USING (doc_id, chunk_index) JOIN questions q ON q.question_id = h.query_id)"""
LONG = "SELECT question_id, rank, 'article' AS level, article::INT AS r FROM flags UNION ALL SELECT question_id, rank, 'evidence', evidence::INT FROM flags UNION ALL SELECT question_id, rank, 'answer', answer::INT FROM flags WHERE answer IS NOT NULL"
SCORES = f"""{FLAGS}, long AS ({LONG}), got AS (SELECT question_id, level, max(CASE WHEN r = 1 AND rank = 1 THEN 1 ELSE 0 END)::DOUBLE AS hit_at_1, max(r)::DOUBLE AS hit_at_k, coalesce(max(CASE WHEN r = 1 THEN 1.0::DOUBLE / rank END), 0) AS mrr,
  CASE WHEN sum(r) > 0 THEN round(sum(r / log2(rank + 1)) / list_sum(list_transform(range(1, sum(r)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) ELSE 0 END AS ndcg_at_k FROM long GROUP BY 1, 2),
every AS (SELECT question_id, level FROM questions, (VALUES ('article'), ('evidence')) t(level) UNION ALL SELECT question_id, level FROM got WHERE level = 'answer'),
scores AS (SELECT question_id, level, coalesce(hit_at_1, 0)::DOUBLE AS hit_at_1, coalesce(hit_at_k, 0) AS hit_at_k, coalesce(mrr, 0) AS mrr, coalesce(ndcg_at_k, 0) AS ndcg_at_k FROM every LEFT JOIN got USING (question_id, level))"""


def gold(questions, passages):
    """question_id, doc_id, chunk_index, text and match of the passages that hold the sentences of a question."""
    asked = questions.filter("source_doc_id is not null").select("question_id", "source_doc_id", tx.sentences(F.col("question")).alias("sentences"))
    mapped = qs.gold_chunks(asked, passages.withColumn("strategy", F.lit("section"))).join(asked.select("question_id", F.col("source_doc_id").alias("doc_id")), "question_id")
    return passages.select(*KEYS, "text").join(small(mapped.select("question_id", "match", *KEYS)), KEYS)


def _flags(spark, sf):
    """Questions, and their hits with flags. Passages and questions are made once."""
    passages, questions = v.stored_passages(spark, sf), v.questions(spark, sf).withColumn("evidence", F.col("question"))
    n = questions.count()
    hits = durable(_hits(spark, sf, passages=passages).withColumnRenamed("query_id", "question_id"))
    flagged = ev.flags(hits, hinted(questions, n), gold(questions, passages))
    return questions, flagged.select("question_id", "rank", "article", "evidence", "answer")


def _scores(spark, sf):
    questions, flagged = _flags(spark, sf)
    return questions, ev.scores(durable(flagged), questions.select("question_id"))


@book.add("e2_evidence", f"{HITS} SELECT q.question_id, p.doc_id, p.chunk_index, {SHARE} >= 0.5 AS is_evidence FROM hits h JOIN passages p USING (doc_id, chunk_index) JOIN questions q ON q.question_id = h.query_id")
def _(spark, sf):
    q = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return _hits(spark, sf).join(small(q), "query_id").select(F.col("query_id").alias("question_id"), *KEYS, ev.is_evidence(F.col("text"), F.col("question")).alias("is_evidence"))


@book.add("e3_flags", f"{FLAGS} SELECT question_id, rank, article::INT AS article, evidence::INT AS evidence, answer::INT AS answer FROM flags")
def _(spark, sf):
    return _flags(spark, sf)[1]


@book.add("e4_vector_metrics", f"""WITH {NEAR}, r AS (SELECT n.query_id, n.rank, (a.label = b.label)::INT AS r FROM near n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.item)
SELECT query_id, max(CASE WHEN r = 1 AND rank = 1 THEN 1 ELSE 0 END)::DOUBLE AS hit_at_1, max(r)::DOUBLE AS hit_at_k, coalesce(max(CASE WHEN r = 1 THEN 1.0::DOUBLE / rank END), 0) AS mrr,
  CASE WHEN sum(r) > 0 THEN round(sum(r / log2(rank + 1)) / list_sum(list_transform(range(1, sum(r)::BIGINT + 1), lambda i: 1 / log2(i + 1))), 6) ELSE 0 END AS ndcg_at_k FROM r WHERE rank <= 5 GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    e = v.table(spark, sf, "embeddings")
    hits = _near(spark, sf).join(e.select(F.col("vec_id").alias("item"), F.col("label").alias("found")), "item").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return ev.metrics(hits.withColumn("relevant", (F.col("found") == F.col("label")).cast("int")), 5, ["query_id"])


@book.add("e5_scores", f"{SCORES} SELECT * FROM scores")
def _(spark, sf):
    return _scores(spark, sf)[1]


@book.add("e6_means", f"""{SCORES}, j AS (SELECT s.*, category, subspecialty FROM scores s JOIN questions USING (question_id))
SELECT level, category, subspecialty, round(avg(hit_at_k), 6) AS hit_at_k, round(avg(mrr), 6) AS mrr, count(*) AS n FROM j GROUP BY GROUPING SETS ((level), (level, category), (level, subspecialty))""")  # fmt: skip
def _(spark, sf):
    questions, scores = _scores(spark, sf)
    j = scores.join(questions.select("question_id", "category", "subspecialty"), "question_id")
    return ev.configuration_means(j, ["level"], ["hit_at_k", "mrr"], ["category", "subspecialty"])


@book.add("entry_bm25_quality", f"{SCORES} SELECT level, round(avg(hit_at_k), 6) AS hit_at_5, round(avg(mrr), 6) AS mrr, count(*) AS questions FROM scores GROUP BY 1")
def _(spark, sf):
    return _scores(spark, sf)[1].groupBy("level").agg(F.round(F.avg("hit_at_k"), 6).alias("hit_at_5"), F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("questions"))


@book.add("e7_grid", """WITH c AS (SELECT DISTINCT p_brand AS strategy, p_type AS embedder FROM part), g AS (
  SELECT strategy, CASE WHEN mode = 'bm25' THEN 'none' ELSE embedder END AS embedder, mode, reranker FROM c, (VALUES ('vector'), ('bm25'), ('hybrid')) m(mode), (VALUES ('none'), ('gte'), ('ms-marco')) r(reranker))
SELECT DISTINCT strategy, embedder, mode, reranker, strategy || ' | ' || embedder || ' | ' || mode || ' | ' || reranker AS run_name FROM g""")  # fmt: skip
def _(spark, sf):
    from lectern.sources.index_store import configuration_grid

    pairs = v.table(spark, sf, "part").select(F.col("p_brand").alias("strategy"), F.col("p_type").alias("embedder")).distinct()
    return configuration_grid(pairs, rt.MODES, ("none", "gte", "ms-marco"))


@book.add("e8_chunk_lookup", f"{HITS} SELECT query_id, rank, coalesce(p2.chunk_index::VARCHAR, '?') AS found FROM hits h JOIN passages p USING (doc_id, chunk_index) LEFT JOIN (SELECT doc_id, text, min(chunk_index) AS chunk_index FROM passages WHERE chunk_index % 2 = 0 GROUP BY 1, 2) p2 ON p2.doc_id = p.doc_id AND p2.text = p.text")
def _(spark, sf):
    passages = v.stored_passages(spark, sf)
    hits = durable(_hits(spark, sf, passages=passages))
    there = passages.filter("chunk_index % 2 = 0").join(small(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    stored = there.groupBy("doc_id", "text").agg(F.min("chunk_index").alias("id"))
    return hits.join(stored, ["doc_id", "text"], "left").select("query_id", "rank", F.coalesce(F.col("id").cast("string"), F.lit("?")).alias("found"))


@book.add("e9_parity", f"""WITH {NEAR}, a AS (SELECT query_id, item, rank FROM near WHERE rank <= 5), b AS (SELECT query_id, item, rank - 1 AS rank FROM near WHERE rank BETWEEN 2 AND 6)
SELECT query_id, count(a.rank) AS n_a, count(b.rank) AS n_b, sum(CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS shared, max(CASE WHEN a.rank = 1 AND b.rank = 1 THEN 1 ELSE 0 END) AS same_first FROM a FULL JOIN b USING (query_id, item) GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    near = _near(spark, sf)
    a = near.filter("rank <= 5").select("query_id", "item", F.col("rank").alias("a"))
    b = near.filter("rank between 2 and 6").select("query_id", "item", (F.col("rank") - 1).alias("b"))
    both = a.join(b, ["query_id", "item"], "full")
    held = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.groupBy("query_id").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(held).alias("shared"), F.max(F.when((F.col("a") == 1) & (F.col("b") == 1), 1).otherwise(0)).alias("same_first"))


PAIRS = "SELECT source, quality::DOUBLE AS before, (CASE WHEN l.doc_id % 3 = 0 THEN 1 - quality ELSE quality END)::DOUBLE AS after FROM labels l JOIN documents d USING (doc_id)"


@book.add("e10_paired", f"SELECT source, round(avg(after - before), 6) AS diff, true AS low_in_place, true AS high_in_place, count(*) FILTER (after > before) AS gained, count(*) FILTER (after < before) AS lost FROM ({PAIRS}) GROUP BY 1")
def _(spark, sf):
    """The ends of the interval are held against those of a normal distribution with the same mean and deviation: within a fifth of its width, or loosely for few questions."""
    q = F.col("quality").cast("double")
    pairs = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("source", q.alias("before"), F.when(F.col("doc_id") % 3 == 0, 1 - q).otherwise(q).alias("after"))
    error = pairs.groupBy("source").agg((F.stddev_pop(F.col("after") - F.col("before")) / F.sqrt(F.count("*"))).alias("error"), F.when(F.count("*") >= 100, 0.8).otherwise(3.0).alias("most"))
    told = ev.paired_difference(pairs, ["source"]).join(error, "source")
    near = lambda end, side: F.abs(F.col(end) - F.col("diff") - side * 1.96 * F.col("error")) <= F.col("most") * F.col("error") + 1e-9
    return told.select("source", F.round("diff", 6).alias("diff"), near("ci_low", -1).alias("low_in_place"), near("ci_high", 1).alias("high_in_place"), "gained", "lost")


@book.add("e11_pool_report", f"WITH {ROUNDS} SELECT question, count(DISTINCT query) AS searches, count(*) AS pool_size, max(CASE WHEN round = 2 THEN 1 ELSE 0 END) AS pool_hit FROM run GROUP BY 1")
def _(spark, sf):
    return rt.pooled(_rounds(spark, sf)).groupBy("question").agg(F.countDistinct("query").alias("searches"), F.count("*").alias("pool_size"), F.max(F.when(F.col("round") == 2, 1).otherwise(0)).alias("pool_hit"))


@book.add("e12_judged", "SELECT lang, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, sf):
    j = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"), F.count("*").alias("n"))


@book.add("e13_sweep_pivot", "SELECT lang, round(avg(quality) FILTER (toxic = 0), 4) AS clean, round(avg(quality) FILTER (toxic = 1), 4) AS toxic, min(quality) AS low, max(quality) AS high FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(spark, sf):
    j = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    ends = j.groupBy("lang").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    wide = j.groupBy("lang").pivot("toxic", [0, 1]).agg(F.round(F.avg("quality"), 4)).withColumnsRenamed({"0": "clean", "1": "toxic"})
    return wide.join(ends, "lang")
