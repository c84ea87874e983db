"""Sources, corpus building and chunking over the given tables (S, C and K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.plugins import embedder
from lectern.operators import chunking, corpus
from lectern.plans import views as v
from lectern.plans.book import Book
from lectern.sources import files, index_store

book = Book()
QUERIES, SQL = book.QUERIES, book.SQL
W = "WITH " + v.ARTICLES
R = "WITH RECURSIVE "
PERMITTED = "(upper(license) LIKE 'CC0%' OR upper(license) = 'PUBLIC-DOMAIN' OR (upper(license) LIKE 'CC %' AND upper(license) NOT LIKE '%ND%' AND upper(license) NOT LIKE '%NC%'))"


def sql_terms(source: str) -> str:
    return f"terms AS (SELECT doc_id, chunk_index, len(list_distinct({v.sql_tokens('text')})) AS n_terms FROM {source})"


@book.add("s1_load_articles", f"{W} SELECT pmcid, title, doi, license, journal, len(sections) AS n_sections, sections[1].heading AS first_heading, md5({v.FULL_TEXT}) AS text_md5 FROM articles")
def _(spark, sf):
    path = v.folder(spark, "articles")
    stored = v.articles(spark, sf).withColumn("sections", F.transform("sections", lambda s: F.array(s["heading"], s["text"])))
    stored.select(F.to_json(F.struct("pmcid", "title", "doi", "license", "journal", "sections")).alias("value")).write.text(path)
    a = files.load_corpus(spark, path)
    return a.select("pmcid", "title", "doi", "license", "journal", F.size("sections").cast("bigint").alias("n_sections"), F.col("sections")[0]["heading"].alias("first_heading"), F.md5(corpus.full_text(F.col("sections"))).alias("text_md5"))


@book.add("s2_save_corpus", f"{W} SELECT pmcid, title, doi, license, journal, len(sections) AS n_sections, md5({v.FULL_TEXT}) AS text_md5 FROM articles")
def _(spark, sf):
    path = v.folder(spark, "corpus")
    files.save_corpus(v.articles(spark, sf).drop("num"), path)
    a = files.load_corpus(spark, path)
    return a.select("pmcid", "title", "doi", "license", "journal", F.size("sections").cast("bigint").alias("n_sections"), F.md5(corpus.full_text(F.col("sections"))).alias("text_md5"))


@book.add("s3_repair_corpus", f"{W} SELECT pmcid, CASE WHEN num % 4 = 0 THEN 'second' ELSE title END AS title, len(sections) AS n_sections FROM articles WHERE num % 7 <> 0 OR num % 4 = 0")
def _(spark, sf):
    path = v.folder(spark, "damaged")
    stored = v.articles(spark, sf).withColumn("sections", F.transform("sections", lambda s: F.array(s["heading"], s["text"])))
    whole = F.to_json(F.struct("pmcid", "title", "doi", "license", "journal", "sections"))
    later = F.to_json(F.struct("pmcid", F.lit("second").alias("title"), "doi", "license", "journal", "sections"))
    first = F.when(F.col("num") % 7 == 0, F.substring(whole, 1, 20)).otherwise(whole)  # a line cut short
    lines = F.array_compact(F.array(first, F.when(F.col("num") % 4 == 0, later)))
    stored.select(F.explode(lines).alias("value")).write.text(path)
    return files.repair_corpus(spark, path).select("pmcid", "title", F.size("sections").cast("bigint").alias("n_sections"))


@book.add("s5_chunk_cache", f"{R}{v.PASSAGES} SELECT 'section' AS strategy, doc_id, chunk_index, section, text FROM passages")
def _(spark, sf):
    path = v.folder(spark, "passages")
    index_store.cached_passages(spark, path, "section", lambda: v.passages(spark, sf))
    again = index_store.cached_passages(spark, path, "section", lambda: v.passages(spark, sf).limit(0))
    return again.select("strategy", "doc_id", "chunk_index", "section", "text")


@book.add("s7_question_file", "SELECT item_id::VARCHAR AS id, text AS question, '' AS category, 0::BIGINT AS n_sentences, 0::BIGINT AS n_gold FROM benchmark")
def _(spark, sf):
    path = v.folder(spark, "questions")
    files.write_questions(v.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question")), path)
    q = files.read_questions(spark, path)
    return q.select("id", "question", "category", F.size("answer_sentences").cast("bigint").alias("n_sentences"), F.size("gold_chunks").cast("bigint").alias("n_gold"))


@book.add("s8_append_missing", "SELECT doc_id, lang, source, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'first' ELSE 'second' END AS run FROM documents d")
def _(spark, sf):
    """Labelled documents as the results of a first run; the second run adds those that are not there, and a third nothing."""
    path, docs = v.folder(spark, "results"), v.table(spark, sf, "documents").select("doc_id", "lang", "source")
    done = docs.join(v.table(spark, sf, "labels"), "doc_id", "left_semi")
    for run, rows in (("first", done), ("second", docs), ("third", docs)):
        index_store.append_missing(rows.withColumn("run", F.lit(run)), path, ["doc_id"])
    return spark.read.parquet(path)


@book.add("s9_split_rows", "SELECT l_returnflag || '-' || l_orderkey || '-' || l_linenumber AS name, l_returnflag AS class, l_orderkey::VARCHAR AS patient FROM lineitem WHERE l_linestatus = 'F'")
def _(spark, sf):
    path = v.folder(spark, "split")
    rows = v.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_orderkey", "l_linenumber").alias("name"), F.col("l_returnflag").alias("class"), F.col("l_orderkey").cast("string").alias("patient"), F.col("l_linestatus").alias("split"))
    files.write_split(rows, path)
    return files.read_split(spark, path, "F").select("name", "class", "patient")


@book.add("s12_evaluation_records", f"WITH {v.QUESTIONS} SELECT question_id, question AS asked, source_doc_id AS expected_doc, category AS tag_category, subspecialty AS tag_subspecialty FROM questions")
def _(spark, sf):
    nested = v.questions(spark, sf).select(
        "question_id",
        F.struct(F.col("question").alias("asked")).alias("inputs"),
        F.struct(F.col("source_doc_id").alias("expected_doc")).alias("expectations"),
        F.struct(F.col("category").alias("tag_category"), F.col("subspecialty").alias("tag_subspecialty")).alias("tags"),
    )
    return nested.select("question_id", "inputs.*", "expectations.*", "tags.*")


@book.add("s6_index_table", f"{R}{v.PASSAGES} SELECT doc_id, chunk_index, strategy, model, md5(CASE WHEN strategy = 'even' AND model = 'org/one' THEN 'again ' || text ELSE text END) AS text_md5 FROM passages, (VALUES ('org/one'), ('two')) m(model), (VALUES ('section'), ('even')) s(strategy) WHERE strategy = 'section' OR chunk_index % 2 = 0")
def _(spark, sf):
    """Two strategies and two models in one table; one index is replaced, the others are not touched."""
    path, passages = v.folder(spark, "index"), v.stored_passages(spark, sf)
    even = passages.filter("chunk_index % 2 = 0")
    for model in ("org/one", "two"):
        for strategy, rows in (("section", passages), ("even", even)):
            index_store.embed_missing(rows, embedder(), path, model, strategy)
    again = even.withColumn("text", F.concat(F.lit("again "), "text"))
    index_store.embed_missing(again, embedder(), path, "org/one", "even", replace=True)
    rows = index_store.read_index(spark, path).join(F.broadcast(index_store.whole_indexes(spark, path)), ["strategy", "model"], "left_semi")
    return rows.select("doc_id", "chunk_index", "strategy", "model", F.md5("text").alias("text_md5"))


@book.add("s10_listing", "SELECT DISTINCT 'kind=' || l_returnflag AS class FROM lineitem")
def _(spark, sf):
    """Folders of the files that a table divided by class is made of."""
    path = v.folder(spark, "scans")
    v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.concat_ws("-", "l_returnflag", "l_orderkey", "l_linenumber").alias("value")).write.partitionBy("kind").text(path)
    return files.list_scans(spark, path, "*.txt").select("class").distinct()


@book.add("s13_copy_index", f"{R}{v.PASSAGES}, {sql_terms('passages')} SELECT doc_id, chunk_index, section, text, true AS embedded, coalesce(n_terms, 0) AS n_terms FROM passages LEFT JOIN terms USING (doc_id, chunk_index)")
def _(spark, sf):
    source, target = v.folder(spark, "index"), v.folder(spark, "copy")
    index_store.embed_missing(v.stored_passages(spark, sf), embedder(), source, "hash")
    index_store.copy_index(spark, source, target)
    posted = spark.read.parquet(f"{target}/postings").select(F.explode("postings").alias("p")).groupBy("p.doc_id", "p.chunk_index").agg(F.count("*").alias("n_terms"))
    rows = index_store.read_index(spark, target, "section", "hash").join(posted, ["doc_id", "chunk_index"], "left")
    return rows.select("doc_id", "chunk_index", "section", "text", (F.size("embedding") > 0).alias("embedded"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


@book.add("c2_node_text", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([.,;:)])', '\1', 'g')) AS clean_md5 FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.md5(tx.node_text(F.col("text"))).alias("clean_md5"))


BLOB = "CASE doc_id % 4 WHEN 0 THEN 'see https://creativecommons.org/licenses/by-nc/4.0/ for terms' WHEN 1 THEN text WHEN 2 THEN '' ELSE 'Reuse is free. ' || text END"


@book.add(
    "c3_license_label",
    f"""SELECT doc_id, CASE WHEN regexp_matches(blob, 'creativecommons\\.org/licenses/([a-z-]+)/(\\d(?:\\.\\d)?)')
  THEN 'CC ' || upper(regexp_extract(blob, 'creativecommons\\.org/licenses/([a-z-]+)/(\\d(?:\\.\\d)?)', 1)) || ' ' || regexp_extract(blob, 'creativecommons\\.org/licenses/([a-z-]+)/(\\d(?:\\.\\d)?)', 2)
  ELSE coalesce(kind, nullif(substring(regexp_replace(regexp_replace(regexp_replace(blob, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+([.,;:)])', '\\1', 'g'), 1, 40), ''), 'unknown') END AS license
FROM (SELECT doc_id, {BLOB} AS blob, CASE WHEN doc_id % 5 = 0 THEN 'open-access' END AS kind FROM documents)""",
)
def _(spark, sf):
    rows = v.table(spark, sf, "documents").select("doc_id", F.expr(BLOB).alias("blob"), F.when(F.col("doc_id") % 5 == 0, "open-access").alias("kind"))
    return rows.select("doc_id", corpus.license_label(F.col("blob"), F.col("kind")).alias("license"))


@book.add("c4_permitted", f"{W} SELECT pmcid, license, {PERMITTED} AS permitted, upper(license) LIKE 'CC%' AND upper(license) NOT LIKE '%ND%' AS permitted_noncommercial FROM articles")
def _(spark, sf):
    lic = F.col("license")
    return v.articles(spark, sf).select("pmcid", "license", corpus.is_permitted(lic).alias("permitted"), corpus.is_permitted(lic, True).alias("permitted_noncommercial"))


@book.add("c5_whitelist", f"{W} SELECT pmcid, journal FROM articles WHERE journal IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey < 2)")
def _(spark, sf):
    journals = v.table(spark, sf, "nation").filter("n_regionkey < 2").select(F.concat(F.lit("src"), "n_nationkey").alias("journal"))
    return corpus.relevant(v.articles(spark, sf), journals).select("pmcid", "journal")


@book.add("c6_license_tally", f"{W} SELECT license, NOT {PERMITTED} AS dropped, count(*) AS n FROM articles GROUP BY 1, 2")
def _(spark, sf):
    return corpus.counts(v.articles(spark, sf).withColumn("dropped", ~corpus.is_permitted(F.col("license"))), "license", "dropped")


REQUESTS = "SELECT 'PMC' || doc_id AS pmcid FROM documents UNION ALL SELECT 'PMCX' || doc_id FROM documents WHERE doc_id % 9 = 0"
LOG = "SELECT 'PMC' || doc_id AS pmcid, 0 AS line, 'kept' AS status FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'PMC' || doc_id, 1, CASE WHEN doc_id % 10 < 3 THEN 'error' WHEN doc_id % 10 < 6 THEN 'kept' END FROM documents UNION ALL SELECT 'PMC' || doc_id, 2, 'kept' FROM documents WHERE doc_id % 10 = 1"


def _requests(spark, sf):
    docs = v.table(spark, sf, "documents")
    return docs.select(F.concat(F.lit("PMC"), "doc_id").alias("pmcid")).unionByName(docs.filter("doc_id % 9 = 0").select(F.concat(F.lit("PMCX"), "doc_id").alias("pmcid")))


def _log(spark, sf):
    """A log in three writes of which the second is the largest; a null status is a line cut short."""
    path = v.folder(spark, "log")
    docs = v.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("PMC"), "doc_id").alias("pmcid"))
    step = F.col("doc_id") % 10
    files.append_status(docs.filter(step == 0).select("pmcid", F.lit("kept").alias("status")), path)
    files.append_status(docs.select("pmcid", F.when(step < 3, "error").when(step < 6, "kept").alias("status")), path)
    files.append_status(docs.filter(step == 1).select("pmcid", F.lit("kept").alias("status")), path)
    return files.read_status_log(spark, path)


@book.add(
    "c7_outcomes",
    f"""{W}, wanted AS ({REQUESTS}) SELECT w.pmcid, CASE WHEN try_cast(substring(w.pmcid, 4) AS BIGINT) % 13 = 0 THEN 'error' WHEN a.pmcid IS NULL THEN 'empty' WHEN NOT {PERMITTED} THEN 'licence:' || license ELSE 'kept' END AS status
FROM wanted w LEFT JOIN articles a ON a.pmcid = w.pmcid""",
)
def _(spark, sf):
    failed = v.table(spark, sf, "documents").filter("doc_id % 13 = 0").select(F.concat(F.lit("PMC"), "doc_id").alias("pmcid"))
    return corpus.outcomes(_requests(spark, sf), v.articles(spark, sf), failed)


@book.add("s4_latest_status", f"SELECT pmcid, arg_max(status, line) AS status FROM ({LOG}) WHERE status IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return corpus.latest_status(_log(spark, sf))


@book.add("c8_resume", f"WITH wanted AS ({REQUESTS}), last AS (SELECT pmcid, arg_max(status, line) AS status FROM ({LOG}) WHERE status IS NOT NULL GROUP BY 1) SELECT pmcid FROM wanted WHERE pmcid NOT IN (SELECT pmcid FROM last WHERE status <> 'error')")
def _(spark, sf):
    return corpus.to_fetch(_requests(spark, sf), _log(spark, sf))


@book.add("c9_ranges", "SELECT o_custkey AS id, max(year(o_orderdate)) AS year FROM orders GROUP BY 1")
def _(spark, sf):
    rows = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"))
    return corpus.union_ranges(rows, "id", "year")


MANIFEST = f"SELECT pmcid, title, doi, license, journal, len(sections) AS n_sections, length({v.FULL_TEXT}) AS n_chars FROM articles"


@book.add("c10_manifest", f"{W} {MANIFEST}")
def _(spark, sf):
    return corpus.manifest(v.articles(spark, sf))


@book.add("c11_summary", f"{W} SELECT count(*) AS articles, sum(n_chars)::BIGINT AS chars, median(n_sections) AS median_sections, median(n_chars) AS median_chars FROM ({MANIFEST})")
def _(spark, sf):
    return corpus.summary(corpus.manifest(v.articles(spark, sf)))


@book.add("c12_top_journals", f"{W} SELECT journal, count(*) AS n FROM articles GROUP BY 1 ORDER BY n DESC, journal LIMIT 10")
def _(spark, sf):
    return corpus.counts(v.articles(spark, sf), "journal").orderBy(F.desc("n"), "journal").limit(10)


@book.add("c13_fourth_longest", f"{W} SELECT pmcid, len(sections) AS n_sections FROM articles ORDER BY 2 DESC, 1 LIMIT 1 OFFSET 3")
def _(spark, sf):
    rows = v.articles(spark, sf).select("pmcid", F.size("sections").cast("bigint").alias("n_sections"))
    return rows.orderBy(F.desc("n_sections"), "pmcid").offset(3).limit(1)


XML = "'<article><front><journal-meta><journal-title>' || source || '</journal-title></journal-meta><article-meta><permissions><license license-type=\"t' || (doc_id % 3) || '\"/></permissions></article-meta></front><body><sec><title>One &amp; two</title><p>' || replace(replace(regexp_replace(text, '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]', ''), '&', '&amp;'), '<', '&lt;') || '<xref>[1]</xref> .</p></sec></body></article>'"


@book.add("s11_parse_xml", r"SELECT 'PMC' || doc_id AS pmcid, source AS journal, 't' || (doc_id % 3) AS license, 'One & two' AS heading, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') || ' .', '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([.,;:)])', '\1', 'g') AS body FROM documents")
def _(spark, sf):
    batch = v.table(spark, sf, "documents").select(F.concat(F.lit("PMC"), "doc_id").alias("pmcid"), F.expr(XML).alias("xml"))
    return corpus.parse_articles(batch).select("pmcid", "journal", "license", F.col("sections")[0]["heading"].alias("heading"), F.col("sections")[0]["text"].alias("body"))


FIELDS = """concat('<article><front><journal-meta><journal-title>J ', source, '</journal-title></journal-meta><article-meta><article-id pub-id-type="doi"> 10.5/', doc_id, ' </article-id><article-id pub-id-type="pmid">1</article-id>
<title-group><article-title>T <i>', lang, '</i> x</article-title></title-group><permissions><license license-type="open"><license-p>see https://creativecommons.org/licenses/by/4.0/ now</license-p></license></permissions>
<abstract><p>Short <xref>[2]</xref>, of ', doc_id, '.</p></abstract></article-meta></front><body><sec><title>A</title><p>', replace(replace(regexp_replace(text, '[\\\\x00-\\\\x08\\\\x0B\\\\x0C\\\\x0E-\\\\x1F]', ''), '&', '&amp;'), '<', '&lt;'),
'</p><fig><p>left out</p></fig><sec><title>B</title><p>In<table-wrap>no</table-wrap>side.</p></sec><sec><title>C</title></sec></sec></body></article>')"""


@book.add("c1_article_fields", r"SELECT 'PMC' || doc_id AS pmcid, 'T ' || lang || ' x' AS title, '10.5/' || doc_id AS doi, 'CC BY 4.0' AS license, 'J ' || source AS journal, 'Short, of ' || doc_id || '.' AS abstract, CASE WHEN body = '' THEN 'Abstract|A > B' ELSE 'Abstract|A|A > B' END AS headings, md5(body) AS body_md5 FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([.,;:)])', '\1', 'g') AS body FROM documents)")
def _(spark, sf):
    """All fields of articles with nested sections, floats and citation marks."""
    batch = v.table(spark, sf, "documents").select(F.concat(F.lit("PMC"), "doc_id").alias("pmcid"), F.expr(FIELDS).alias("xml"))
    a = corpus.parse_articles(batch)
    body = F.array_join(F.transform(F.filter("sections", lambda s: s["heading"] == "A"), lambda s: s["text"]), "")
    return a.select("pmcid", "title", "doi", "license", "journal", F.col("sections")[0]["text"].alias("abstract"), F.array_join(F.transform("sections", lambda s: s["heading"]), "|").alias("headings"), F.md5(body).alias("body_md5"))


CUT = XML.replace("<xref>[1]</xref> .</p></sec></body></article>'", "<xref>[1]</xref> .' || element_at(array('', '</p>&nosuch;</b></sec>', '</p></sec></body></article', '</p><sec><title>Two</title><p>Left &amp; open'), CAST(doc_id % 4 AS INT) + 1)")


@book.add("s11_cut_xml", r"SELECT 'PMC' || doc_id AS pmcid, source AS journal, 't' || (doc_id % 3) AS license, CASE WHEN doc_id % 4 = 3 THEN 'One & two|One & two > Two' ELSE 'One & two' END AS headings, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') || ' .', '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([.,;:)])', '\1', 'g') || CASE WHEN doc_id % 4 = 3 THEN '|Left & open' ELSE '' END AS bodies FROM documents")
def _(spark, sf):
    """Articles whose XML ends too early, has ends that nothing began and entities that mean nothing."""
    batch = v.table(spark, sf, "documents").select(F.concat(F.lit("PMC"), "doc_id").alias("pmcid"), F.expr(CUT).alias("xml"))
    listed = lambda field: F.array_join(F.transform("sections", lambda s: s[field]), "|")
    return corpus.parse_articles(batch).select("pmcid", "journal", "license", listed("heading").alias("headings"), listed("text").alias("bodies"))


@book.add("k1_sentences", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(1))) AS all_md5 FROM (SELECT doc_id, {v.sql_sentences('text')} AS s FROM documents)")
def _(spark, sf):
    s = tx.sentences(F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.size(s).cast("bigint").alias("n"), F.md5(F.array_join(s, "\x01")).alias("all_md5"))


@book.add("k2_word_count", f"SELECT doc_id, {v.sql_words('text')} AS n_words FROM documents")
def _(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.word_count(F.col("text")).cast("bigint").alias("n_words"))


@book.add("k3_units", f"WITH {v.UNITS} SELECT pmcid, section_no, sentence_no, section, sentence, words FROM units")
def _(spark, sf):
    return chunking.units(v.articles(spark, sf))


@book.add("k4_fixed", f"{R}{v.FIXED} SELECT * FROM fixed")
def _(spark, sf):
    return chunking.chunk(v.articles(spark, sf), "fixed").select("doc_id", "chunk_index", "section", "text")


@book.add("k5_section", f"{R}{v.PASSAGES} SELECT * FROM passages")
def _(spark, sf):
    return v.passages(spark, sf).select("doc_id", "chunk_index", "section", "text")


@book.add("k6_semantic")
def _(spark, sf):
    from lectern.functions.plugins import hash_embed

    return chunking.chunk(v.articles(spark, sf), "semantic", embed=hash_embed)


@book.add("k8_seed_windows", f"{R}{v.WINDOWS} SELECT * FROM passages")
def _(spark, sf):
    return chunking.seed_windows(v.articles(spark, sf)).select("doc_id", "chunk_index", "section", "text")


@book.add("k7_chunk_metadata", f"{R}{v.PASSAGES} SELECT doc_id, chunk_index, title, doi, license FROM passages JOIN articles ON pmcid = doc_id")
def _(spark, sf):
    return v.passages(spark, sf).select("doc_id", "chunk_index", "title", "doi", "license")


LENGTHS = f"SELECT {v.sql_words('text')} AS w FROM passages"


@book.add("k9_lengths", f"{R}{v.PASSAGES} SELECT 'section' AS strategy, count(*) AS n, round(avg(w))::BIGINT AS mean_words, min(w) AS min_words, max(w) AS max_words FROM ({LENGTHS})")
def _(spark, sf):
    return chunking.length_stats(v.passages(spark, sf).withColumn("strategy", F.lit("section")), "strategy")


@book.add("k10_histogram", f"{R}{v.PASSAGES}, w AS ({LENGTHS}), e AS (SELECT min(w) AS lo, (max(w) - min(w)) / 30.0 AS step FROM w) SELECT 'section' AS strategy, CASE WHEN step > 0 THEN least(floor((w - lo) / step), 29) ELSE 0 END::INT AS bin, count(*) AS n FROM w, e GROUP BY 2")
def _(spark, sf):
    return chunking.length_histogram(v.passages(spark, sf).withColumn("strategy", F.lit("section")))
