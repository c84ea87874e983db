"""Views over the given tables that stand for the records of the two pipelines, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking
from lectern.operators.durable import durable, new_folder, stored
from lectern.operators.sizes import small, spread

#: Signs of the pieces by which texts of two words or fewer find the words that hold them.
GRAM = 3
LICENSES = ("CC BY 4.0", "unknown", "CC BY-NC 4.0", "CC0 1.0", "CC BY-ND 4.0")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    return new_folder(spark, name)


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: each line a section, two lines to a heading."""
    lines = F.split("text", "\n", -1)
    stated = F.nullif(F.regexp_extract("text", r"Licensed under (CC [A-Z-]+ [0-9]\.[0-9])", 1), F.lit(""))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("PMC"), "doc_id").alias("pmcid"),
        F.col("doc_id").alias("num"),
        F.substring(lines[0], 1, 60).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("10.5555/"), "doc_id")).alias("doi"),
        F.coalesce(stated, F.element_at(F.array(*map(F.lit, LICENSES)), (F.col("doc_id") % 5 + 1).cast("int"))).alias("license"),
        F.col("source").alias("journal"),
        F.transform(lines, lambda t, i: F.struct(F.concat(F.lit("S"), F.floor(i / 2)).alias("heading"), t.alias("text"))).alias("sections"),
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(articles(spark, sf), "section").withColumn("num", F.substring("doc_id", 4, 20).cast("bigint"))


def stored_passages(spark: SparkSession, sf: str) -> DataFrame:
    return stored(passages(spark, sf), "passages")


def both_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed and section passages with `strategy`."""
    a = articles(spark, sf)
    made = [chunking.chunk(a, s).withColumn("strategy", F.lit(s)) for s in ("fixed", "section")]
    return made[0].unionByName(made[1])


def _runs(text: str):
    """Words and the white space between them, in order."""
    return F.regexp_extract_all(F.col(text), F.lit(r"\s+|\S+"), F.lit(0))


def _grams(text, length):
    """The distinct pieces of that many signs of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.substring(text, i, length)))


def holders(items: DataFrame, docs: DataFrame) -> DataFrame:
    """question_id and doc_id of the documents that hold an item's text (question_id, question).

    A text that holds another holds its whole words, the first and last apart. Items are filed under the
    rarest of these, counted over all documents. An item of two words or fewer has none: it is filed under every
    word of the documents that holds its longest run of word or white-space signs, and these are found by a piece of GRAM signs of it.
    A document's own words then fetch the items to look for. The empty text is in every document.
    """
    texts = items.filter("question is not null").select("question").distinct()
    runs = texts.select("question", _runs("question").alias("runs"))
    inner = F.filter(F.slice("runs", 2, F.greatest(F.size("runs") - 2, F.lit(0))), lambda w: w.rlike(r"\S"))
    words = durable(runs.select("question", "runs", F.array_distinct(inner).alias("inner")))
    each = docs.select("doc_id", F.explode(F.array_distinct(_runs("text"))).alias("word"))
    listed = words.select("question", F.explode("inner").alias("word"))
    counts = each.join(small(listed.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    filed = listed.join(counts, "word", "left").groupBy("question").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    bare = words.filter("size(inner) = 0 and question <> ''")
    if not bare.isEmpty():
        longest = F.array_max(F.transform("runs", lambda w: F.struct(w.rlike(r"\S").alias("said"), F.length(w).alias("n"), w.alias("run"))))["run"]
        length = F.least(F.length("run"), F.lit(GRAM))
        looked = durable(bare.select("question", longest.alias("run")).select("question", "run", F.substring("run", F.lit(1), length).alias("gram"), length.alias("length")))
        lengths = [r[0] for r in looked.select("length").distinct().collect()]  # at most GRAM of them
        vocabulary = durable(each.select("word").distinct())
        pieces = F.flatten(F.array(*[F.when(F.length("word") >= n, _grams(F.col("word"), n)).otherwise(F.array().cast("array<string>")) for n in lengths]))
        holding = vocabulary.select("word", F.explode(pieces).alias("gram")).join(small(looked), "gram").filter(F.contains("word", "run"))
        filed = filed.unionByName(holding.select("question", "word"))
    filed = durable(filed)
    candidates = durable(each.join(small(filed), "word").select("question", "doc_id").distinct())
    checked = docs.select("doc_id", "text").join(small(candidates), "doc_id").filter(F.contains("text", "question")).select("question", "doc_id")
    everywhere = docs.filter("text is not null").select(F.lit("").alias("question"), "doc_id")
    held = checked.unionByName(everywhere.join(F.broadcast(texts.filter("question = ''")), "question"))  # one row at most
    return items.select("question_id", "question").join(held, "question").select("question_id", "doc_id")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions whose source is the lowest document that holds the text; written once."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    held = holders(items, table(spark, sf, "documents")).groupBy("question_id").agg(F.min("doc_id").alias("source"))
    return durable(items.join(held, "question_id", "left").select(
        "question_id", "question", F.concat(F.lit("PMC"), "source").alias("source_doc_id"), F.concat(F.lit("c"), F.col("question_id") % 5).alias("category"), F.concat(F.lit("s"), F.col("question_id") % 10).alias("subspecialty")
    ))


BREAK = r"""regexp_replace({0}, '([.!?])\s+([A-Z("''])', '\1' || chr(1) || '\2', 'g')"""


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_sentences(x: str) -> str:
    return f"list_filter(list_transform(string_split({BREAK.format(x)}, chr(1)), lambda s: {sql_trim('s')}), lambda s: s <> '')"


def sql_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def sql_plain(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


#: A table of one row with the 256 steps of CRC32, for `sql_crc`.
POLY = "poly AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"


def sql_crc(x: str) -> str:
    """CRC32 of a text's bytes; `steps` of POLY has to be in reach."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen({x}) + 1), lambda i: ('0x' || substr(hex({x}), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def sql_vectors(name: str, source: str, keys: str, text: str) -> str:
    """Queries `name` (keys, v): the whole-numbered vectors of the stand-in embedder before they are scaled."""
    split = f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> '')"
    return f"""{name}_h AS (SELECT {keys}, {sql_crc('w')} AS h FROM (SELECT {keys}, unnest({split}) AS w FROM {source}), poly),
{name}_c AS (SELECT {keys}, h % 64 AS axis, sum(CASE WHEN h & 1024 <> 0 THEN 1 ELSE -1 END)::BIGINT AS c FROM {name}_h GROUP BY ALL),
{name}_m AS (SELECT {keys}, map_from_entries(list((axis, c))) AS m, bool_or(c <> 0) AS uneven FROM {name}_c GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, CASE WHEN coalesce(uneven, false) THEN list_transform(range(64), lambda a: coalesce(m[a], 0)) ELSE list_transform(range(64), lambda a: CASE WHEN a = 0 THEN 1 ELSE 0 END) END AS v FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN {name}_m USING ({keys}))"""


def sql_shingles(x: str, n: int = 5) -> str:
    w = sql_plain(x)
    return f"list_distinct(list_transform(range(0, greatest(len({w}) - {n}, 0) + 1), lambda i: array_to_string(list_slice({w}, i + 1, i + {n}), ' ')))"


STATED = r"nullif(regexp_extract(text, 'Licensed under (CC [A-Z-]+ [0-9]\.[0-9])', 1), '')"
ARTICLES = f"""articles AS MATERIALIZED (
  SELECT 'PMC' || doc_id AS pmcid, doc_id AS num, substring(string_split(text, chr(10))[1], 1, 60) AS title,
         CASE WHEN doc_id % 3 <> 0 THEN '10.5555/' || doc_id END AS doi,
         coalesce({STATED}, {list(LICENSES)!r}[doc_id % 5 + 1]) AS license, source AS journal,
         list_transform(string_split(text, chr(10)), lambda t, i: struct_pack(heading := 'S' || ((i - 1) // 2), text := t)) AS sections
  FROM documents)"""
FULL_TEXT = "array_to_string(list_transform(sections, lambda s: s.heading || chr(10) || s.text), chr(10) || chr(10))"
UNITS = f"""{ARTICLES}, bodies AS (
  SELECT pmcid, i - 1 AS section_no, sections[i].heading AS section, {sql_sentences('sections[i].text')} AS said
  FROM articles, LATERAL unnest(range(1, len(sections) + 1)) AS t(i)),
units AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY section_no, sentence_no) AS pos,
         coalesce(sum(words) OVER (PARTITION BY pmcid ORDER BY section_no, sentence_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT pmcid, section_no, j - 1 AS sentence_no, section, said[j] AS sentence, {sql_words('said[j]')} AS words FROM bodies, LATERAL unnest(range(1, len(said) + 1)) AS t(j)))"""


def sql_within(size: int, new: str, name: str = "passages") -> str:
    return f"""{UNITS}, fold AS (
  SELECT pmcid, pos, section, section_no, 0 AS k, words AS held FROM units WHERE pos = 1
  UNION ALL
  SELECT u.pmcid, u.pos, u.section, u.section_no, CASE WHEN f.held + u.words > {size} OR {new} THEN f.k + 1 ELSE f.k END,
         CASE WHEN f.held + u.words > {size} OR {new} THEN u.words ELSE f.held + u.words END
  FROM fold f JOIN units u ON u.pmcid = f.pmcid AND u.pos = f.pos + 1),
{name} AS MATERIALIZED (
  SELECT pmcid AS doc_id, k AS chunk_index, arg_min(u.section, pos) AS section, string_agg(u.sentence, ' ' ORDER BY pos) AS text
  FROM fold JOIN units u USING (pmcid, pos) GROUP BY 1, 2)"""


PASSAGES = sql_within(300, "u.section <> f.section")
WINDOWS = sql_within(250, "u.section_no <> f.section_no")
FIXED = f"""{UNITS}, carry AS MATERIALIZED (
  SELECT u.pmcid, u.pos, max(v.pos) AS back FROM units u JOIN units v ON v.pmcid = u.pmcid AND v.pos < u.pos AND u.before - v.before >= 40 AND u.before - v.before < 40 + v.words GROUP BY 1, 2),
fold AS (
  SELECT pmcid, pos, 1::BIGINT AS start, words AS held, 0 AS k, NULL::BIGINT AS cut FROM units WHERE pos = 1
  UNION ALL
  SELECT u.pmcid, u.pos,
         CASE WHEN f.held + u.words > 200 THEN greatest(f.start, coalesce(c.back, f.start)) ELSE f.start END,
         CASE WHEN f.held + u.words > 200 THEN (u.before - (SELECT w.before FROM units w WHERE w.pmcid = u.pmcid AND w.pos = greatest(f.start, coalesce(c.back, f.start))) + u.words)::BIGINT ELSE f.held + u.words END,
         CASE WHEN f.held + u.words > 200 THEN f.k + 1 ELSE f.k END, CASE WHEN f.held + u.words > 200 THEN f.start END
  FROM fold f JOIN units u ON u.pmcid = f.pmcid AND u.pos = f.pos + 1 LEFT JOIN carry c ON c.pmcid = u.pmcid AND c.pos = u.pos),
spans AS (
  SELECT pmcid, k - 1 AS k, cut AS start, pos - 1 AS stop FROM fold WHERE cut IS NOT NULL
  UNION ALL SELECT pmcid, max(k), arg_max(start, pos), max(pos) FROM fold GROUP BY pmcid),
fixed AS MATERIALIZED (
  SELECT pmcid AS doc_id, k AS chunk_index, arg_min(u.section, pos) AS section, string_agg(u.sentence, ' ' ORDER BY pos) AS text
  FROM spans JOIN units u USING (pmcid) WHERE u.pos BETWEEN start AND stop GROUP BY 1, 2)"""
QUESTIONS = """questions AS MATERIALIZED (
  SELECT item_id AS question_id, b.text AS question, 'PMC' || min(doc_id) AS source_doc_id, 'c' || (item_id % 5) AS category, 's' || (item_id % 10) AS subspecialty
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id, b.text)"""
