"""BM25 as tables: postings with weights, document frequencies, query terms, scores of all queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.durable import durable, stored
from lectern.operators.sizes import small

K1, B = 1.5, 0.75
LABELLED_MODEL = "google/embeddinggemma-300m"


def passage_text(model: Column, title: Column, text: Column) -> Column:
    """The text that a model embeds for a passage."""
    named = F.concat(F.lit("title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("none")), F.lit(" | text: "), text)
    return F.when(model == LABELLED_MODEL, named).otherwise(text)


def query_text(model: Column, text: Column, labelled: Column) -> Column:
    return F.when((model == LABELLED_MODEL) & labelled, F.concat(F.lit("task: search result | query: "), text)).otherwise(text)


def term_frequencies(passages: DataFrame, keys: list[str], wanted: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """keys, term, tf and dl, of the `wanted` terms if given.

    Texts are dealt out by key in `parts` tasks once, which is less than their terms would be; the rows of a passage then
    stay in its task through every count and sum by `keys` and more, and nothing else is moved.
    """
    dealt = passages.select(*keys, "text")
    dealt = dealt.repartition(parts, *keys) if parts else dealt.repartition(*keys)
    held = dealt.select(*keys, tx.tokens(F.col("text")).alias("_t"))
    each = held.select(*keys, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.groupBy(*keys, "term", "dl").agg(F.count("*").cast("int").alias("tf")).select(*keys, "term", "tf", "dl")


def mean_length(passages: DataFrame) -> DataFrame:
    """avgdl over all passages, empty ones included."""
    return passages.agg(F.avg(F.size(tx.tokens(F.col("text")))).alias("avgdl"), F.count("*").alias("n_passages"))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def postings(passages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, tf, dl and weight."""
    tf = term_frequencies(passages, keys).crossJoin(F.broadcast(mean_length(passages)))  # one row
    return tf.withColumn("weight", weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).drop("avgdl", "n_passages")


def term_id(term: Column) -> Column:
    return F.crc32(term.cast("binary"))


def sparse_vectors(weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term_id and the summed weight of the terms with that id."""
    return weights.groupBy(*keys, term_id(F.col("term")).alias("term_id")).agg(F.sum("weight").alias("weight"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    each = queries.select(key, F.explode(tx.tokens(F.col(text))).alias("term"))
    return each.groupBy(key, "term").agg(F.count("*").alias("qtf"))


def idf(frequencies: DataFrame, n_passages: Column, okapi: bool = False) -> DataFrame:
    """term, df, idf of a table of (term, df). The Okapi form floors negative values at a quarter of the mean."""
    part = F.log((n_passages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if not okapi:
        return frequencies.select("term", "df", F.log1p((n_passages - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    raw = frequencies.select("term", "df", part.alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def document_frequencies(passages: DataFrame) -> DataFrame:
    return passages.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each query with their rank, from 1; ties need a key in `order`."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*(order or [F.desc("score")])))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


#: Scores, one for each query and passage, that a task holds at once, (query, term) rows that are sent to every executor at once, and passages of a task for each of the k.
SCORES, QUERY_TERMS, PART_PASSAGES = 1 << 21, 400_000, 80


def document_frequencies_of(passages: DataFrame, terms: DataFrame) -> DataFrame:
    """term and df of the distinct `terms` that passages hold; only counts of each task are moved."""
    each = passages.select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    sent = small(terms)
    count = lambda rows: rows.groupBy("term").agg(F.count("*").alias("df"))
    return count(each).join(terms, "term", "left_semi") if sent is terms else count(each.join(sent, "term", "left_semi"))


def bm25_search(passages: DataFrame, queries: DataFrame, keys: list[str], k: int = 50, key: str = "query_id", text: str = "query") -> DataFrame:
    """query, keys, score and rank of the k best passages of every query, among those that share a term with it.

    Passages are dealt out by key, so a task sums whole scores and hands on its k best of each query alone; what is moved are the
    texts, once, and these. More queries than a task can hold the scores of, or than are sent at once, are worked off
    block by block over the same passages. Scores round to 9 places, and ties go by the passage's key.
    """
    terms = query_terms(queries, key, text)
    asked, most = terms.agg(F.count_distinct(key), F.count("*")).first()
    size = mean_length(passages).first()
    n_passages, avgdl = F.lit(size["n_passages"]), F.lit(size["avgdl"]).cast("double")
    frequency = document_frequencies_of(passages, durable(terms.select("term").distinct()))
    gain = F.col("qtf") * F.log1p((n_passages - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per_query = durable(terms.join(frequency, "term").select("term", key, gain.alias("gain")))
    blocks = max(1, -(-asked * PART_PASSAGES * k // SCORES), -(-most // QUERY_TERMS))
    cores = passages.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-size["n_passages"] * -(-asked // blocks) // SCORES))
    best = []
    for block in range(blocks):
        some = per_query if blocks == 1 else per_query.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)
        own = term_frequencies(passages, keys, small(some.select("term").distinct()), parts)
        joined = own.join(F.broadcast(some), "term")  # about QUERY_TERMS rows at most
        scored = joined.groupBy(key, *keys).agg(F.round(F.sum(F.col("gain") * weight(F.col("tf"), F.col("dl"), avgdl)), 9).alias("score"))
        best.append(top_k(scored, k, key, [F.desc("score"), *map(F.col, keys)]))
    return reduce(DataFrame.unionByName, best)


#: Postings of a block at most, about, and blocks of a query that are read first, to learn how good its k-th hit is at least.
BLOCK_POSTINGS, FIRST_BLOCKS = 1_024, 8
#: Levels of weight that a term's postings are cut into, for each unit of weight.
LEVELS = 8
#: Terms of the queries that are looked up in the statistics of the stored files; more are joined alone.
PUSHED_TERMS = 2_000


def lexical_blocks(passages: DataFrame, keys: list[str], size: int = BLOCK_POSTINGS) -> DataFrame:
    """The lexical index as blocks: term, level, part, n, top (the greatest weight), n_passages and postings (keys and weight).

    A term's postings are cut by levels of weight, and a level of more than `size` by a hash of the key, so the
    postings of a frequent word are many blocks of bounded size and the work of many tasks. Rows are in order of
    terms, so that the stored files tell which of them hold a term.
    """
    own = stored(term_frequencies(passages, keys), "terms")
    sizes = mean_length(passages)
    weighed = own.crossJoin(F.broadcast(sizes)).withColumn("weight", weight(F.col("tf"), F.col("dl"), F.col("avgdl")))  # one row
    rows = weighed.select(*keys, "term", "weight", "n_passages", F.floor(F.col("weight") * LEVELS).cast("int").alias("level"))
    full = rows.groupBy("term", "level").agg(F.count("*").alias("_n")).filter(F.col("_n") > size).select("term", "level", F.ceil(F.col("_n") / size).cast("int").alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*keys), "_parts"), F.lit(0)).cast("int")
    cut = rows.join(small(full), ["term", "level"], "left").withColumn("part", part)
    # Dealt out in the order of terms once, before the lists are made, so that postings are not moved again to be put in order.
    dealt = cut.repartitionByRange("term", "level", "part")
    blocks = dealt.groupBy("term", "level", "part").agg(F.count("*").alias("n"), F.max("weight").alias("top"), F.first("n_passages").alias("n_passages"), F.collect_list(F.struct(*keys, "weight")).alias("postings"))
    return blocks.sortWithinPartitions("term", F.desc("level"))


def block_search(blocks: DataFrame, queries: DataFrame, keys: list[str], k: int = 50, key: str = "query_id", text: str = "query") -> DataFrame:
    """The hits of `bm25_search` from a stored index of blocks, of which only those are read that can hold one of them.

    A passage with a posting in a block can reach at most the block's best gain plus the best gains of the query's other
    terms. A first pass over each query's most promising blocks tells what its k-th hit reaches at least; a block that
    stays below that is left out. Every hit has all its postings in the blocks that are read, so scores are whole.
    """
    return _searched(blocks, queries, keys, k, key, text)[0]


def needed_blocks(blocks: DataFrame, queries: DataFrame, keys: list[str], k: int = 50, key: str = "query_id", text: str = "query") -> DataFrame:
    """`key`, term, level, part and n of the blocks that `block_search` reads for each query."""
    return _searched(blocks, queries, keys, k, key, text)[1]


def _searched(blocks: DataFrame, queries: DataFrame, keys: list[str], k: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    asked = durable(query_terms(queries, key, text))
    terms = [r[0] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    near = blocks.filter(F.col("term").isin(terms)) if len(terms) <= PUSHED_TERMS else blocks
    at = ["term", "level", "part"]
    heads = near.select(*at, "n", "top", "n_passages").join(small(asked.select("term").distinct()), "term", "left_semi")
    frequency = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("best"), F.first("n_passages").alias("n_passages"))
    gains = asked.join(frequency, "term").select(key, "term", (F.col("qtf") * F.log1p((F.col("n_passages") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("gain"), "best")
    whole = gains.groupBy(key).agg(F.sum(F.col("gain") * F.col("best")).alias("all"))
    gains = gains.join(whole, key).select(key, "term", "gain", (F.col("all") - F.col("gain") * F.col("best")).alias("others"))
    reach = durable(heads.select(*at, "n", "top").join(gains, "term").select(key, *at, "n", "gain", (F.col("gain") * F.col("top")).alias("own"), "others"))
    place = Window.partitionBy(key).orderBy(F.desc("own"), *at)
    first = reach.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= FIRST_BLOCKS)

    head = near.select("n_passages").first()
    scores = (head["n_passages"] if head else 0) * asked.select(key).distinct().count()
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-scores // SCORES))

    def summed(chosen: DataFrame) -> DataFrame:
        """Scores from the blocks of any query, whose postings are dealt out by passage, so that sums stay in their task; what a query needs not only adds passages below its hits."""
        wanted, gain = chosen.select(*at).distinct(), chosen.select(key, "term", "gain").distinct()
        posted = near.select(*at, "postings").join(small(wanted), at).select("term", F.explode("postings").alias("p"))
        dealt = posted.select("term", *[F.col(f"p.{c}").alias(c) for c in keys], F.col("p.weight").alias("weight")).repartition(parts, *keys)
        return dealt.join(small(gain, QUERY_TERMS), "term").groupBy(key, *keys).agg(F.sum(F.col("gain") * F.col("weight")).alias("score"))

    least = top_k(summed(first), k, key, [F.desc("score"), *map(F.col, keys)]).filter(F.col("rank") == k).select(key, F.col("score").alias("least"))
    needed = durable(reach.join(small(least), key, "left").filter(F.col("own") + F.col("others") >= F.coalesce("least", F.lit(0.0)) - 1e-8).drop("least"))
    scored = summed(needed).withColumn("score", F.round("score", 9))
    return top_k(scored, k, key, [F.desc("score"), *map(F.col, keys)]), needed.select(key, *at, "n")
