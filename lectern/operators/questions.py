"""Building, checking, balancing, splitting and mapping a question set."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.durable import durable, stored
from lectern.operators.meaning import close_pairs, first_come
from lectern.operators.ordering import hash_order, ranked
from lectern.operators.sizes import small

MIN_WORDS, COPY_WORDS, ANSWER_COPY_WORDS = 40, 6, 10
ECHO_SHARE, SENTENCE_SHARE, GOLD_SHARE, SIMILAR = 0.8, 0.25, 0.5, 0.6
MIN_RELEVANCE, DUPLICATE = 0.3, 0.85

#: What a question or an answer sentence must not say.
SELF_REFERENCE = r"(?i)\b(the passage|this passage|the study|this study|the authors|this article|this paper|the trial|this trial|this cohort|the text)\b"
TWO_PARTS = r"(?i)\b(and|or)\s+(why|how|what|which|when|where|whether|does|do|is|are|can|should)\b"
ONE_CASE = r"(?i)\b(the patient|this patient|the right eye|the left eye|his eye|her eye|this case|the case)\b"
ONE_STUDY = r"(?i)\b(our (patients?|results|study|findings|case|cohort|data)|this (study|review|report|case)|the present study|we (found|report|observed|showed|describe|present|propose))\b"


def seed_pool(passages: DataFrame, excluded: list[str], min_words: int = MIN_WORDS) -> DataFrame:
    """Passages long enough whose heading holds none of the excluded key words."""
    heading = F.lower("section")
    bad = F.lit(False)
    for word in excluded:
        bad = bad | heading.contains(word)
    return passages.filter((tx.word_count(F.col("text")) >= min_words) & ~bad)


def one_per_article(pool: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """The first n rows in seeded order with at most one of each article."""
    spot = hash_order(seed, *key)
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(spot, *key))
    return pool.withColumn("_first", first).filter("_first = 1").drop("_first").orderBy(spot, *key).limit(n)


def _copies(words: Column, joined: Column, run: int) -> Column:
    """Whether a run of this many words stands, as text, in the joined words."""
    starts = F.when(F.size(words) >= run, F.sequence(F.lit(0), F.size(words) - run)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.contains(joined, F.array_join(F.slice(words, i + 1, run), " ")))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def problems(question: Column, answer: Column, passage: Column, accepted: Column | None = None) -> Column:
    """array of the reasons why a question fails. `accepted` is an array of earlier questions."""
    said = tx.content(answer)
    source = tx.joined_words(passage)
    checks = {
        "empty": (tx.trim(question) == "") | (tx.trim(answer) == ""),
        "refers to its source": question.rlike(SELF_REFERENCE),
        f"copies {COPY_WORDS} or more words from the passage": _copies(tx.plain_words(question), source, COPY_WORDS),
        f"answer copies {ANSWER_COPY_WORDS} or more words from the passage": _copies(tx.plain_words(answer), source, ANSWER_COPY_WORDS),
        "asks two questions": question.rlike(TWO_PARTS) | (F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit(""))) > 1),
        "near-duplicate of an earlier question": F.lit(False) if accepted is None else F.exists(accepted, lambda a: jaccard(tx.content(question), tx.content(a)) >= SIMILAR),
        "built on one patient or case": question.rlike(ONE_CASE),
        "answer repeats the question": (F.size(said) > 0) & (F.size(F.array_intersect(said, tx.content(question))) >= ECHO_SHARE * F.size(said)),
    }
    return F.filter(F.array(*[F.when(c, reason) for reason, c in checks.items()]), F.isnotnull)


#: Different words whose counts are sent to every executor, of 16 bytes each.
SENT_WORDS = 1_000_000
#: 64-bit numbers that the signatures of all candidates have, and those of the pairs that are left, and how many of them are sent to every executor.
SIGNATURES = ((16, 300_000), (64, 50_000))


def signature(hashes: Column, longs: int) -> Column:
    """A bit for each of a set's hashes. Two signatures differ in no more bits than two sets in words."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int"))
    spot = lambda h: F.pmod(F.shiftright(h, 6), F.lit(longs))
    return F.array(*[F.aggregate(F.filter(hashes, lambda h: spot(h) == k), F.lit(0).cast("bigint"), lambda s, h: s.bitwiseOR(bit(h))) for k in range(longs)])


def bits_apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similar_pairs(rows: DataFrame, key: str, text: str, least: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): pairs (a, b, similarity) of different word sets at least `least` alike, each named by its
    smallest key, and (key, a) of all rows. Equal sets are one; candidates share one of their rarest words,
    as many as a similar pair must, so the frequent words index nothing.

    Words are joined by hash with each set's size and the word's place in it, the rarest first. A pair is let
    through only by a word behind which both sets have enough words left; the first word that they share always
    is one if they are similar. Then signatures of two fixed sizes rule out pairs that surely differ in too many words, and only the sets of
    the others are brought together and compared. Sets are moved twice besides, to find equal ones and to place their words.
    """
    sets = rows.select(key, F.array_sort(tx.content(F.col(text))).alias("words")).filter(F.size("words") > 0)
    same = [F.xxhash64("words", F.lit(k)).alias(f"same{k}") for k in range(2)]
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    named = stored(sets.groupBy("words").agg(F.min(key).alias("a")).select("a", "words", *same), "sets")
    members = sets.select(key, *same).join(named.select("a", "same0", "same1"), ["same0", "same1"]).select(key, "a")
    frequency = named.select(F.explode(hashes).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    dealt = named.select("a", F.size("words").alias("n"), hashes.alias("hashes")).repartition("a")
    each = dealt.select("a", "n", F.explode("hashes").alias("word")).join(small(durable(frequency), SENT_WORDS), "word")
    place = F.row_number().over(Window.partitionBy("a").orderBy("df", "word"))
    # A little less than the product, which may be rounded up.
    needed = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    rare = stored(each.withColumn("i", place).filter((F.col("i") <= needed) & (F.col("df") > 1)).select("a", "n", "word", "i"), "words")
    other = rare.withColumnsRenamed({"a": "b", "n": "m", "i": "j"})
    shared = F.ceil(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9)
    close = (F.col("a") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9) & (1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= shared)
    candidates = rare.join(other, "word").filter(close).select("a", "b", "n", "m").distinct()
    most_apart = (1 - least) / (1 + least) * (F.col("n") + F.col("m")) + 1e-6
    hashed = named.select("a", hashes.alias("hashes"))

    def alike(pairs: DataFrame, longs: int, sent: int) -> DataFrame:
        signed = small(durable(hashed.select("a", signature(F.col("hashes"), longs).alias("bits"))), sent)
        both = pairs.join(signed.withColumnRenamed("bits", "bits_a"), "a").join(signed.withColumnsRenamed({"a": "b", "bits": "bits_b"}), "b")
        return durable(both.filter(bits_apart(F.col("bits_a"), F.col("bits_b")) <= most_apart).select("a", "b", "n", "m"))

    likely = alike(alike(candidates, *SIGNATURES[0]), *SIGNATURES[1]).select("a", "b")
    left = likely.join(named.select("a", F.col("words").alias("wa")), "a")
    both = left.join(named.select(F.col("a").alias("b"), F.col("words").alias("wb")), "b")
    share = jaccard(F.col("wa"), F.col("wb"))
    return durable(both.filter(share >= least).select("a", "b", F.round(share, 6).alias("similarity"))), members


def first_of_similar(rows: DataFrame, key: str, pairs: DataFrame, members: DataFrame) -> DataFrame:
    """`key` and kept: whether a row stays if rows are walked in the order of their keys and one goes if an earlier one that
    stayed is its near-duplicate. pairs and members are those of `similar_pairs` or `close_pairs`.

    Members of a class are each other's duplicates, so of a class at most the first stays, and the walk is over the
    classes. A row of no class (without words, or a direction) is like no other and stays.
    """
    gone = first_come(pairs).select(F.col("key").alias("a"), F.lit(True).alias("gone"))
    named = members.distinct().join(gone, "a", "left").select(key, (F.col("gone").isNull() & (F.col(key) == F.col("a"))).alias("kept"))
    return rows.select(key).join(named, key, "left").select(key, F.coalesce("kept", F.lit(True)).alias("kept"))


def verbatim(sentences: Column, passage: Column) -> Column:
    """Whether there are answer sentences and all stand in the passage, case and spacing aside."""
    whole = tx.normalise(passage)
    said = F.filter(sentences, lambda s: tx.trim(s) != "")
    return (F.size(said) > 0) & F.forall(said, lambda s: F.contains(whole, tx.normalise(s)))


def about_one_study(sentences: Column) -> Column:
    return F.exists(sentences, lambda s: s.rlike(ONE_STUDY))


def stating(sentences: Column, answer: Column) -> Column:
    """The sentences that share enough with the answer; the others are background."""
    said = tx.content(answer)
    return F.filter(sentences, lambda s: (F.size(tx.content(s)) > 0) & (F.size(F.array_intersect(tx.content(s), said)) >= SENTENCE_SHARE * F.size(tx.content(s))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def relevant_to_own(question_vector: Column, sentence_vector: Column) -> Column:
    """Whether the similarity reaches its limit; unit vectors in doubles keep one that equals it, but for rounding in the last places."""
    return F.round(dot(question_vector, sentence_vector), 9) >= MIN_RELEVANCE


def same_meaning(rows: DataFrame, key: str, vector: str, least: float = DUPLICATE) -> DataFrame:
    """`key`, class_id (the first row of an equal vector), n_links (other vectors at least `least` alike) and kept: whether no earlier row that stayed says the same."""
    pairs, members = close_pairs(rows, key, vector, least)
    pairs = durable(pairs)
    links = pairs.select(F.explode(F.array("a", "b")).alias("a")).groupBy("a").agg(F.count("*").alias("n_links"))
    named = members.distinct().join(links, "a", "left").select(key, F.col("a").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    kept = first_of_similar(rows, key, pairs, members)
    return kept.join(named, key, "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "kept")


def tally(reasons: DataFrame, column: str = "reasons") -> DataFrame:
    return reasons.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def quotas(n: int, categories: list[str], share_sub: float = 0.2, share_cat: float = 1 / 3, caps: dict[str, int] | None = None, floors: dict[str, int] | None = None) -> tuple[int, dict[str, int], dict[str, int]]:
    """(cap of a subspecialty, caps of categories, floors); floors that cannot be met are refused."""
    per_cat = {c: math.ceil(n * share_cat) for c in categories}
    per_cat |= {"mechanism": math.ceil(15 * n / 75)} if caps is None else caps
    least = {"imaging": math.floor(10 * n / 75), "prognosis": math.floor(10 * n / 75)} if floors is None else floors
    if sum(least.values()) > n:
        raise ValueError(f"{sum(least.values())} questions are promised to categories, but only {n} are wanted")
    return math.ceil(n * share_sub), per_cat, least


def accept(candidates: DataFrame, n: int, limits: tuple[int, dict[str, int], dict[str, int]], key: str, seed: int = 0) -> DataFrame:
    """The `key`s of at most n candidates (doc_id, subspecialty, category), taken in seeded order within the limits.

    Of each subspecialty and category only the first row of the first n articles can ever be taken, since
    each of these is taken, or its article is, or the limit is full for good; so the ordered fold sees at
    most n rows for each pair, whatever the input.
    """
    cap_sub, caps, floors = limits
    spot = hash_order(seed, key)
    own = Window.partitionBy("subspecialty", "category")
    rows = candidates.select(key, "doc_id", "subspecialty", "category", spot.alias("spot"))
    first = rows.withColumn("f", F.row_number().over(Window.partitionBy("subspecialty", "category", "doc_id").orderBy("spot", key))).filter("f = 1")
    few = first.withColumn("f", F.row_number().over(own.orderBy("spot", key))).filter(F.col("f") <= n).drop("f")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        taken, docs, sub, cat = [], set(), Counter(), Counter()
        for row in part.sort_values(["spot", key]).itertuples(index=False):
            if len(taken) == n:
                break
            left = n - len(taken) - 1
            owed = sum(max(0, need - cat[c] - (c == row.category)) for c, need in floors.items())
            if row.doc_id in docs or sub[row.subspecialty] >= cap_sub or cat[row.category] >= caps.get(row.category, n) or left < owed:
                continue
            taken.append(getattr(row, key))
            docs.add(row.doc_id)
            sub[row.subspecialty] += 1
            cat[row.category] += 1
        return pd.DataFrame({key: taken})

    return few.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fold, f"{key} {candidates.schema[key].dataType.simpleString()}")


def deal_pattern(sizes: dict[str, int]) -> list[str]:
    """Labels of the positions 1, 2, ... until the deal repeats: each goes to the split furthest behind its share."""
    g = math.gcd(*sizes.values())
    parts = {s: v // g for s, v in sizes.items()}
    total, dealt, out = sum(parts.values()), Counter(), []
    for k in range(1, total + 1):
        name = max(parts, key=lambda s: parts[s] * k - dealt[s] * total)
        dealt[name] += 1
        out.append(name)
    return out


def deal(rows: DataFrame, sizes: dict[str, int], key: str, strata: list[str], seed: int = 0, exact: bool = True) -> DataFrame:
    """Adds `split`, dealt along the order (strata, seeded hash). With `exact`, sizes must add up to the rows."""
    if exact and rows.count() != sum(sizes.values()):
        raise ValueError(f"the splits have room for {sum(sizes.values())} rows, not for all there are")
    pattern = deal_pattern(sizes)
    placed = ranked(rows, key, seed, strata)
    ends = rows.groupBy(*strata).agg(F.count("*").alias("_n"))  # one row per stratum
    offset = F.sum("_n").over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1))
    at = placed.join(small(ends.withColumn("_before", F.coalesce(offset, F.lit(0))).drop("_n")), strata)
    spot = F.pmod(F.col("_before") + F.col("rank") - 1, F.lit(len(pattern))) + 1
    return at.withColumn("split", F.element_at(F.array(*map(F.lit, pattern)), spot.cast("int"))).drop("_before", "rank")


def unevenness(cells: pd.DataFrame, strata: list[str]) -> float:
    """How far the splits are from their shares of every value of every key, summed. cells: strata, split and n."""
    share, out = cells.groupby("split")["n"].sum() / cells["n"].sum(), 0.0
    for axis in strata:
        held = cells.pivot_table(index=axis, columns="split", values="n", aggfunc="sum", fill_value=0).reindex(columns=share.index, fill_value=0)
        out += float((held - np.outer(held.sum(axis=1), share)).abs().to_numpy().sum())
    return out


class Swaps:
    """Counts of strata (rows) and splits (columns), and what moving one row of a stratum from a split to another changes.

    The unevenness is a sum over the values of each key, so a swap of two strata's labels changes it by what each
    stratum's move changes at its own values; where both have the same value of a key nothing changes there. So
    for each set of keys in which the two may agree the best partners are the least movers of each group of equal values: no
    pair of cells is tried, and after a swap only the touched values are counted anew.
    """

    def __init__(self, values: list[np.ndarray], n: np.ndarray):
        self.values, self.n = values, n  # for each key the number of the value of each stratum
        share = n.sum(axis=0) / n.sum()
        self.off = []  # for each key, by value and split: rows above the share
        for v in values:
            held = np.zeros((v.max() + 1, n.shape[1]))
            np.add.at(held, v, n)
            self.off.append(held - held.sum(axis=1, keepdims=True) * share)

    def cost(self, a: int, b: int) -> list[np.ndarray]:
        """For each key, by stratum: the change if one of its rows goes from split a to split b."""
        step = [np.abs(o[:, a] - 1) - np.abs(o[:, a]) + np.abs(o[:, b] + 1) - np.abs(o[:, b]) for o in self.off]
        return [s[v] for s, v in zip(step, self.values, strict=True)]

    def best(self, a: int, b: int) -> tuple[float, int, int]:
        """(change, stratum, stratum) of the best swap found: of a row in split a with one in split b."""
        there, back = self.cost(a, b), self.cost(b, a)
        out = (0.0, -1, -1)
        for agree in range(1 << len(self.values)):
            differ = [k for k in range(len(self.values)) if not agree >> k & 1]
            if not differ:
                continue
            go, come = sum(there[k] for k in differ), sum(back[k] for k in differ)
            group = np.zeros(len(self.n), np.int64)
            for k in range(len(self.values)):
                if agree >> k & 1:
                    group = group * (self.values[k].max() + 1) + self.values[k]
            group = np.unique(group, return_inverse=True)[1]
            firsts = []
            for gain, held in ((go, self.n[:, a]), (come, self.n[:, b])):
                order = np.lexsort((gain, group))
                order = order[held[order] > 0]
                lead = np.full(group.max() + 1, -1)
                lead[group[order][::-1]] = order[::-1]
                firsts.append(lead)
            both = np.flatnonzero((firsts[0] >= 0) & (firsts[1] >= 0))
            if len(both):
                x, y = firsts[0][both], firsts[1][both]
                # What the two share beyond `agree` changes nothing, so the true change is at most this.
                change = sum((there[k][x] + back[k][y]) * (self.values[k][x] != self.values[k][y]) for k in range(len(self.values)))
                at = int(np.argmin(change))
                out = min(out, (float(change[at]), int(x[at]), int(y[at])))
        return out

    def swap(self, a: int, b: int, x: int, y: int) -> None:
        for stratum, out, into in ((x, a, b), (y, b, a)):
            self.n[stratum, out] -= 1
            self.n[stratum, into] += 1
            for o, v in zip(self.off, self.values, strict=True):
                o[v[stratum], out] -= 1
                o[v[stratum], into] += 1

    def run(self) -> None:
        """Swaps until none is found that lowers the unevenness."""
        splits = range(self.n.shape[1])
        while True:
            found = min(((*self.best(a, b), a, b) for a in splits for b in splits if a != b), default=(0.0,))
            if found[0] > -1e-9:
                return
            _, x, y, a, b = found
            self.swap(a, b, x, y)


def refine(dealt: DataFrame, key: str, strata: list[str], seed: int = 0) -> DataFrame:
    """Swaps labels between strata while that makes the splits more even, then deals the new counts out within each stratum.

    One task works on the counts: a row for each stratum and split, whatever the number of questions.
    """
    counts = dealt.groupBy(*strata, "split").agg(F.count("*").alias("n"))
    names = ", ".join(f"`{s}` string" for s in strata)

    def even(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index=strata, columns="split", values="n", aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1)
        swaps = Swaps([np.unique(wide.index.get_level_values(s), return_inverse=True)[1] for s in strata], wide.to_numpy(np.int64, copy=True))
        swaps.run()
        fine = pd.DataFrame(swaps.n, index=wide.index, columns=wide.columns).reset_index().melt(strata, var_name="split", value_name="n")
        return fine[fine["n"] > 0][[*strata, "split", "n"]]

    wanted = durable(counts.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(even, f"{names}, split string, n bigint"))
    own = Window.partitionBy(*strata).orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    spans = wanted.withColumn("_to", F.sum("n").over(own)).withColumn("_from", F.col("_to") - F.col("n"))
    placed = ranked(dealt.drop("split"), key, seed, strata)
    joined = placed.join(small(spans), strata).filter((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_to")))
    return joined.drop("n", "_from", "_to", "rank")


def gold_chunks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, strategy, chunk_index and match of the passages of a question's article that hold an answer sentence.

    A sentence that no passage holds whole maps to those with at least half of its shingles, else to all
    with any, and the match is `split`. questions: question_id, source_doc_id, sentences; chunks:
    strategy, doc_id, chunk_index, text.
    """
    each = questions.select("question_id", F.col("source_doc_id").alias("doc_id"), F.posexplode("sentences").alias("no", "sentence"))
    pairs = chunks.join(small(each), "doc_id")
    share = F.size(F.array_intersect(tx.shingles(F.col("sentence")), tx.shingles(F.col("text")))) / F.size(tx.shingles(F.col("sentence")))
    whole = F.contains(tx.normalise(F.col("text")), tx.normalise(F.col("sentence")))
    held = pairs.select("question_id", "strategy", "no", "chunk_index", whole.alias("whole"), F.when(whole, 1.0).otherwise(share).alias("share")).filter("whole or share > 0")
    own = Window.partitionBy("question_id", "strategy", "no")
    best = held.withColumn("any_whole", F.max("whole").over(own)).withColumn("any_half", F.max(F.col("share") >= GOLD_SHARE).over(own))
    kept = best.filter(F.when(F.col("any_whole"), F.col("whole")).when(F.col("any_half"), F.col("share") >= GOLD_SHARE).otherwise(True))
    match = F.when(F.min(F.col("any_whole")).over(Window.partitionBy("question_id", "strategy")), "exact").otherwise("split")
    return kept.withColumn("match", match).select("question_id", "strategy", "chunk_index", "match").distinct()


def coverage(gold: DataFrame, questions: DataFrame, strategies: DataFrame) -> DataFrame:
    """strategy, n_missing (questions without gold) and n_split. strategies is a handful of rows."""
    every = questions.select("question_id").crossJoin(small(strategies))
    one = gold.groupBy("question_id", "strategy").agg(F.max(F.col("match") == "split").alias("cut"), F.lit(1).alias("there"))
    joined = every.join(one, ["question_id", "strategy"], "left")
    return joined.groupBy("strategy").agg(F.count_if(F.col("there").isNull()).alias("n_missing"), F.count_if(F.col("cut")).alias("n_split"))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """model and its cost, by the price whose prefix the model's name has (the longest). prices is a handful of rows."""
    matched = usage.groupBy("model").agg(F.sum("tokens_in").alias("i"), F.sum("tokens_out").alias("o")).join(small(prices), F.startswith(F.col("model"), F.col("prefix")))
    longest = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.length("prefix"))))
    return matched.withColumn("_n", longest).filter("_n = 1").select("model", F.round((F.col("i") * F.col("price_in") + F.col("o") * F.col("price_out")) / 1e6, 6).alias("cost"))
