"""Personal data: spans of fixed kinds, and terms that reveal them, all as DataFrame expressions.

The fixed kinds (email, ip, card, phone) are found by regular expressions over whole texts, in code points.
The method then looks at the words near each protected value. Over the corpus it estimates how much a word
tells about a value: their pointwise mutual information, ln(P(value | word) / P(value)), as a share of what
there is to tell, -ln P(value). All four counts are of different texts, so copies of a text weigh nothing. A
word whose share reaches a disclosure threshold is generalised, or removed beyond a higher one, wherever it
stands in a text that holds that value. A pair also needs MIN_CONTEXTS different surroundings, so a passage
that texts share makes no word revealing by itself.

Java's regular expressions recurse in repeated groups and would overflow the stack on very long runs, so
every pattern here repeats single characters, or groups a fixed small number of times. Places come from
running sums in chunks, so thousands of spans in one row cost little more than their number.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.5, 0.9
#: Code points on either side of a value whose words are looked at.
NEAR = 64
#: Candidate words, or rows with revealing words, that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 10_000
#: Repeated texts, by hash, that are sent to every executor; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000
#: Bits of the bitmap of told rows, and bits that one row of it holds (fixed by bitmap_construct_agg), as powers of two.
MARK_BITS, ROW_BITS = 27, 15
#: Numbers that a running sum takes at a time, and code points of a text's blocks.
CHUNK, BLOCK = 64, 1_024

#: A dot that no host character follows ends a host, but may stand in a local part: "%" acts alike in both.
HOST_END_DOT = r"\.(?![A-Za-z0-9-])"
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"
IP_VALID = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
#: A whole run of digits with single separators, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}{3,}+"

SPAN = "struct<start:int,end:int,value:string>"
FOUND = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, merge) -> Column:
    """For each of an array of whole numbers from 0 the merge (sum or greatest) of those before it, 0 for the first.

    Arrays are copied when they grow, so numbers are taken CHUNK at a time, and then the chunks.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda xs: F.aggregate(xs, empty, lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))
    starts = lambda xs: F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    joined = lambda done, before: F.flatten(F.transform(done, lambda d, k: F.transform(d["out"], lambda x: merge(before[k], x))))
    chunks = let(values, lambda xs: F.transform(starts(xs), lambda k: fold(F.slice(xs, k + 1, CHUNK))))
    return let(chunks, lambda done: let(fold(F.transform(done, lambda d: d["at"]))["out"], lambda before: joined(done, before)))


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points, so that `cut` need not count from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(of: Column, start: Column, size: Column) -> Column:
    """`size` code points from `start` on of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    several = F.floor((start + size - 1) / BLOCK).cast("int") - first + 1
    return F.when(size <= 0, "").otherwise(F.substring(F.array_join(F.slice(of, first + 1, F.greatest(several, F.lit(1))), ""), start - first * BLOCK + 1, size))


def spans(text: Column, pattern: str) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches, from the lengths of the matches and of the gaps between them."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(found: Column) -> Column:
        size = F.transform(found, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))
        both = F.zip_with(found, running(size, lambda a, b: a + b), lambda p, at: F.struct(p["hit"].alias("hit"), (at + F.length(p["gap"])).alias("start")))
        hits = F.filter(both, lambda x: x["hit"].isNotNull())
        return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))

    return let(parts, placed).cast(f"array<{SPAN}>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """FOUND of the fixed kinds, by kind as listed and then by start; `left` and `right` are the surroundings."""
    none = F.array().cast(f"array<{SPAN}>")
    hosts = F.regexp_replace(text, HOST_END_DOT, "%")
    each = {
        "email": F.when(text.contains("@"), spans(hosts, EMAIL)).otherwise(none),
        "ip": F.filter(F.when(text.rlike(IP), spans(text, IP)).otherwise(none), lambda s: s["value"].rlike(IP_VALID)),
        "card": F.filter(F.when(text.rlike(CARD), spans(text, CARD)).otherwise(none), lambda s: luhn(digits(s["value"]))),
        "phone": F.filter(F.when(text.contains("+"), spans(text, PHONE)).otherwise(none), lambda s: F.length(digits(s["value"])).between(8, 15)),
    }

    named = lambda kind: F.transform(each[kind], lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    def near(of: Column, s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        value = F.when(s["kind"] == "email", cut(of, s["start"], s["end"] - s["start"])).otherwise(s["value"])
        left, right = cut(of, begin, s["start"] - begin), cut(of, s["end"], F.lit(NEAR))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"), left.alias("left"), right.alias("right"))

    full = lambda found: F.when(F.size(found) > 0, let(blocks(text), lambda of: F.transform(found, lambda s: near(of, s)))).otherwise(F.array().cast(FOUND))
    return let(F.concat(*map(named, KINDS)), full).cast(FOUND)


def entity(kind: Column, value: Column) -> Column:
    """What makes two values the same protected entity."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits(value)).otherwise(F.lower(value)))


def mentions(found: DataFrame) -> DataFrame:
    """entity, text_key, context and term of each word near a value, cut words left out."""
    one = found.select("text_key", F.explode("base").alias("s"))
    inner_left = F.regexp_replace("s.left", r"^\p{L}+", "")
    inner_right = F.regexp_replace("s.right", r"\p{L}+$", "")
    left = F.when(F.length("s.left") < NEAR, F.col("s.left")).otherwise(inner_left)
    right = F.when(F.length("s.right") < NEAR, F.col("s.right")).otherwise(inner_right)
    words = lambda text: F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)
    context = F.xxhash64(F.lower(F.col("s.left")), F.lower(F.col("s.right")))
    return one.select(entity(F.col("s.kind"), F.col("s.value")).alias("entity"), "text_key", context.alias("context"), F.explode(F.concat(words(left), words(right))).alias("term"))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its counted rows are few enough. df has to be checkpointed."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def first_of_each_text(docs: DataFrame) -> DataFrame:
    """The texts of docs, copies left out: of equal texts the rows with the smallest id stay, null ids last."""
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    repeated = durable(keyed.groupBy("text_key").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("text_key", "first"))
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_TEXTS else repeated
    return keyed.join(side, "text_key", "left").filter(F.col("first").isNull() | (place == F.col("first"))).select("text")


def revealing(near: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term, share: how much of the entity's information the term gives away, where it is at least GENERALISE."""
    pairs = near.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("text_key").alias("together"))
    pairs = durable(pairs.filter(F.col("contexts") >= MIN_CONTEXTS).drop("contexts"))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("share"))
    held = found.select("text_key", F.explode(F.transform("base", lambda s: entity(s["kind"], s["value"]))).alias("entity")).distinct()
    alone = held.groupBy("entity").agg(F.count("*").alias("alone"))
    # Counted before they are joined: a join of single words would pass on as many rows as the frequent ones have.
    texts = first_of_each_text(docs)
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
    frequency = words.groupBy("term").agg(F.count("*").alias("texts"))
    total = F.lit(found.select("text_key").distinct().count())
    share = F.log(F.col("together") * total / (F.col("alone") * F.greatest("texts", "together"))) / F.log(total / F.col("alone"))
    return pairs.join(alone, "entity").join(frequency, "term").filter(total > F.col("alone")).select("entity", "term", share.alias("share")).filter(F.col("share") >= GENERALISE)


def terms_by_row(found: DataFrame, docs: DataFrame) -> DataFrame:
    """_row_id, _row_key and told (array of term, share) of rows that hold a value which words reveal."""
    pairs = durable(revealing(mentions(found), found, docs))
    held = found.select("doc_id", "row_key", F.explode(F.array_distinct(F.transform("base", lambda s: entity(s["kind"], s["value"])))).alias("entity"))
    best = held.join(small(pairs), "entity").groupBy("doc_id", "row_key", "term").agg(F.max("share").alias("share"))
    rows = best.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(F.struct("term", "share"))).alias("told"))
    return durable(rows.select(F.coalesce("doc_id", F.lit(0)).alias("_row_id"), F.col("row_key").alias("_row_key"), "told"))


def term_spans(text: Column, told: Column) -> Column:
    """array of (start, end, share) of the words of a text that it was told are revealing."""
    known = lambda words: let(F.map_from_entries(told), lambda share: F.transform(words, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.element_at(share, F.lower(w["value"])).alias("share"))))
    listed = F.transform(told, lambda t: t["term"])
    found = F.filter(spans(text, WORD), lambda w: F.array_contains(listed, F.lower(w["value"])))
    return F.when(told.isNotNull(), known(found)).otherwise(F.array()).cast(TERMS)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and base spans of every row, checkpointed: no texts but the surroundings of spans."""
    keyed = _texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return durable(keyed.select("doc_id", "row_key", F.xxhash64("text").alias("text_key"), base_spans(F.col("text")).alias("base")))


TERMS = "array<struct<start:int,end:int,share:double>>"


def _told(docs: DataFrame, extra: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, text (null: null) and told of every row. Only texts of rows that may be told of words are joined and so perhaps shuffled.

    Beyond BROADCAST_ROWS rows with such words a bitmap of the hashes of their keys, at most 2 ** MARK_BITS bits whatever the
    input, is sent to every executor; rows whose bit is not set are surely told of none and stay where they are.
    """
    doc_id = F.col("doc_id").cast("bigint")
    keyed = docs.select(*columns, "text", F.coalesce(doc_id, F.lit(0)).alias("_row_id"), F.xxhash64(doc_id, F.coalesce("text", F.lit(""))).alias("_row_key"))
    keys = ["_row_id", "_row_key"]
    if extra.count() <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(extra), keys, "left")
    bit = F.shiftrightunsigned("_row_key", 64 - MARK_BITS)
    row, spot = F.shiftrightunsigned(bit, ROW_BITS).alias("_mark"), bit.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    bits = extra.select(row, spot.alias("_spot")).groupBy("_mark").agg(F.bitmap_construct_agg("_spot").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (spot % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = keyed.withColumn("_mark", row).join(F.broadcast(bits), "_mark", "left").withColumn("_hit", hit).drop("_mark", "_bits")  # at most 2 ** (MARK_BITS - ROW_BITS) rows
    surely = marked.filter(~F.col("_hit")).drop("_hit").withColumn("told", F.lit(None).cast(extra.schema["told"].dataType))
    return surely.unionByName(marked.filter("_hit").drop("_hit").join(extra, keys, "left"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base (FOUND) and terms (start, end, share) of every row.

    Null texts are empty and have no spans. Repeated rows repeat; a null doc_id stays null. Where several
    kinds overlap, all are reported. Other columns of docs are not read.
    """
    found = _found(docs)
    extra = terms_by_row(found, _texts(docs))
    rows = found.withColumns({"_row_id": F.coalesce("doc_id", F.lit(0)), "_row_key": F.col("row_key")})
    # Only rows that are told of words are read again.
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    told = _told(narrow, extra).filter(F.col("told").isNotNull()).dropDuplicates(["_row_id", "_row_key"])
    marked = durable(told.select("_row_id", "_row_key", term_spans(F.col("text"), F.col("told")).alias("terms")))
    return rows.join(small(marked), ["_row_id", "_row_key"], "left").select("doc_id", "base", F.coalesce("terms", F.array().cast(TERMS)).alias("terms"))


def listed(all_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with spans replaced in `text` by [KIND], revealing words by [TERM] or by nothing, and n_chars set to the new length.

    Overlapping spans are replaced once, by what starts first. All other columns and all rows stay; a null
    text stays null. Texts are read twice; where more than BROADCAST_ROWS rows have revealing words, the texts of
    those rows, and of the few that share a bit with them, are shuffled, and no others.
    """
    extra = terms_by_row(_found(docs), _texts(docs))
    text = F.coalesce("text", F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    marked = _told(docs.select(whole, "text", "doc_id"), extra, "_row")
    puts = "array<struct<start:int,end:int,put:string>>"
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    terms = F.transform(term_spans(text, F.col("told")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= REMOVE, "").otherwise("[TERM]").alias("put")))
    ordered = marked.withColumn("_cuts", F.array_sort(F.concat(base.cast(puts), terms.cast(puts))))

    def pieces(before: Column) -> Column:
        """Where a span starts behind all ends before it: the text up to it and what is put for it; at last the rest."""
        piece = lambda of: lambda s, at: F.when(s["start"] >= at, F.concat(cut(of, at, s["start"] - at), s["put"])).otherwise("")
        last = F.array_max(F.transform("_cuts", lambda s: s["end"]))
        put = let(blocks(text), lambda of: F.array_join(F.zip_with("_cuts", before, piece(of)), ""))
        return F.concat(put, F.substring(text, last + 1, F.length(text)))

    # Worked out only where something is cut.
    clean = let(running(F.transform("_cuts", lambda s: s["end"]), lambda a, b: F.greatest(a, b)), pieces)
    same = F.size("_cuts") == 0
    new = ordered.withColumn("text", F.when(same, F.col("text")).otherwise(clean))
    count = F.when(same, F.col("_row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    put = {"text": F.col("text"), "n_chars": count}
    return new.select(*[put.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
