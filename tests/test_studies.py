import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import answers as an
from lectern.operators import images, splits
from lectern.operators import predictions as pr
from lectern.operators import questions as qs
from lectern.operators.ordering import ranked
from lectern.plans import study_queries
from lectern.streaming import monitoring as mo

PASSAGE = "Anti VEGF treatment reduces macular thickness in most eyes within three months of the first injection given"


def reasons(spark, question, answer="It lowers fluid volume substantially", accepted=()):
    row = spark.createDataFrame([(question, answer, PASSAGE, list(accepted))], "q string, a string, p string, s array<string>")
    return row.select(qs.problems(F.col("q"), F.col("a"), F.col("p"), F.col("s"))).first()[0]


def test_question_rules(spark):
    good = "Which therapy class shrinks retinal swelling?"
    assert reasons(spark, good) == []
    assert reasons(spark, "What did the authors find about swelling?") == ["refers to its source"]
    assert "empty" in reasons(spark, " ")
    assert any("copies 6" in r for r in reasons(spark, "Does VEGF treatment reduces macular thickness in most cases?"))
    assert reasons(spark, "What causes swelling, and why does it matter?") == ["asks two questions"]
    assert reasons(spark, good, accepted=["Which therapy class shrinks retinal swelling quickly?"]) == ["near-duplicate of an earlier question"]
    assert reasons(spark, "What does the patient need?") == ["built on one patient or case"]
    assert reasons(spark, good, "This therapy class shrinks retinal swelling") == ["answer repeats the question"]


def test_answer_sentences(spark):
    row = spark.createDataFrame([(["anti  VEGF treatment"], ["not there"], [])], "a array<string>, b array<string>, c array<string>")
    assert tuple(row.select(*[qs.verbatim(F.col(c), F.lit(PASSAGE)) for c in "abc"]).first()) == (True, False, False)
    assert row.select(qs.about_one_study(F.array(F.lit("Our patients improved.")))).first()[0]
    assert row.select(qs.stating(F.array(F.lit("Retinal fluid resolves."), F.lit("Background words only here.")), F.lit("retinal fluid resolves quickly"))).first()[0] == ["Retinal fluid resolves."]


def test_similar_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"word{w}" for w in rng.choice(12, 6, replace=False)) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    pairs, members = qs.similar_pairs(rows, "id", "t")
    sets = {}
    for i, t in enumerate(texts):
        if t:
            sets.setdefault(frozenset(t.split()), i)
    want = {(a, b) for s, a in sets.items() for u, b in sets.items() if a < b and len(s & u) / len(s | u) >= 0.6}
    assert {(r.a, r.b) for r in pairs.collect()} == want and members.count() == 60


def candidates(spark, n=300):
    return spark.createDataFrame([(i, f"P{i % 90}", f"s{i % 10}", ("mechanism", "imaging", "prognosis", "other")[i % 4]) for i in range(n)], "id int, doc_id string, subspecialty string, category string")


def test_quotas(spark):
    kinds = ["mechanism", "imaging", "prognosis", "other"]
    c = candidates(spark)
    limits = qs.quotas(20, kinds, caps={"mechanism": 4}, floors={"imaging": 5, "prognosis": 5})
    taken = c.join(qs.accept(c, 20, limits, "id"), "id").collect()
    count = lambda k: {v: sum(r[k] == v for r in taken) for v in {r[k] for r in taken}}
    assert len(taken) == 20 and len({r.doc_id for r in taken}) == 20 and max(count("subspecialty").values()) <= 4
    assert count("category")["mechanism"] <= 4 and count("category")["imaging"] >= 5 and count("category")["prognosis"] >= 5
    with pytest.raises(ValueError):
        qs.quotas(5, kinds, floors={"imaging": 4, "prognosis": 4})


def test_deal_and_refine(spark):
    rows = spark.createDataFrame([(i, f"c{i % 5}", f"s{i % 7}") for i in range(75)], "id int, category string, subspecialty string")
    sizes, strata = {"train": 10, "validation": 40, "test": 25}, ["category", "subspecialty"]
    dealt = qs.deal(rows, sizes, "id", strata)
    fine = qs.refine(dealt, "id", strata).toPandas()
    assert fine["split"].value_counts().to_dict() == sizes and fine["id"].nunique() == 75
    cells = lambda d: d.groupby([*strata, "split"]).size().rename("n").reset_index()
    assert qs.unevenness(cells(fine), strata) <= qs.unevenness(cells(dealt.toPandas()), strata)
    for c, part in fine.groupby("category"):
        for s, n in sizes.items():
            assert abs((part["split"] == s).sum() - len(part) * n / 75) <= 1.5, c
    with pytest.raises(ValueError):
        qs.deal(rows.limit(74), sizes, "id", strata)


def swaps_of(cells, strata):
    wide = cells.pivot_table(index=strata, columns="split", values="n", aggfunc="sum", fill_value=0)
    return wide, qs.Swaps([np.unique(wide.index.get_level_values(s), return_inverse=True)[1] for s in strata], wide.to_numpy(np.int64, copy=True))


def random_cells(rng, values, splits="xyz", most=4):
    keys = [(f"c{rng.integers(values)}", f"s{rng.integers(values)}", s) for _ in range(values * 3) for s in splits]
    return pd.DataFrame([(*k, int(rng.integers(0, most))) for k in dict.fromkeys(keys)], columns=["c", "s", "split", "n"])


def test_swaps_find_what_all_pairs_find():
    """Where no swap is found, no pair of cells could be swapped for the better; every swap lowers the unevenness."""
    rng = np.random.default_rng(7)
    for _ in range(25):
        wide, swaps = swaps_of(random_cells(rng, 4), ["c", "s"])
        off = lambda: sum(np.abs(o).sum() for o in swaps.off)  # noqa: E731, B023
        before = off()
        swaps.run()
        assert off() <= before + 1e-9 and (swaps.n.sum(axis=0) == wide.to_numpy().sum(axis=0)).all() and (swaps.n.sum(axis=1) == wide.to_numpy().sum(axis=1)).all()
        best = off()
        for x in range(len(wide)):
            for y in range(len(wide)):
                for a in range(3):
                    for b in range(3):
                        if x != y and a != b and swaps.n[x, a] > 0 and swaps.n[y, b] > 0:
                            swaps.swap(a, b, x, y)
                            assert off() >= best - 1e-9
                            swaps.swap(b, a, x, y)


def test_ten_thousand_strata_in_seconds():
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(f"c{i % 100}", f"s{i // 100}", split, int(rng.integers(0, 5))) for i in range(10_000) for split in "xyz"], columns=["c", "s", "split", "n"])
    _, swaps = swaps_of(cells, ["c", "s"])
    start, before = time.time(), sum(np.abs(o).sum() for o in swaps.off)
    swaps.run()
    assert time.time() - start < 60 and sum(np.abs(o).sum() for o in swaps.off) < 0.2 * before


def test_neighbours_across_ranges(spark):
    rng = np.random.default_rng(3)
    score = np.round(rng.random(3_000), 4)
    rows = pd.DataFrame({"c": np.where(np.arange(3_000) < 2_500, "hot", "cold"), "s": score})
    rows.loc[0, "s"], rows.loc[2_999, "c"] = np.nan, "single"
    want = {}
    for c, part in rows.groupby("c"):
        x = np.unique(part["s"].dropna())
        gaps = np.round(np.diff(x), 6)
        want[c] = (float(gaps.max()), float(x[gaps.argmax()])) if len(gaps) else (None, None)
    given = spark.createDataFrame([(c, None if s != s else float(s)) for c, s in rows.itertuples(index=False)], "c string, s double")
    got = {r.c: r for r in pr.largest_gap(given, "c", "s").collect()}
    assert {c: (r.gap, r.starts) for c, r in got.items()} == want
    assert got["hot"].unsure == int(((rows["c"] == "hot") & (rows["s"] > 0.3) & (rows["s"] < 0.7)).sum())


def test_gold_chunks(spark):
    said = "the quick brown fox jumps over the lazy dog again today"
    words = said.split()
    def run(*texts):
        q = spark.createDataFrame([(1, "P", [said])], "question_id int, source_doc_id string, sentences array<string>")
        c = spark.createDataFrame([("fixed", "P", i, t) for i, t in enumerate(texts)], "strategy string, doc_id string, chunk_index int, text string")
        return sorted((r.chunk_index, r.match) for r in qs.gold_chunks(q, c).collect())
    assert run("none of it", f"x {said.upper()} y") == [(1, "exact")]
    assert run(" ".join(words[:8]), "tail " + " ".join(words[8:])) == [(0, "split")]
    assert run(" ".join(words[:6]), " ".join(words[4:9])) == [(0, "split"), (1, "split")]


def test_ranks_are_exact_and_seeded(spark):
    rows = spark.range(500).withColumn("by", F.col("id") % 3)
    one, two = (sorted(map(tuple, ranked(rows.repartition(n), "id", 5).collect())) for n in (1, 7))
    assert one == two and sorted(r[-1] for r in one) == list(range(1, 501))


def test_splits(spark):
    rows = spark.createDataFrame([(f"CNV-{p}-{s}.jpeg", p) for p in range(40) for s in range(3)], "name string, patient int")
    out = splits.group_split(rows, "patient", 0.1)
    got = splits.leakage(out.filter("split = 'train'"), out.filter("split = 'val'"), "patient").first()
    assert tuple(got) == (36, 4, 0, 0.0) and out.count() == 120
    names = rows.limit(1).select(*splits.parse_name(F.col("name")).values(), splits.name_label(F.col("name")), splits.label_id(F.lit("DRUSEN")), splits.label_id(F.lit("x"))).first()
    assert tuple(names) == ("CNV", "0", "0", "CNV", 2, None)


def test_predictions_by_hand(spark):
    rows = spark.createDataFrame([("A", "A")] * 3 + [("A", "B"), ("B", "B"), ("B", "A")], "truth string, pred string").withColumn("set", F.lit("s"))
    r = pr.metrics(rows, ["set"], ["A", "B", "C"]).first()
    assert (r.accuracy, r.recall_A, r.recall_B, r.recall_C) == (round(4 / 6, 6), 0.75, 0.5, 0)
    assert r.macro_f1 == pytest.approx((0.75 + 0.5 + 0) / 3, abs=1e-6)
    p = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>").select(pr.argmax(F.col("l"), ["a", "b", "c"]), pr.argmax(F.col("l"), ["a", "b", "c"], 1), F.aggregate(pr.softmax(F.col("l")), F.lit(0.0), lambda s, x: s + x)).first()
    assert p[0] == "b" and p[1] == "c" and p[2] == pytest.approx(1, abs=1e-3)


def scan(h=496, w=768):
    y, x = np.indices((h, w))
    middle = h / 2 + (x - w / 2) ** 2 / 2500
    image = np.where(np.abs(y - middle) < 40, 190, 20).astype(np.uint8)
    image[:30, :60] = 255
    return image


def test_images(spark):
    image = scan()
    assert images.border_white(image.astype(float)).sum() == 30 * 60
    rows = spark.createDataFrame([("a", 768, 496, bytearray(image.tobytes())), ("b", 3, 3, bytearray(b"xx")), ("c", 1, 1, None)], "path string, width int, height int, pixels binary")
    got = {r.path: r for r in images.preprocess_images(rows, images.PreConfig(384, 256), ["path"]).collect()}
    frame = np.frombuffer(got["a"].pixels, np.uint8).reshape(256, 384)
    assert got["a"].tag == "crop_curv_squish_384x256" and got["b"].pixels is None and got["c"].pixels is None
    centre = (frame * np.arange(256)[:, None]).sum(0) / frame.sum(0)
    assert np.ptp(centre[20:-20]) < 12 and frame.max() > 240
    ramp = np.tile(np.linspace(0, 255, 300), (100, 1))
    boxed = images.fit_frame(ramp, 384, 256, "letterbox")
    assert np.flatnonzero(boxed.any(axis=1))[[0, -1]].tolist() == [64, 191]
    with pytest.raises(ValueError):
        images.PreConfig(fit="other")


DOSED = "Patching comes first [4]. Drops of 0.01 ml were enough [5]! Check again later.\n\nSteps:\n- Start with 250 mcg at night.\n- Look for redness, then 3,5 mg.\n- Stop when it clears."
FREE = "Pressure stayed under 18 mmHg in 9 of 10 eyes.\n\n\n\n- Nothing else changed."


def test_doses(spark):
    rows = spark.createDataFrame([(DOSED,), (FREE,), ("Give 40 IU twice.",)], "t string").coalesce(1)
    got = [tuple(r) for r in rows.select(an.without_doses(F.col("t")), an.dose_stated(F.col("t"))).collect()]
    assert got[0] == ("Patching comes first [4]. Check again later.\n\nSteps:\n- Stop when it clears.\n\n" + an.NOTE, True)
    assert got[1] == (FREE, False) and got[2] == (an.NOTE, True)


SAID = "Rinse the eye well. Then use 12 mg of it. 1. Rest\n2. Take 0.3 ml more.\n\nCall if it hurts! Do you see 4 IU here? No end"
SHOWN = ["Rinse the eye well.", " 1. Rest\n", "\n", "\n", "Call if it hurts!", " No end"]


def pieces_of(text, width, seed):
    cut = [(i // width, "text", text[i : i + width]) for i in range(0, len(text), width)]
    return random.Random(seed).sample([*cut, (len(cut), "flush", "")], len(cut) + 1)


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_pieces_in_any_order(spark, width):
    whole = None
    for seed in range(5):
        draft, out = mo.Draft(), []
        for piece in pieces_of(SAID, width, seed):
            draft = mo.Draft.load(draft.stored())
            out += draft.arrive(*piece)
            assert draft.arrive(*piece) == []  # read or waiting already
        assert "".join(out) == SAID and not draft.held and not draft.waiting
        whole = whole or out
        assert out == whole
    kept = spark.createDataFrame(list(enumerate(whole)), "no int, text string").select("no", an.without_doses(F.col("text"), note=False).alias("text")).filter("text <> ''").orderBy("no").collect()
    assert [r.text for r in kept] == SHOWN


def test_gaps_are_given_up_and_late_pieces_shown():
    draft = mo.Draft()
    assert draft.arrive(0, "text", "One. ") == ["One."]
    assert draft.arrive(3, "text", "Four. ") == [] and draft.arrive(5, "text", "Six. ") == []
    assert "".join(draft.give_up()) == " Four. Six." and draft.missed == [(1, 3), (4, 5)]
    assert draft.arrive(2, "text", "Three. ") == [" ", "Three."] or draft.held == " "
    assert draft.arrive(2, "text", "Three. ") == [] and draft.missed == [(4, 5), (1, 2)]
    assert draft.arrive(6, "reset", "") == [] and draft.held == ""


@pytest.mark.parametrize("before", [99_996, 1_000_000])
def test_no_amount_is_shown_in_halves(before):
    draft = mo.Draft()
    shown = draft.arrive(0, "text", "x" * before + " take 0.5 ")
    shown += draft.arrive(1, "text", "mg daily. ") + draft.arrive(2, "text", "Then rest. ") + draft.arrive(3, "flush", "")
    assert shown == ["x" * before + " take 0.5 mg daily.", " Then rest.", " "]


def test_long_drafts_take_linear_time():
    draft, start = mo.Draft(), time.time()
    for k in range(20_000):
        draft.arrive(k, "text", "no end yet ")
    assert time.time() - start < 20


def test_dose_stream_out_of_order(spark, tmp_path):
    rows = [("s", *p) for p in pieces_of(SAID, 7, 1)] + [("t", *p) for p in pieces_of("Only 5 mg.", 2, 2)] + [("u", 1, "text", "Held back. ")]
    schema = "session string, seq int, kind string, text string"
    for k in range(0, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    mo.drain(mo.clean_stream(stream).writeStream.format("memory").queryName("clean").outputMode("append").option("checkpointLocation", str(tmp_path / "c")), spark)
    got = sorted((r.session, r.no, r.text) for r in spark.table("clean").collect())
    assert [t for s, _, t in got if s == "s"] == SHOWN and {s for s, *_ in got} == {"s"}


def test_daily_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("score"))
    events.write.parquet(str(tmp_path / "in"))
    stream = mo.daily_score_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "event_type")
    q = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, an.daily_scores(events, "event_type").collect()))


def test_ingest_adds_each_passage_once(spark, tmp_path):
    from lectern.functions.plugins import embedder

    schema, path = "doc_id string, chunk_index int, text string", str(tmp_path / "index")
    run = lambda: mo.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), embedder(), path, str(tmp_path / "c"), buckets=4).awaitTermination(120)
    keys = lambda: sorted((r.doc_id, r.chunk_index) for r in mo.read_ingested(spark, path).collect())
    for part in ([("a", 0, "x"), ("a", 1, "y")], [("a", 1, "y"), ("b", 0, "z"), ("b", 0, "z")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert keys() == [("a", 0), ("a", 1), ("b", 0)]
    # A batch that broke off after its rows were written is not in the ledger: unseen by readers, and written anew.
    torn = mo.read_ingested(spark, path).limit(1).drop("batch", "bucket")
    torn.write.parquet(f"{path}/parts/batch=2/bucket=0")
    assert keys() == [("a", 0), ("a", 1), ("b", 0)]
    spark.createDataFrame([("c", 0, "new")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert keys() == [("a", 0), ("a", 1), ("b", 0), ("c", 0)] and mo.finished(spark, path) == {0, 1, 2}
    plan = mo.held(spark, path, 2, [1])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0] and "embedding" not in plan.split("ReadSchema: ")[1]


def test_conversations(spark):
    m = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)], "session int, turn int, role string, content string")
    last = {r.turn: (r.earlier, r.n_earlier) for r in an.earlier_turns(m).collect()}
    assert last[0] == ("", 0) and last[6] == ("user: m2\nassistant: m3\nuser: m4\nassistant: m5", 6)
    assert an.ends_with_user(m).first().valid


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_long_sessions_are_cut_into_ranges(spark, partitions):
    """A session over many ranges gives what the plain walk gives."""
    rng = random.Random(5)
    rows = [(s, t, rng.choice(["user", "assistant", "assistant"]), f"m{t}") for s, n in ((1, 600), (2, 3), (3, 40), (4, 1)) for t in range(n)]
    m = spark.createDataFrame(rows, "session int, turn int, role string, content string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = {(r.session, r.turn): (r.earlier, r.n_earlier) for r in an.earlier_turns(m).collect()}
        calls = {(r.session, r.turn): (r.question_no, r.allowed) for r in an.search_calls(m, F.col("role") == "assistant", 2).collect()}
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    seen, want, want_calls = {}, {}, {}
    for s, t, role, text in rows:
        own, asked, made = seen.setdefault(s, ([], [0], [0]))
        if role == "user":
            want[s, t] = ("\n".join(own[-4:]), len(own))
            asked[0], made[0] = asked[0] + 1, 0
        else:
            made[0] += 1
            want_calls[s, t] = (asked[0], made[0] <= 2)
        own.append(f"{role}: {text}")
    assert told == want and calls == want_calls


def test_a_stack_of_scans_gives_what_each_gives_alone():
    rng = np.random.default_rng(3)
    y, x = np.arange(40)[:, None], np.arange(52)
    arches = [np.where(abs(y - 15 - k - (x - 26) ** 2 / 90) < 4, 170.0, 15.0) for k in range(5)]
    cornered = [np.where((y < 2 * k) & (x < 3 * k), 255.0, arches[k]) for k in range(5)]
    stack = np.stack([*arches, *cornered, *rng.integers(0, 256, (4, 40, 52)).astype(float), *np.where(rng.random((4, 40, 52)) < 0.7, 255.0, 30.0), np.zeros((40, 52))])
    assert (images.border_white(stack) == np.stack([images.border_white(s) for s in stack])).all()
    for fit in images.FITS:
        for crop in (True, False):
            config = images.PreConfig(24, 20, crop=crop, fit=fit)
            assert (np.round(255 * images.preprocess(stack, config)) == np.round(255 * np.stack([images.preprocess(s, config) for s in stack]))).all()


def test_scans_of_several_sizes_and_damaged_ones(spark):
    rows = [("a", 4, 3, bytes(range(12))), ("b", 3, 4, bytes(range(12))), ("c", 4, 3, b"short"), ("d", None, 3, bytes(12)), ("e", 4, 3, None), ("f", 4, 3, bytes(range(12))), ("g", 0, 0, b"")]
    scans = spark.createDataFrame(rows, "name string, width int, height int, pixels binary").coalesce(1)
    got = {r["name"]: r.pixels for r in images.preprocess_images(scans, images.PreConfig(4, 4, crop=False), ["name"]).collect()}
    assert {n for n, p in got.items() if p} == {"a", "b", "f"} and got["a"] == got["f"] != got["b"] and set(got) == set("abcdefg")
    told = {r["name"]: r.n_rows for r in images.step_report(scans, images.PreConfig(4, 4, crop=False), ["name"]).collect()}
    assert told == {"a": 3, "b": 4, "c": None, "d": None, "e": None, "f": 3, "g": None}


def test_scans_are_dealt_to_all_cores(spark, sf):
    """The parts are one row group, which would be one core's work."""
    assert study_queries._drawn(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_similarity_that_equals_its_limit_is_reached(spark, tmp_path):
    """3 / sqrt(18 * 50 / 9) and the like are 0.3, which unit vectors of single precision miss."""
    pairs = [("w14 w100 w34 w34 w34 w24 w24 w24", "w14 w14 w100"), ("w14 w100 w34 w34 w24 w24", "w14 w100 w100 w372 w362 w362"), ("w14", "w100")]
    rows = [(i, turn, "user", text) for i, both in enumerate(pairs) for turn, text in enumerate(both)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = study_queries.QUERIES["q8_relevance"](spark, str(tmp_path)).collect()
    assert {r.id: r.relevant for r in got} == {0: True, 1: True, 2: False}


def test_a_drained_stream_waits_for_pieces_it_has_not_read(spark, tmp_path):
    """The first piece is in the last file, and every batch lasts longer than the limit."""
    said = ["One is whole. Tw", "o is cut. Thr", "ee ends here."]
    schema = "session string, seq int, kind string, text string"
    for seq in (2, 1, 0):
        rows = [("a", seq, "text", said[seq])] + ([("a", 3, "flush", "")] if seq == 2 else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    def shown(idle):
        out = str(tmp_path / f"out{idle}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        mo.drain(mo.clean_stream(stream, idle=idle).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"c{idle}")), spark)
        return [r.text for r in spark.read.schema("session string, no bigint, text string").parquet(out).orderBy("no").collect()]

    whole = ["One is whole.", " Two is cut.", " Three ends here."]
    assert shown(None) == whole and shown(1) != whole


def test_signatures_differ_in_no_more_bits_than_sets_in_words(spark):
    rng = random.Random(6)
    sets = [(i, [rng.getrandbits(63) - (1 << 62) for _ in range(rng.randint(1, 300))]) for i in range(12)]
    sets += [(100 + i, own[: len(own) // 2] + [rng.getrandbits(60)]) for i, own in sets]
    signed = spark.createDataFrame(sets, "i int, h array<bigint>").select("i", qs.signature(F.col("h"), 4).alias("s"))
    both = signed.crossJoin(signed.withColumnsRenamed({"i": "j", "s": "t"})).select("i", "j", qs.bits_apart(F.col("s"), F.col("t")).alias("apart")).collect()
    held = {i: set(h) for i, h in sets}
    assert all(r.apart <= len(held[r.i] ^ held[r.j]) for r in both) and sum(r.apart > 60 for r in both) > 100


def test_similar_pairs_of_many_candidates(spark):
    """60 texts share a rare word in their first places with many others, and few are alike: no pair may be ruled out wrongly."""
    rng = random.Random(8)
    words = [f"word{k}" for k in range(60)]
    rows = spark.createDataFrame([(i, " ".join(rng.sample(words, 24))) for i in range(60)], "id bigint, t string")
    pairs, _ = qs.similar_pairs(rows, "id", "t")
    text = {r.id: set(r.t.split()) for r in rows.collect()}
    want = {(a, b) for a in text for b in text if a < b and len(text[a] & text[b]) >= 0.6 * len(text[a] | text[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want
