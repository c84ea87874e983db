"""The pipeline's stages against plain versions on the smallest tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import quality_classifier, quality_rules, simhash
from lectern.llm.components import components


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """What each stage was given and returned."""
    folder = tmp_path_factory.mktemp("stages")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        out = spark.read.parquet(f"{folder}/{k}")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_stages_in_order_with_the_columns_of_documents(steps, spark, sf):
    assert [n for n, *_ in steps] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "pii", "best_fit_packing"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(out.columns == columns for _, _, out in steps[:-1])


def test_what_stays_is_unchanged_and_what_goes_is_rejected(steps, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k in range(3):
        _, before, after = steps[k]
        assert after.exceptAll(before).count() == 0
    machine = quality_classifier.learn(steps[0][1], labels)
    scores = {r.doc_id: r.score for r in quality_classifier.with_score(steps[0][1], machine, ["doc_id"]).collect()}
    assert {r.doc_id for r in steps[0][2].collect()} == {i for i, s in scores.items() if s >= 0.5}
    kept = {r.doc_id for r in quality_rules.apply_rules(steps[1][1], labels).filter("kept").collect()}
    assert {r.doc_id for r in steps[1][2].collect()} == kept


def test_one_of_each_near_duplicate_stays(steps):
    _, before, after = steps[2]
    sets = {r.doc_id: frozenset(simhash.shingle_hashes(r.text, 5).tolist()) for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert all(any(alike(i, j) >= 0.6 for j in sets if j < i) for i in sets.keys() - kept)
    close = [(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.9]
    assert sum(a in kept and b in kept for a, b in close) <= 0.02 * len(close)


def test_no_personal_data_is_left(steps):
    _, before, after = steps[3]
    assert after.count() == before.count()
    for r in after.collect():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text) and r.n_chars == len(r.text)


def test_every_document_is_packed(steps):
    _, before, after = steps[4]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sizes.filter("n <> end or n > 2048").count() == 0


def test_run_gives_the_last_stage(spark, sf, steps):
    assert corpus_pipeline.run(spark, sf).count() == steps[4][2].count()


def test_near_duplicates_are_those_of_four_fifths_and_no_others(spark):
    rng, rows, pairs = random.Random(9), [], []
    for changed in (4, 5, 6, 7):  # 196 shingles a side: similarities 0.81, 0.77, 0.73 and 0.70 where no changes overlap
        for _ in range(100):
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            other = words.copy()
            for place in rng.sample(range(200), changed):
                other[place] = f"n{rng.randrange(10**6)}"
            pairs.append((len(rows), len(rows) + 1))
            rows += [" ".join(words), " ".join(other)]
    sets = [set(simhash.shingle_hashes(x, 5).tolist()) for x in rows]
    near = {b for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert 100 < len(near) < 300
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.keep_one(docs, 5).collect()} == set(range(len(rows))) - near


@pytest.mark.parametrize("short, square", [(256, 4_096), (1, 2)])
def test_near_duplicates_that_only_chains_connect(spark, monkeypatch, short, square):
    """As short lists, and as long ones cut into squares."""
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    monkeypatch.setattr(simhash, "LIST_ROWS", square)
    words = [f"w{i}" for i in range(400)]
    rows = [" ".join(words[s : s + 200]) for s in (0, 20, 40, 60, 80, 130, 195)] + [" ".join(words[:200]) + " more"]
    rows += [" ".join(["a line that all of them hold in common with others"] + [f"v{k}x{i}" for i in range(20)]) for k in range(60)]
    sets = [set(simhash.shingle_hashes(x, 5).tolist()) for x in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    least = {min(i for i, r in enumerate(root) if r == x) for x in root}
    assert 60 < len(least) < len(rows) - 3
    order = random.Random(3).sample(range(len(rows)), len(rows))
    docs = spark.createDataFrame([(i, rows[i]) for i in order], "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == least


def test_candidates_come_from_places_of_a_wide_simhash(spark):
    """Each place is a majority, alike sets share a list and enough places, and the index holds what the rule says."""
    rng, rows = random.Random(5), []
    for size in (5, 9, 40, 104, 131, 140, 260, 300, 1100):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            cut, more = rng.randint(0, size // 7), rng.randint(0, size // 7)
            rows += [" ".join(words), " ".join(words[cut:] + [f"n{rng.randrange(10**6)}" for _ in range(more)])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    held = {r.doc_id: r for r in simhash.indexed(docs, 5).collect()}
    sets = [np.unique(simhash.shingle_hashes(x, 5)) for x in rows]
    for own in sets[::7]:
        size = simhash.n_places(len(own))
        major, times = simhash.wide_fingerprint(own, size)
        dealt = [[int(h) for h in own if int(h) * size >> 64 == p] for p in range(size)]
        assert times.tolist() == [len(x) for x in dealt]
        assert all(int(major[p]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for p, x in enumerate(dealt) if x)
    pairs = [(a, a + 1) for a in range(0, len(rows), 2) if simhash.alike(sets[a], sets[a + 1])]
    crossing = 0
    for a, b in pairs:
        size, apart = simhash.n_places(min(len(sets[a]), len(sets[b]))), len(np.setxor1d(sets[a], sets[b]))
        crossing += simhash.n_places(len(sets[a])) != simhash.n_places(len(sets[b]))
        x, y = (simhash.wide_fingerprint(sets[k], size)[0] for k in (a, b))
        assert np.count_nonzero(x == y) >= size - apart > 0
        assert all(apart <= simhash.most_apart(len(sets[k]), size) < size for k in (a, b))
        assert set(held[a].lists) & set(held[b].lists)
        assert simhash.may_be_alike(held[a].n, held[a].fp, held[b].n, held[b].fp)
    assert len(pairs) > 30 and crossing
    large = [r for i, r in held.items() if r.n >= 30 and i % 2 == 0]
    assert not any(simhash.may_be_alike(a.n, a.fp, b.n, b.fp) for a in large for b in large if a.doc_id < b.doc_id)
    assert all(len(r.lists) == sum(simhash.most_apart(r.n, size) + 1 for size in simhash.widths(r.n)) for r in held.values())


def test_near_duplicates_reach_python_in_small_batches(spark, monkeypatch):
    """Whole texts and pairs of texts come in batches of bounded bytes; the session's setting stays."""

    def bounded(batches, rows=256):
        for batch in batches:
            assert batch.num_rows == 1 or batch.nbytes < 6 << 20, f"{batch.num_rows} rows, {batch.nbytes} bytes"
            yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))

    monkeypatch.setattr(simhash, "slices", bounded)
    rng, name = random.Random(2), "spark.sql.execution.arrow.maxBytesPerBatch"
    before, words = spark.conf.get(name), [f"w{rng.randrange(10**6)}" for _ in range(4_000)]
    rows = [" ".join(words[: 4_000 - k] + [f"n{rng.randrange(10**6)}" for _ in range(k)]) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").coalesce(1)
    assert [r.doc_id for r in simhash.keep_one(docs, 5).collect()] == [0]
    assert spark.conf.get(name) == before
