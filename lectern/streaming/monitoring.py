"""Streams: sentence-wise cleaned answers, daily judge scores, and incremental index ingest."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.answers import MARKER, daily_scores, without_doses
from lectern.operators.durable import durable
from lectern.sources.index_store import KEYS, exists, missing

#: A list marker at the start of a sentence, and where a sentence ends.
ITEM, SENTENCE_END = re.compile(MARKER.removeprefix("^")), re.compile(r"[.!?](?=\s)|\n")


@dataclass
class Draft:
    """What is known of a session's answer: text that ends in no sentence yet, pieces that came too early, and numbers that were given up."""

    held: str = ""
    seen: int = 0  # signs of `held` that hold no end
    due: int = 0
    shown: int = 0
    since: int = 0  # when the piece that is due was first missed; 0 if none is
    waiting: dict[int, tuple[str, str]] = field(default_factory=dict)
    missed: list[tuple[int, int]] = field(default_factory=list)

    def arrive(self, seq: int, kind: str, text: str | None) -> list[str]:
        """Sentences that a piece brings to an end. A piece that was given up is read when it comes; one that was read already is passed over."""
        gap = next((g for g in self.missed if g[0] <= seq < g[1]), None)
        if gap:
            self.missed.remove(gap)
            self.missed += [g for g in ((gap[0], seq), (seq + 1, gap[1])) if g[0] < g[1]]
            return self._read(kind, text)
        if seq >= self.due:
            self.waiting.setdefault(seq, (kind, text or ""))
        return self._ready()

    def give_up(self) -> list[str]:
        """Sentences of the pieces that wait, over all gaps, and what is left."""
        out = []
        for seq in sorted(self.waiting):
            if seq > self.due:
                self.missed.append((self.due, seq))
            self.due = seq
            out += self._ready()
        return out

    def _ready(self) -> list[str]:
        out = []
        while self.due in self.waiting:
            out += self._read(*self.waiting.pop(self.due))
            self.due += 1
        return out

    def _read(self, kind: str, text: str | None) -> list[str]:
        if kind == "reset":
            self.held, self.seen = "", 0
            return []
        self.held += text or ""
        out = []
        start = 0
        while True:
            item = ITEM.match(self.held, start)
            end = SENTENCE_END.search(self.held, max(item.end() if item else start, self.seen))
            if not end:
                break
            out.append(self.held[start : end.end()])
            start = self.seen = end.end()
        self.held = self.held[start:]
        self.seen = max(0, len(self.held) - 1)  # the last sign may end a sentence once white space follows
        if kind == "flush" and self.held:
            out.append(self.held)
            self.held, self.seen = "", 0
        return out

    def stored(self) -> str:
        return json.dumps(asdict(self) | {"waiting": list(self.waiting.items())})

    @classmethod
    def load(cls, text: str) -> Draft:
        known = json.loads(text)
        return cls(**known | {"waiting": {int(k): tuple(v) for k, v in known["waiting"]}, "missed": [tuple(g) for g in known["missed"]]})


def clean_stream(pieces: DataFrame, idle: int | None = 60_000) -> DataFrame:
    """(session, no, text): whole sentences without those that state an amount, from pieces (session, seq, kind, text), in any order of arrival.

    seq counts a session's pieces from 0. A piece that comes too early is held until those before it are
    there, over as many batches as that takes; one that is missed for `idle` milliseconds is given up. A
    sentence is held until it ends, however long it grows, so that no amount is shown in halves. kind is
    text, reset (what is held is dropped) or flush (the answer ends). A session that is idle for so long is flushed and forgotten. The
    sentences, numbered by `no`, do not depend on how the pieces were dealt into batches.
    Without `idle` nothing is given up: what a stream over stored files has not read yet is not missing, however long its batches take.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        draft = Draft.load(state.get[0]) if state.exists else Draft()
        out: list[str] = []
        ended = state.hasTimedOut
        if ended:
            out += draft.give_up() + draft._read("flush", "")
        else:
            rows = pd.concat(parts).sort_values("seq")
            for seq, kind, text in zip(rows["seq"], rows["kind"], rows["text"], strict=True):
                out += draft.arrive(int(seq), kind, text)
            now = state.getCurrentProcessingTimeMs()
            draft.since = 0 if not draft.waiting else draft.since or now
            if idle is not None and draft.waiting and now - draft.since >= idle:
                out += draft.give_up()
                draft.since = 0
        first = draft.shown
        draft.shown += len(out)
        if ended:
            state.remove()
        else:
            state.update((draft.stored(),))
            if idle is not None:
                state.setTimeoutDuration(idle)
        if out:
            yield pd.DataFrame({"session": [key[0]] * len(out), "no": range(first, draft.shown), "text": out})

    sentences = pieces.groupBy("session").applyInPandasWithState(step, "session string, no bigint, text string", "draft string", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
    return sentences.withColumn("text", without_doses(F.col("text"), note=False)).filter("text <> ''")


def drain(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Runs a stream over what is there and waits for its end. Batches without data, which timers ask for again and again, are left out."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        query = writer.trigger(availableNow=True).start()  # a stream keeps the settings it was started with
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def daily_score_stream(scored: DataFrame, *by: str, late: str = "1 day") -> DataFrame:
    return daily_scores(scored.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), *by)


#: Parts of a streamed index, by the hash of a passage's key.
BUCKETS = 64


def ingest(passages: DataFrame, embed, path: str, checkpoint: str, buckets: int = BUCKETS):
    """A streaming query that embeds and appends the passages that the index at `path` lacks, each once.

    Every batch has a folder of its own, divided by buckets of the key, and a line in a ledger once it is whole.
    A batch looks for its keys in their buckets of the finished batches alone. One that is in the
    ledger is passed over; one that broke off is written anew in its folder. `read_ingested` reads finished batches.
    """
    spark = passages.sparkSession
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        if number in finished(spark, path):
            return
        once = durable(batch.dropDuplicates(KEYS).withColumn("bucket", bucket))
        own = [r[0] for r in once.select("bucket").distinct().collect()]  # at most `buckets`
        known = held(spark, path, number, own)
        new = once if known is None else missing(once, known, KEYS)
        new.withColumn("embedding", embed(F.col("text"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/parts/batch={number}")
        spark.createDataFrame([(number,)], "batch bigint").coalesce(1).write.mode("append").parquet(f"{path}/ledger")

    return passages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(spark: SparkSession, path: str) -> set[int]:
    """Numbers of the batches in the ledger."""
    return {r[0] for r in spark.read.parquet(f"{path}/ledger").collect()} if exists(spark, f"{path}/ledger") else set()


def held(spark: SparkSession, path: str, before: int, buckets: list[int]) -> DataFrame | None:
    """Keys in some buckets of the finished batches before one; the other buckets are not listed or read."""
    if not any(b < before for b in finished(spark, path)):
        return None
    rows = read_ingested(spark, path)
    return rows.filter(F.col("batch") < before).filter(F.col("bucket").isin(buckets)).select(*KEYS)


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The passages of the finished batches, with batch and bucket."""
    return spark.read.option("basePath", f"{path}/parts").parquet(f"{path}/parts").filter(F.col("batch").isin(sorted(finished(spark, path))))
