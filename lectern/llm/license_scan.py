"""Licence scan: ordered signature rules gated by keywords, overlaps resolved by priority and containment.

Signatures are written by hand (license_rules); names of licences in the usual phrases around them add more. A text is a sequence of lower-cased words. Every rule is a regular expression over the words joined by
single spaces and names words of which any match must hold one; the words of a text fetch the rules to run,
so most texts run none. Detections are taken by priority (then length, then place); one whose word interval
lies within that of a detection already taken is suppressed. Time is linear in a text's words and its matches.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices
from lectern.llm.license_rules import SIGNATURES

#: Phrase and label of the base.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licence names as words, with the key words of each (any match holds one of them) and its label. `?` marks words that may be missing.
NAMES = (
    ("mit", "mit", "mit"), ("expat", "expat", "mit"), ("x11", "x11", "mit"),
    ("apache( software)?( license)?( version)? 2( 0)?", "apache", "apache"), ("apache( software)?( license)?( version)? 1 1", "apache", "apache"), ("apache( software)?", "apache", "apache"), ("asl 2 0", "asl", "apache"),
    ("(gnu )?gpl ?v?2( 0)?( only)?", "gpl gpl2 gplv2", "gpl"), ("(gnu )?gpl ?v?3( 0)?( only)?", "gpl gpl3 gplv3", "gpl"), ("gplv2", "gplv2", "gpl"), ("gplv3", "gplv3", "gpl"), ("gnu gpl", "gpl", "gpl"), ("gnu general public", "gnu", "gpl"),
    ("lgpl( v?2 1)?", "lgpl", "lgpl"), ("lgplv2 1", "lgplv2", "lgpl"), ("lgplv3", "lgplv3", "lgpl"), ("gnu lesser general public", "lesser", "lgpl"), ("gnu library general public", "library", "lgpl"),
    ("agpl( v?3)?", "agpl", "agpl"), ("agplv3", "agplv3", "agpl"), ("(gnu )?affero general public", "affero", "agpl"),
    ("bsd", "bsd", "bsd"), ("bsd 2 clause", "bsd", "bsd"), ("bsd 3 clause", "bsd", "bsd"), ("2 clause bsd", "bsd", "bsd"), ("3 clause bsd", "bsd", "bsd"), ("simplified bsd", "bsd", "bsd"), ("new bsd", "bsd", "bsd"),
    ("mozilla public", "mozilla", "mpl"), ("mpl 2 0", "mpl", "mpl"), ("mpl 1 1", "mpl", "mpl"), ("eclipse public", "eclipse", "epl"), ("epl( v)? ?[12] 0", "epl epl1 epl2", "epl"),
    ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"), ("boost software", "boost", "bsl"), ("artistic", "artistic", "artistic"), ("ruby", "ruby", "ruby"), ("python software foundation", "python", "psf"), ("postgresql", "postgresql", "postgresql"),
    ("common development and distribution", "distribution", "cddl"), ("cddl", "cddl", "cddl"), ("microsoft public", "microsoft", "ms-pl"), ("european union public", "european", "eupl"), ("eupl", "eupl", "eupl"),
    ("creative commons attribution", "commons", "cc-by"), ("creative commons attribution sharealike", "commons", "cc-by-sa"), ("creative commons attribution noncommercial", "commons", "cc-by-nc"), ("creative commons zero", "commons", "cc0"),
    ("cc by", "cc", "cc-by"), ("cc by sa", "cc", "cc-by-sa"), ("cc by nd", "cc", "cc-by-nd"), ("cc by nc", "cc", "cc-by-nc"), ("cc by nc sa", "cc", "cc-by-nc-sa"), ("cc by nc nd", "cc", "cc-by-nc-nd"), ("cc0", "cc0", "cc0"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("open font", "font", "ofl"), ("open software", "open", "osl"),
)

#: Templates around a name: words, priority, confidence. A higher priority is taken first.
TEMPLATES = (
    ("spdx license identifier {}( \\d+( \\d+)?)?", 90, 0.99),
    ("licensed under( the)?( terms of)?( the)? {}( license| licence)?( version)?( \\d+( \\d+)?)?", 80, 0.95),
    ("(released|distributed|available|published|provided) under( the)?( terms of)?( the)? {}( license| licence)?( version)?( \\d+( \\d+)?)?", 70, 0.9),
    ("{} (license|licence)( version)?( \\d+( \\d+)?)?", 50, 0.8),
    ("licen[sc]e {}( \\d+( \\d+)?)?", 40, 0.6),
)

@dataclass(frozen=True)
class Rule:
    name: str
    key: str
    label: str
    priority: int
    confidence: float
    pattern: re.Pattern


@cache
def rules() -> dict[str, list[Rule]]:
    """Every signature, and every name in every template, by each of its key words."""
    made = [(t.format(f"(?:{n})"), key, label, p, c) for (t, p, c), (n, key, label) in product(TEMPLATES, NAMES)]
    lines = [re.split(r"\s*\|\s*", line, maxsplit=4) for line in SIGNATURES.strip().splitlines()]
    made += [(words, key, label, int(priority), float(confidence)) for label, priority, confidence, key, words in lines]
    by_key: dict[str, list[Rule]] = {}
    for i, (words, key, label, priority, confidence) in enumerate(made):
        rule = Rule(f"r{i:03d}", key, label, priority, confidence, re.compile(f"(?<= )(?:{words})(?= )"))
        for word in key.split():
            by_key.setdefault(word, []).append(rule)
    return by_key


#: A-Z to a-z, digits and all bytes of non-ASCII characters stay, the rest becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def places(padded: str, phrase: str, starts: list[int]) -> list[int]:
    """First words (from 0) of all places of a phrase in words that are padded by spaces, overlaps included."""
    out, at = [], padded.find(f" {phrase} ")
    while at >= 0:
        out.append(bisect_left(starts, at + 1))
        at = padded.find(f" {phrase} ", at + 1)
    return out


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that no other, taken before, contains.

    Of those taken only the ones that no later one contains are looked at: by start, their ends rise too, so
    the last that starts in time is the one that ends last.
    """
    taken: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].name)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        taken.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low:high], ends[low:high] = [start], [end]
    return sorted(taken, key=lambda d: (d[0], d[1], d[2].name))


def scan_text(text: str) -> dict:
    """n_words, base (label, place) and detections (label, rule, start, end in words, confidence) of one whole text."""
    words = text.encode().translate(WORD_BYTES).split()
    by_key = rules()
    keys = _keys().intersection(words)
    base: list[tuple[str, int]] = []
    found: list[tuple[int, int, Rule]] = []
    if keys:
        padded = f" {b' '.join(words).decode()} "
        starts = list(accumulate((len(w) + 1 for w in padded[1:-1].split(" ")), initial=1))
        base = [(label, at) for phrase, label in BASE for at in places(padded, phrase, starts)]
        for rule in {rule.name: rule for key in keys for rule in by_key.get(key.decode(), ())}.values():
            for m in rule.pattern.finditer(padded):
                start = bisect_left(starts, m.start())
                found.append((start, start + m.group().count(" ") + 1, rule))
    return {"n_words": len(words), "base": base, "detections": [(r.label, r.name, s, e, r.priority, r.confidence) for s, e, r in resolve(found)]}


@cache
def _keys() -> frozenset[bytes]:
    return frozenset(k.encode() for k in [*rules(), *(phrase.split()[0] for phrase, _ in BASE)])


RESULT = "n_words bigint, base array<struct<label:string,place:bigint>>, detections array<struct<label:string,rule:string,start:bigint,end:bigint,priority:int,confidence:double>>"


def scan(docs: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """The columns `keep`, n_words, base and detections of every row; map-only.

    Null texts are empty: no words, no detections. Repeated rows repeat; columns in `keep` with a
    result's name are replaced.
    """
    made = T.StructType.fromDDL(RESULT)
    kept = [c for c in keep if c not in made.names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_scanned_text"))
    base, detections = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [scan_text(x or "") for x in part[len(kept)].to_pylist()]
            named = lambda key, kind: pa.array([[dict(zip([f.name for f in kind.value_type], x, strict=True)) for x in f[key]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([f["n_words"] for f in found], pa.int64()), named("base", base), named("detections", detections)], names=[*kept, *made.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made.fields]))
