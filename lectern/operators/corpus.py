"""Corpus building: licences, relevance, outcomes, resume, manifest."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.markup import recovered

ARTICLE = "pmcid string, title string, doi string, license string, journal string, sections array<struct<heading:string,text:string>>"
FINAL = ("kept", "empty")
CC_URL = r"creativecommons\.org/licenses/([a-z-]+)/(\d(?:\.\d)?)"
#: Elements whose text is no prose.
FLOATS = {"xref", "fig", "table-wrap"}


def license_label(blob: Column, kind: Column | None = None) -> Column:
    """`CC BY 4.0` from a licence address, else the stated kind, else 40 characters of prose, else `unknown`."""
    cc = F.regexp_extract(blob, CC_URL, 1)
    address = F.when(cc != "", F.concat(F.lit("CC "), F.upper(cc), F.lit(" "), F.regexp_extract(blob, CC_URL, 2)))
    prose = F.nullif(F.substring(tx.node_text(blob), 1, 40), F.lit(""))
    stated = F.nullif(kind, F.lit("")) if kind is not None else F.lit(None).cast("string")
    return F.coalesce(address, stated, prose, F.lit("unknown"))


def is_permitted(label: Column, allow_noncommercial: bool = False) -> Column:
    """Creative Commons and public domain, without NoDerivatives, and without NonCommercial unless allowed."""
    up = F.upper(label)
    open_cc = up.startswith("CC ") & ~up.contains("ND") & (F.lit(allow_noncommercial) | ~up.contains("NC"))
    return F.coalesce(up.startswith("CC0") | (up == "PUBLIC-DOMAIN") | open_cc, F.lit(False))


def relevant(articles: DataFrame, journals: DataFrame) -> DataFrame:
    """Articles of whitelisted journals."""
    return articles.join(journals.select("journal").distinct(), "journal", "left_semi")


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def outcomes(ids: DataFrame, parsed: DataFrame, failed: DataFrame, allow_noncommercial: bool = False) -> DataFrame:
    """pmcid and status of every requested id: error, empty, licence:<label> or kept."""
    found = parsed.select("pmcid", "license", F.lit(True).alias("there"))
    joined = ids.join(failed.select("pmcid", F.lit(True).alias("failed")).distinct(), "pmcid", "left").join(found, "pmcid", "left")
    status = (
        F.when(F.col("failed"), "error")
        .when(F.col("there").isNull(), "empty")
        .when(~is_permitted(F.col("license"), allow_noncommercial), F.concat(F.lit("licence:"), "license"))
        .otherwise("kept")
    )
    return joined.select("pmcid", status.alias("status"))


def latest_status(log: DataFrame) -> DataFrame:
    """The last status of each id in a log with `line`; lines without an id or status are ignored."""
    last = F.max_by("status", "line")
    return log.filter("pmcid is not null and pmcid <> '' and status is not null and status <> ''").groupBy("pmcid").agg(last.alias("status"))


def to_fetch(ids: DataFrame, log: DataFrame) -> DataFrame:
    """Ids without a final status: unknown ones and errors."""
    return ids.join(latest_status(log).filter("status <> 'error'"), "pmcid", "left_anti")


def union_ranges(ranges: DataFrame, key: str, order: str) -> DataFrame:
    """Each id once, with the newest range that has it."""
    return ranges.groupBy(key).agg(F.max(order).alias(order))


def full_text(sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.concat(s["heading"], F.lit("\n"), s["text"])), "\n\n")


def manifest(articles: DataFrame) -> DataFrame:
    return articles.select("pmcid", "title", "doi", "license", "journal", F.size("sections").cast("bigint").alias("n_sections"), F.length(full_text(F.col("sections"))).cast("bigint").alias("n_chars"))


def summary(rows: DataFrame) -> DataFrame:
    """Articles, characters and medians of a manifest."""
    return rows.agg(F.count("*").alias("articles"), F.sum("n_chars").alias("chars"), F.median("n_sections").alias("median_sections"), F.median("n_chars").alias("median_chars"))


def repair(lines: DataFrame, key: str = "pmcid") -> DataFrame:
    """Of parsed JSON lines (with `line` and `_corrupt_record`) the last whole record of each id."""
    good = lines.filter(F.col("_corrupt_record").isNull() & F.col(key).isNotNull())
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("line")))
    return good.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_corrupt_record", "line")


def _prose(node: ElementTree.Element | None) -> str:
    """Text of an element without floats, but with what follows them."""
    if node is None:
        return ""
    held: list[str] = []
    stack: list[tuple[ElementTree.Element, bool]] = [(node, False)]
    while stack:
        one, left = stack.pop()
        if left:
            held.append(one.tail or "")
            continue
        if one.tag in FLOATS and one is not node:
            continue
        held.append(one.text or "")
        for child in reversed(one):
            stack += [(child, True), (child, False)]
    flat = " ".join("".join(held).split())
    for mark in ".,;:)":
        flat = flat.replace(f" {mark}", mark)
    return flat


def _walk(body: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """Heading path and text of every section with paragraphs of its own, in reading order."""
    stack: list[tuple[ElementTree.Element, list[str]]] = [(part, []) for part in reversed(body.findall("sec"))]
    while stack:
        part, above = stack.pop()
        title = _prose(part.find("title"))
        trail = [*above, title] if title else above
        text = "\n".join(filter(None, map(_prose, part.findall("p"))))
        if text:
            yield " > ".join(trail) or "Body", text
        stack += [(inner, trail) for inner in reversed(part.findall("sec"))]


def _article(pmcid: str, xml: str) -> dict | None:
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        root = recovered(xml)
    if root is None:
        return None
    node = root if root.tag == "article" else root.find(".//article")
    if node is None:
        return None
    abstract, body = _prose(node.find(".//article-meta/abstract")), node.find(".//body")
    sections = ([("Abstract", abstract)] if abstract else []) + (list(_walk(body)) if body is not None else [])
    if not sections:
        return None
    doi = next((e.text.strip() for e in node.findall(".//article-meta/article-id") if e.get("pub-id-type") == "doi" and e.text), None)
    permit = node.find(".//article-meta/permissions/license")
    address = "" if permit is None else " ".join([*(v for k, v in permit.attrib.items() if k.endswith("href")), *(e.text or "" for e in permit.iter() if e.tag.endswith("license_ref")), _prose(permit)])
    return {
        "pmcid": pmcid,
        "title": _prose(node.find(".//article-meta/title-group/article-title")),
        "doi": doi,
        "license_blob": address,
        "license_type": None if permit is None else permit.get("license-type"),
        "license_prose": "" if permit is None else _prose(permit),
        "journal": _prose(node.find(".//journal-meta//journal-title")),
        "sections": [{"heading": h, "text": t} for h, t in sections],
    }


def parse_articles(batch: DataFrame) -> DataFrame:
    """Articles of rows (pmcid, xml); rows without a usable body are dropped. Of damaged XML what can be read counts. Map-only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [a for p, x in zip(part["pmcid"], part["xml"], strict=True) if x and (a := _article(p, x))]
            yield pd.DataFrame(found, columns=["pmcid", "title", "doi", "license_blob", "license_type", "license_prose", "journal", "sections"])

    schema = "pmcid string, title string, doi string, license_blob string, license_type string, license_prose string, journal string, sections array<struct<heading:string,text:string>>"
    raw = batch.select("pmcid", "xml").mapInPandas(run, schema)
    prose = F.coalesce(F.nullif("license_type", F.lit("")), F.nullif(F.substring("license_prose", 1, 40), F.lit("")), F.lit("unknown"))
    label = F.when(F.col("license_blob").rlike(CC_URL), license_label(F.col("license_blob"))).otherwise(prose)
    return raw.select("pmcid", "title", "doi", label.alias("license"), "journal", "sections")
