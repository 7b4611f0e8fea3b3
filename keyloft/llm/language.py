"""Language of web pages by Bayesian fusion of evidence.

Text gives likelihoods from character trigrams, learned from labelled documents by grouped counts. Declared markup
language gives a likelihood from how often it goes with a language that the text alone suggests. The prior of a page is
that of its host, smoothed towards its domain, the domain towards its suffix, the suffix towards all pages; a page's own
vote is taken out of every level first. The address suffix is such a level only and has no likelihood of its own, so it
counts little on hosts with many votes.
"""

from __future__ import annotations

import html as markup
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloft.llm.common import Scratch, map_arrow, table

LANGUAGES = ("de", "en", "es", "fr")
#: Buckets of hashed trigrams; weight of a trigram's log likelihood (neighbours overlap, so each counts less than fully); pseudo-votes of the level above.
BUCKETS, TEMPER, SMOOTHING = 1 << 14, 0.2, 4.0

#: Elements whose whole content is no text of the page.
_SILENT = ("script", "style", "nav", "footer", "header", "aside", "head", "noscript", "template")
_OPENS = re.compile(r"<(?:(" + "|".join(_SILENT) + r")\b|!--)?", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in _SILENT} | {"": re.compile("-->")}
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*[\"']?([a-z]{2,3})", re.I)


def visible_text(html: str) -> str:
    """Text of a page without markup, comments, scripts and navigation.

    An element or comment without an end loses its tag alone; a ``<`` without a ``>`` after it is text. One pass: once
    no end is found, it is not looked for again, so a page of unclosed tags takes no longer than another.
    """
    out, at, absent = [], 0, set()
    while found := _OPENS.search(html, at):
        kind = found[1].lower() if found[1] else "" if found[0] != "<" else None
        end = None
        if kind is not None and kind not in absent:
            # silent elements end behind their tag at the earliest, comments behind their mark
            end = _CLOSES[kind].search(html, found.end())
            if end is None:
                absent.add(kind)
        to = end.end() if end else 1 + html.find(">", found.end() if kind is None else found.start())
        if not to:
            break
        out.append(html[at : found.start()])
        at = to
    out.append(html[at:])
    return markup.unescape(" ".join(out))


def declared_language(html: str) -> str:
    """Language code of the first html tag that has one, in lower case; empty without any."""
    at = 0
    while found := _HTML.search(html, at):
        end = html.find(">", found.end())
        code = _LANG.search(html, found.end(), len(html) if end < 0 else end)
        if code or end < 0:
            return code[1].lower() if code else ""
        at = end
    return ""


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text, letters only, runs of anything else as one space."""
    raw = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text} ").lower().encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return ((raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA6B) ^ raw[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(18)).astype(np.int64)


def trigram_likelihoods(docs: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log likelihood of each bucket in each language, from all documents whose lang is listed.

    Each task sums its documents; the sums of all tasks are grouped by language and bucket.
    """
    index = {x: i for i, x in enumerate(languages)}

    def run(batches):
        sums = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums[index[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"l": pa.array(at[0].astype(np.int32)), "b": pa.array(at[1].astype(np.int32)), "n": pa.array(sums[at])})

    rows = map_arrow(docs.filter(F.col("lang").isin(list(languages)) & F.col("text").isNotNull()).select("lang", "text"), run, "l int, b int, n long")
    sums = np.ones((len(languages), BUCKETS))
    for r in rows.groupBy("l", "b").agg(F.sum("n").alias("n")).collect():  # languages * BUCKETS rows at most
        sums[r.l, r.b] += r.n
    return np.log(sums / sums.sum(axis=1, keepdims=True))


def page_evidence(pages: DataFrame, likelihoods: np.ndarray, languages: tuple[str, ...]) -> DataFrame:
    """page_id, host, domain, suffix, declared, n_grams and ll (log likelihood of the text by language) of each page."""

    def run(batches):
        kinds = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("suffix", pa.string()), ("declared", pa.string()), ("n_grams", pa.int64()), ("ll", pa.list_(pa.float64()))])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for page_id, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    try:
                        host = (urlsplit(url or "").hostname or "").rstrip(".")
                    except ValueError:
                        host = ""
                    grams = trigrams(visible_text(html or ""))
                    out.append((page_id, host, ".".join(host.split(".")[-2:]), host.rpartition(".")[2], declared_language(html or ""), len(grams), likelihoods[:, grams].sum(axis=1).tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds.types)], schema=kinds)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, host string, domain string, suffix string, declared string, n_grams long, ll array<double>")


def _sums(arrays: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(arrays, F.lit(i))) for i in range(n)])


def identify(pages: DataFrame, docs: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """page_id, host, declared, n_grams, text_lang, lang, posterior of every page.

    A null or empty html has no text; a url that is null or has no host belongs to the host ''. Pages without any evidence
    take the prior of all pages. Ties go to the first language of the list. Rows are judged each, repeated ones too; other
    columns are ignored; without labelled documents the text says nothing; an empty table gives an empty result. A page of
    any length is read whole, in time that grows with its length, unclosed markup included.
    """
    scratch = Scratch(pages.sparkSession, "language")
    n = len(languages)
    rows = scratch.save(page_evidence(pages, trigram_likelihoods(docs, languages), languages), "evidence")
    listed = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.array_position(c, F.array_max(c)).cast("int") - 1
    rows = rows.withColumn("t", best(F.col("ll"))).withColumn("vote", F.when(F.col("n_grams") > 0, F.array(*[(F.col("t") == i).cast("double") for i in range(n)])).otherwise(F.array(*[F.lit(0.0)] * n)))

    hosts = scratch.save(rows.groupBy("host", "domain", "suffix").agg(_sums("vote", n).alias("by_host")), "hosts")
    domains = scratch.save(hosts.groupBy("domain", "suffix").agg(_sums("by_host", n).alias("by_domain")), "domains")
    suffixes = scratch.save(domains.groupBy("suffix").agg(_sums("by_domain", n).alias("by_suffix")), "suffixes")
    everything = suffixes.agg(_sums("by_suffix", n)).first()[0]
    everything = F.array(*[F.lit(float(x or 0.0)) for x in everything])
    levels = scratch.save(hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "by_host", "by_domain", "by_suffix"), "levels")

    # how often the text's language goes with each declared language; few rows, for codes have two or three letters
    declared = rows.groupBy("declared").agg(_sums("vote", n).alias("by_declared"))
    rows = rows.join(levels, "host").join(declared, "declared")
    less = lambda c: F.zip_with(c, F.col("vote"), lambda a, v: F.greatest(F.lit(0.0), a - v))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("*", less(everything).alias("c0"), *[less(F.col(c)).alias(f"c{i}") for i, c in ((1, "by_suffix"), (2, "by_domain"), (3, "by_host"))], less(F.col("by_declared")).alias("cd"))
    rows = rows.withColumn("p", F.transform("c0", lambda x: (x + 1) / (total(F.col("c0")) + n)))
    rows = rows.withColumn("global", F.col("p"))
    for i in (1, 2, 3):
        rows = rows.withColumn("sum", total(F.col(f"c{i}"))).withColumn("p", F.zip_with(f"c{i}", "p", lambda c, above: (c + SMOOTHING * above) / (F.col("sum") + SMOOTHING)))
    # evidence of the declared language as a likelihood ratio: its share of each language against the share among all pages
    rows = rows.withColumn("sum", total(F.col("cd")))
    ratio = F.zip_with("cd", "global", lambda c, g: (c + SMOOTHING * g) / ((F.col("sum") + SMOOTHING) * g))
    rows = rows.withColumn("log", F.zip_with(F.zip_with("ll", "p", lambda a, b: TEMPER * a + F.log(b)), ratio, lambda a, b: a + F.log(b)))
    rows = rows.withColumn("top", F.array_max("log")).withColumn("sum", total(F.transform("log", lambda x: F.exp(x - F.col("top")))))
    return rows.select("page_id", "host", "declared", "n_grams", F.when(F.col("n_grams") > 0, F.get(listed, F.col("t"))).alias("text_lang"), F.get(listed, best(F.col("log"))).alias("lang"), (1 / F.col("sum")).alias("posterior"))


def op4_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all pages, with trigrams learned from documents."""
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
