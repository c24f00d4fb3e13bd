"""Language identification by Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, pieces, table

BITS = 16
#: The text model is fitted on about so many documents with a language, chosen by a hash of the id. Documented bound.
FIT_ROWS = 4_000
#: The text counts as so many independent runs of bytes at most, for neighbouring runs say nearly the same.
EFFECTIVE = 40.0
#: Pseudo-counts: of a host's parent, of a domain's parent, of the whole, and of the tables of markup and suffix.
HOST_PRIOR, DOMAIN_PRIOR, WHOLE_PRIOR, TABLE_PRIOR = 4.0, 8.0, 1.0, 2.0


def _runs(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of three bytes of lower-cased text."""
    text = batch.column(column).cast(pa.large_string()).fill_null("")
    text = pa.compute.utf8_lower(text)
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32) if raw is not None else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(n), np.diff(offsets))
    m = max(0, len(data) - 2)
    three = (data[:m] | (data[1 : m + 1] << np.uint32(8)) | (data[2 : m + 2] << np.uint32(16))) * np.uint32(2654435761)
    same = row[:m] == row[2 : m + 2]
    return row[:m][same], (three >> np.uint32(32 - BITS)).astype(np.int64)[same]


def _counts(batches):
    for whole in batches:
        for batch in pieces(whole, "text"):
            row, run = _runs(batch, "text")
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                count = np.bincount(run[(langs == lang)[row]], minlength=1 << BITS)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(count[at])], ["lang", "run", "n"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and the log share of each run in each of them."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null")
    n = usable.count()
    usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / max(n, 1))))
    counts = usable.select("lang", "text").mapInArrow(_counts, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names))
    total = np.full((len(langs), 1 << BITS), 0.5)
    for k, lang in enumerate(langs):
        own = names == lang
        total[k, counts.column("run").to_numpy()[own]] += counts.column("n").to_numpy()[own]
    return langs, np.log(total / total.sum(1, keepdims=True)).astype(np.float32)


def _log_mean(sums: list[Column], prior: list[Column], weight: float) -> list[Column]:
    whole = sum(sums[1:], sums[0])
    return [(s + F.lit(weight) * p) / (whole + F.lit(weight)) for s, p in zip(sums, prior, strict=True)]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, url, lang, confidence, text_lang, declared, host) of every page.

    The text gives likelihoods of its runs of bytes. From the resulting shares of
    languages, sums by declared markup language, by address suffix, host and
    domain are formed by grouped aggregation. The declared language and the
    suffix count as evidence with the odds at which they go with each language; a
    host's prior leans on its domain's, that on the whole's. A page's own share is
    taken out of its sums.

    Null or empty html: no text evidence. Null address: host, domain and suffix ''.
    No declared language: no such evidence. Of languages with equal odds the first by
    name is taken. Pages of any length are read whole. Repeated rows are treated alike.
    An empty table gives an empty result; without documents to learn from, lang is
    null. Other columns are left out.
    """
    langs, logs = fit(docs)
    html = F.coalesce(F.col("html"), F.lit(""))
    # no part looks past the next < or >, but for a script, which ends with the page if nothing else ends it: time grows with the page
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b[^<>]*>.*?(?:</\1\s*+>|\z)|<[^<>]*+>|&[a-zA-Z#0-9]{1,10};", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    base = pages.select(
        "page_id", "url", host.alias("host"),
        F.lower(F.regexp_extract(html, r"(?is)<html\b[^<>]*?\blang\s*+=\s*+[\"']?([a-z]{2,3})", 1)).alias("declared"),
        plain.alias("text"),
    )
    if not langs:
        return base.select(
            "page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("string").alias("text_lang"), "declared", "host",
        )

    def judged(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                row, run = _runs(batch, "text")
                n = np.bincount(row, minlength=batch.num_rows)
                scale = np.minimum(1.0, EFFECTIVE / np.maximum(n, 1))
                value = np.stack([np.bincount(row, logs[k][run], batch.num_rows) * scale for k in range(len(langs))])
                value -= value.max(0)
                share = np.exp(value)
                share /= share.sum(0)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in ("page_id", "url", "host", "declared")), *map(pa.array, value),
                    *map(pa.array, share),
                ], [
                    "page_id", "url", "host", "declared", *(f"v{k}" for k in range(len(langs))),
                    *(f"p{k}" for k in range(len(langs))),
                ])

    ks = range(len(langs))
    fields = base.select("page_id", "url", "host", "declared").schema
    for k in ks:
        fields = fields.add(f"v{k}", "double")
    for k in ks:
        fields = fields.add(f"p{k}", "double")
    scratch = Scratch(pages.sparkSession)
    seen = base.mapInArrow(judged, fields)
    labels = F.split("host", r"\.")
    seen = seen.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.when(F.size(labels) >= 2, F.concat(F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1))).otherwise(F.col("host")))
    seen = scratch.save(seen)  # pages are read once
    sums = scratch.save(seen.groupBy("declared", "suffix", "domain", "host").agg(*[F.sum(f"p{k}").alias(f"s{k}") for k in ks]))

    def by(name: str, *columns: str) -> DataFrame:
        return scratch.save(sums.groupBy(*columns).agg(*[F.sum(f"s{k}").alias(f"{name}{k}") for k in ks]))

    out = seen.join(F.broadcast(by("w")))  # one row
    out = out.join(F.broadcast(by("m", "declared")), "declared")  # names of at most three letters
    for name, column in (("x", "suffix"), ("d", "domain"), ("h", "host")):
        out = out.join(by(name, column), column)  # tables of their own, so that the join can split a host with many pages
    own = [F.col(f"p{k}") for k in ks]
    less = lambda name: [F.greatest(F.col(f"{name}{k}") - own[k], F.lit(0.0)) for k in ks]
    even = [F.lit(1.0 / len(langs))] * len(langs)
    prior = _log_mean(less("h"), _log_mean(less("d"), _log_mean(less("w"), even, WHOLE_PRIOR), DOMAIN_PRIOR), HOST_PRIOR)

    def odds(name: str, k: int) -> Column:
        """log of P(mark | language), but for a factor that all languages share."""
        whole = F.greatest(F.col(f"w{k}") - own[k], F.lit(0.0))
        return F.log((F.greatest(F.col(f"{name}{k}") - own[k], F.lit(0.0)) + F.lit(TABLE_PRIOR / len(langs))) / (whole + F.lit(TABLE_PRIOR)))

    for k, lang in enumerate(langs):
        agrees = F.when(F.col("declared") == lang, F.lit(1.0)).otherwise(F.lit(0.0))
        mark = F.when(F.col("declared") == "", F.lit(0.0)).otherwise(odds("m", k) + agrees)
        suffix = F.when(F.col("suffix") == "", F.lit(0.0)).otherwise(odds("x", k))
        out = out.withColumn(f"l{k}", F.col(f"v{k}") + mark + suffix + F.log(prior[k]))
    top = F.greatest(*[F.col(f"l{k}") for k in ks]) if len(langs) > 1 else F.col("l0")
    best_text = F.greatest(*[F.col(f"v{k}") for k in ks]) if len(langs) > 1 else F.col("v0")

    def pick(letter: str, best: Column) -> Column:
        return F.coalesce(*[F.when(F.col(f"{letter}{k}") == best, F.lit(lang)) for k, lang in enumerate(langs)])

    share = F.lit(1.0) / sum([F.exp(F.col(f"l{k}") - top) for k in ks], F.lit(0.0))
    return out.select("page_id", "url", pick("l", top).alias("lang"), share.alias("confidence"), pick("v", best_text).alias("text_lang"), "declared", "host")


def op5_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
