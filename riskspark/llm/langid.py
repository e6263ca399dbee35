"""Language identification by Bayesian fusion of evidence about a page.

Four kinds of evidence add up as logarithms, per language:

* the text: hashed byte trigrams, likelihoods fitted on labelled documents, tempered because trigrams overlap;
* the declared language of the markup (``lang`` attribute), by how often each language's texts declare what;
* the suffix of the address, by how often each language's texts stand under it;
* the host: a prior from the other pages of the host, smoothed with the pages of its domain, smoothed with all pages.

All rates come from grouped aggregation over all pages with the text's posterior as fractional counts; a page's own
share is taken out of its host, domain and suffix first, so it is not evidence for itself. Declared values other than the known
languages count as one value, so that table is bounded; suffixes, domains and hosts stay distributed and are joined.

Defined results: null or empty html has flat text evidence; without an address host, domain and suffix are empty, one
group of their own; ties go to the language first in the alphabet. Without labelled documents the language is null.
Equal rows get equal results. The text model is fitted on at most ``max_rows`` labelled documents, those whose
identifier hashes lowest; labels are lower-cased primary subtags, null ones do not count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.html_blocks import leaf_blocks
from riskspark.llm.kept import kept_apart
from riskspark.llm.textbytes import small_batches
from riskspark.session import scratch_path

BUCKETS = 1 << 15
TEMPER = 0.1  # weight of one trigram
MOST_GRAMS = 400  # beyond, more text of the page adds no more certainty
SMOOTH = 5.0  # pseudo-pages a wider group lends a narrower one
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)|^//([^/?#:]+)")


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    log_rates: np.ndarray  # language x bucket


def grams(text: str) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased text, white space collapsed."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def fit(texts: list[str], labels: list[str], smoothing: float = 0.5) -> TextModel:
    languages = tuple(sorted(set(labels)))
    counts = np.full((len(languages), BUCKETS), smoothing)
    for text, label in zip(texts, labels, strict=True):
        counts[languages.index(label)] += np.bincount(grams(text), minlength=BUCKETS)
    return TextModel(languages, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32))


def train(docs: DataFrame, max_rows: int = 3000, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> TextModel:
    """Fit on at most ``max_rows`` labelled documents; the driver gets only these."""
    label = F.lower(F.regexp_extract(docs[lang], "^[A-Za-z]+", 0))
    known = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & (label != ""))
    chosen = known.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h")).orderBy("h", "id").limit(max_rows)
    # max_rows identifiers at most: the side that is broadcast is bounded
    picked = known.select(F.col(id_col).alias("id"), F.col(text).alias("text"), label.alias("label")).join(F.broadcast(chosen), "id")
    rows = picked.orderBy("h", "id", F.length("text")).limit(max_rows).collect()
    return fit([r.text for r in rows], [r.label for r in rows])


def address_parts(url: str | None) -> tuple[str, str, str]:
    """Host, domain (last two labels) and suffix (last label) of an address; empty where it has none."""
    match = _HOST.match(url or "")
    host = ((match.group(1) or match.group(2)) if match else "").lower().strip(".")
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def text_evidence(model: TextModel, page: str | None) -> np.ndarray:
    """Tempered log-likelihood per language, 0 for the best; blocks that are mostly links are left out."""
    text = " ".join(b.text for b in leaf_blocks(page) if 2 * b.linked < len(b.text))
    found = grams(text) if text else np.zeros(0, np.int64)
    if not len(found) or not model.languages:
        return np.zeros(len(model.languages))
    total = model.log_rates[:, found].sum(1) * (TEMPER * min(1.0, MOST_GRAMS / len(found)))
    return (total - total.max()).astype(float)


def declared_language(page: str | None, languages: tuple[str, ...]) -> str:
    """Primary subtag of the page's ``lang``; ``other`` for one unknown here, empty without one."""
    match = _LANG.search(page or "")
    value = html.unescape(match.group(1)).lower() if match else ""
    return value if value in languages or not value else "other"


def _signals(rows: Iterator[pa.RecordBatch], keep: list[str], model: TextModel) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        pages = batch.column("__html").to_pylist()
        parts = [address_parts(u) for u in batch.column("__url").to_pylist()]
        evidence = [text_evidence(model, p).tolist() for p in pages]
        columns = [batch.column(k) for k in keep]
        columns += [pa.array([p[i] for p in parts], pa.string()) for i in range(3)]
        columns += [pa.array([declared_language(p, model.languages) for p in pages], pa.string()), pa.array(evidence, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "host", "domain", "suffix", "declared", "__text"])


@kept_apart(left_out="html_col")
def identify(pages: DataFrame, model: TextModel, url: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` (columns ``keep``, default all but the html) with ``host, domain, suffix, declared, text_lang, lang,
    confidence``; columns of these names give way."""
    spark, n = pages.sparkSession, len(model.languages)
    made = ["host", "domain", "suffix", "declared", "text_lang", "lang", "confidence"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made and (keep is not None or c != html_col)]
    source = small_batches(
        pages.select(*[pages[c] for c in keep], pages[url].cast("string").alias("__url"), pages[html_col].cast("string").alias("__html"))
    )
    schema = source.drop("__url", "__html").schema
    for name in ("host", "domain", "suffix", "declared"):
        schema = schema.add(name, "string")
    found = source.mapInArrow(lambda rows: _signals(rows, keep, model), schema.add("__text", T.ArrayType(T.DoubleType())))
    if not n:
        null = F.lit(None)
        return found.select(*keep, *made[:4], null.cast("string").alias("text_lang"), null.cast("string").alias("lang"), null.cast("double").alias("confidence"))
    path = scratch_path(spark, "language-signals")
    found.write.parquet(path)
    signals = spark.read.schema(found.schema).parquet(path)
    weights = F.transform("__text", F.exp)
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    signals = signals.withColumn("__p", F.transform(weights, lambda x: x / total))

    def counts(by: str, name: str) -> DataFrame:
        sums = F.array(*[F.sum(F.col("__p")[i]) for i in range(n)])
        return signals.groupBy(F.col(by).alias(f"__{name}_key")).agg(sums.alias(f"__{name}"))

    # bounded by languages x (languages + 2)
    tables = {r["__declared_key"]: r["__declared"] for r in counts("declared", "declared").collect()}
    values = [*model.languages, "other", ""]
    rates = np.array([tables.get(v, [0.0] * n) for v in values]) + 0.5
    everyone = rates.sum(0) - 0.5 * len(values)
    shares = (everyone + 0.5) / (everyone + 0.5).sum()
    log_declared = np.log(rates / rates.sum(0))
    declared = F.create_map(*[x for v, r in zip(values, log_declared, strict=True) for x in (F.lit(v), F.array(*map(F.lit, map(float, r))))])
    flat = F.array(*[F.lit(float(s)) for s in shares])
    everyone_column = F.array(*[F.lit(float(s)) for s in everyone])

    joined = signals
    for by in ("host", "domain", "suffix"):
        table = counts(by, by)
        joined = joined.join(table, joined[by] == table[f"__{by}_key"]).drop(f"__{by}_key")

    def smoothed(name: str, wider):
        """Shares of the group without the page itself, with pseudo-pages of the wider group."""
        others = F.zip_with(F.col(f"__{name}"), "__p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(others, wider, lambda c, w: (c + SMOOTH * w) / (size + SMOOTH))

    joined = joined.withColumn("__d", smoothed("domain", flat)).withColumn("__prior", smoothed("host", F.col("__d")))
    # likelihood of the suffix: pages of the language under it over all of the language, the page itself left out
    under = F.zip_with(F.col("__suffix"), "__p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    of_all = F.zip_with(everyone_column, "__p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    joined = joined.withColumn("__under", F.zip_with(under, of_all, lambda u, a: F.log((u + 0.5) / (a + 1.0))))
    joined = joined.withColumn("__stated", F.coalesce(declared[F.col("declared")], F.array(*[F.lit(0.0)] * n)))
    score = F.zip_with(
        F.zip_with("__text", "__stated", lambda a, b: a + b), F.zip_with("__under", F.col("__prior"), lambda a, b: a + F.log(b)), lambda a, b: a + b
    )
    joined = joined.withColumn("__score", score).withColumn("__top", F.array_max("__score"))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.element_at(names, F.array_position("__score", F.col("__top")).cast("int"))
    sure = 1.0 / F.aggregate("__score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__top")))
    by_text = F.element_at(names, F.array_position("__text", F.array_max("__text")).cast("int"))
    return joined.select(*keep, *made[:4], by_text.alias("text_lang"), best.alias("lang"), sure.alias("confidence"))
