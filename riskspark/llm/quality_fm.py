"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector. Its distinct words fall into hashed buckets, weighted by the root of their counts and
scaled to length one; each structure statistic (shares of symbols, capitals, repeats, ...) and the size of the text
sets one bucket of its own field to one. With weights ``w`` and factors ``v`` of low rank the score is the logistic
of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairs are summed in linear time through
``((sum v_i x_i)^2 - sum v_i^2 x_i^2) / 2`` per factor.

Fitted with AdaGrad on at most ``max_rows`` labelled rows (those whose identifier hashes lowest); scoring reads every
text once, in one pass without a shuffle. Buckets no training row sets have no weight and no factors, so an unknown
word neither helps nor harms.

Defined results: a null or empty text is scored by its structure fields alone; with no labelled rows, or labels of
one class only, every score is the smoothed share of the class 1. Labels that are null do not count; of several
labels of one identifier the smallest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.compression import base_counts
from riskspark.llm.kept import kept_apart
from riskspark.llm.textbytes import Texts, blocks, hash_runs, lower_ascii, small_batches

WORD_BUCKETS = 1 << 15
LEVELS = 12
_CLASSES = {
    "upper": list(range(65, 91)), "digit": list(range(48, 58)), "mark": list(b"#*$%&<>|"), "bang": list(b"!?"), "bar": list(b"|~_=+\\/"),
    "stop": list(b".,;:"), "wide": list(range(192, 256)), "line": [10], "control": [*range(9), *range(14, 32), 127],
}
_SHARES = np.array([0.0, 0.002, 0.01, 0.03, 0.07, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95])
_SIZES = np.array([0, 2, 10, 30, 60, 150, 400, 1000, 3000, 10000, 40000], float)
STATISTICS = ("n_words", "word_length", *_CLASSES, "distinct", "repeats", "same_lines", "top_word", "declared")
N_FEATURES = WORD_BUCKETS + LEVELS * len(STATISTICS)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def features(texts: Texts, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, index, value)`` of every feature set, ordered by text.

    ``declared``: the number of characters the row's metadata gives, negative where it gives none.
    """
    n = len(texts)
    starts, ends = texts.words()
    owner = texts.owner(starts)
    hashed = hash_runs(lower_ascii(texts.data), starts, ends) >> np.uint64(24)
    # distinct words, by a hash wide enough to tell the words of one text apart
    keys, counts = np.unique((owner.astype(np.uint64) << np.uint64(40)) | hashed, return_counts=True)
    key_owner = (keys >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(key_owner, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, key_owner, counts)
    merged, inverse = np.unique(key_owner * WORD_BUCKETS + (keys % np.uint64(WORD_BUCKETS)).astype(np.int64), return_inverse=True)
    value = np.sqrt(np.bincount(inverse, weights=counts, minlength=len(merged)))
    word_owner = merged // WORD_BUCKETS
    norm = np.sqrt(np.bincount(word_owner, weights=value**2, minlength=n))
    value = value / norm[word_owner]

    base = base_counts(texts)
    words, size = np.maximum(base["n_words"], 1), np.maximum(texts.sizes, 1)
    lines = np.maximum(texts.total(texts.data == 10) + 1, 1)
    per_class = {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[members] = True
        per_class[name] = texts.total(table[texts.data])
    level = [
        np.searchsorted(_SIZES, base["n_words"], side="right") - 1,
        np.minimum(base["word_chars"] // words, LEVELS - 1),
        *(np.searchsorted(_SHARES, per_class[c] / (size if c in ("upper", "digit", "wide") else words), side="left") for c in _CLASSES),
        np.searchsorted(_SHARES, distinct / words, side="left"),
        np.searchsorted(_SHARES, base["n_repeat_words"] / words, side="left"),
        np.searchsorted(_SHARES, base["n_dup_lines"] / lines, side="left"),
        np.searchsorted(_SHARES, top / words, side="left"),
        np.where(declared < 0, LEVELS - 1, np.searchsorted(_SIZES, np.maximum(declared, 0) // 6, side="right") - 1),
    ]
    block = np.stack(level, axis=1) + WORD_BUCKETS + LEVELS * np.arange(len(STATISTICS))
    all_owner = np.concatenate([word_owner, np.repeat(np.arange(n), len(STATISTICS))])
    index = np.concatenate([merged % WORD_BUCKETS, block.ravel()])
    values = np.concatenate([value, np.ones(block.size)])
    order = np.argsort(all_owner, kind="stable")
    return all_owner[order], index[order].astype(np.int32), values[order].astype(np.float32)


def _pair_sums(model_factors: np.ndarray, owner: np.ndarray, index: np.ndarray, value: np.ndarray):
    """Per text the sums ``sum v x`` and the pairwise term; every text has at least one feature."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    scaled = model_factors[index] * value[:, None]
    sums = np.add.reduceat(scaled, begin, axis=0)
    return sums, 0.5 * ((sums**2).sum(1) - np.add.reduceat((scaled**2).sum(1), begin))


def raw_scores(model: Model, owner: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    linear = np.bincount(owner, weights=model.weights[index] * value, minlength=n)
    return model.bias + linear + _pair_sums(model.factors, owner, index, value)[1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 8, step: float = 0.1,
    penalty: float = 1e-4, seed: int = 7,
) -> Model:
    """AdaGrad on the logistic loss; ``rows`` are (indices, values) per labelled text."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    zero = Model(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, rank), np.float32))
    if len(set(labels.tolist())) < 2:
        return zero
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(N_FEATURES), rng.normal(0, 0.03, (N_FEATURES, rank))
    bias, seen_bias = zero.bias, 1e-3
    seen_w, seen_f = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, rank), 1e-3)
    touched = np.zeros(N_FEATURES, bool)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            index = np.concatenate([rows[i][0] for i in chosen])
            value = np.concatenate([rows[i][1] for i in chosen]).astype(float)
            sums, pairs = _pair_sums(factors, owner, index, value)
            guess = logistic(bias + np.bincount(owner, weights=weights[index] * value) + pairs)
            error = (guess - labels[chosen]) / len(chosen)
            seen_bias += error.sum() ** 2
            bias -= step * error.sum() / np.sqrt(seen_bias)
            slope = error[owner] * value
            used, inverse = np.unique(index, return_inverse=True)
            touched[used] = True
            grad_w = np.bincount(inverse, weights=slope) + penalty * weights[used]
            each = slope[:, None] * (sums[owner] - factors[index] * value[:, None])
            grad_f = np.stack([np.bincount(inverse, weights=each[:, k]) for k in range(rank)], 1) + penalty * factors[used]
            seen_w[used] += grad_w**2
            seen_f[used] += grad_f**2
            weights[used] -= step * grad_w / np.sqrt(seen_w[used])
            factors[used] -= step * grad_f / np.sqrt(seen_f[used])
    factors[~touched] = 0
    return Model(float(bias), weights.astype(np.float32), factors.astype(np.float32))


def _declared(batch: pa.RecordBatch, texts: Texts) -> np.ndarray:
    column = batch.column("__declared").slice(texts.first, len(texts))
    return column.fill_null(-1).to_numpy(zero_copy_only=False)


def _extract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for texts in blocks(batch.column("__text")):
            owner, index, value = features(texts, _declared(batch, texts))
            offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
            label = batch.column("__label").slice(texts.first, len(texts))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (index, value)]
            yield pa.RecordBatch.from_arrays([label, *lists], names=["label", "index", "value"])


def _score(rows: Iterator[pa.RecordBatch], keep: list[str], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for texts in blocks(batch.column("__text")):
            score = logistic(raw_scores(model, *features(texts, _declared(batch, texts)), len(texts)))
            columns = [batch.column(k).slice(texts.first, len(texts)) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names=[*keep, "score"])


def _inputs(docs: DataFrame, text: str, declared: str | None) -> list:
    size = F.expr(f"try_cast(`{declared}` AS bigint)") if declared and declared in docs.columns else F.lit(None).cast("bigint")
    return [docs[text].cast("string").alias("__text"), size.alias("__declared")]


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text: str = "text", declared: str | None = "n_chars",
    **options,
) -> Model:
    """Fit on at most ``max_rows`` rows of ``labels(id, label 0/1)``; the driver gets their sparse features only."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull()).groupBy(id_col).agg(F.min("label").alias("__label"))
    # at most max_rows identifiers: the side that is broadcast is bounded
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    picked = docs.select(docs[id_col].alias("__id"), *_inputs(docs, text, declared))
    picked = picked.join(F.broadcast(sample.withColumnRenamed(id_col, "__id")), "__id")
    kept = small_batches(picked.select("__label", "__text", "__declared"))
    table = kept.mapInArrow(_extract, "label int, index array<int>, value array<float>").toArrow()
    rows = [
        (np.asarray(i.values), np.asarray(v.values)) for i, v in zip(table.column("index"), table.column("value"), strict=True)
    ]
    return fit(rows, np.array(table.column("label").to_pylist(), float), **options)


@kept_apart()
def score(docs: DataFrame, model: Model, text: str = "text", declared: str | None = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with ``score``; a column of that name gives way."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    source = small_batches(docs.select(*[docs[c] for c in keep], *_inputs(docs, text, declared)))
    schema = source.drop("__text", "__declared").schema.add("score", "double")
    return source.mapInArrow(lambda rows: _score(rows, keep, model), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of identifiers no label may be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, max_rows: int = 6000) -> DataFrame:
    """Train on the labels outside the held-out quarter, score every row of ``docs``."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    return score(docs, train(docs, known, max_rows), keep=keep)
