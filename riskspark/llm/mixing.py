"""Temperature mixing: source weights from exponentiated token shares, realised as budgeted block permutations.

Weights are ``share ** a / sum(share ** a)``. The exponent ``a`` in [0, 1] is bisected: the largest whose weights reach
the target entropy (as a part of the greatest possible one), then raised if needed until no source is repeated more
often than allowed. Each step is one aggregation over the table of sources and narrows the exponent by a factor of
``GRID`` at once, so sources need not fit in the driver.

A source with weight ``w`` gets ``w * budget`` tokens. Its documents are dealt by hash into blocks of bounded size. In
every epoch the blocks are permuted anew, and the hashed order inside each begins at another point; the source yields
whole epochs and then the head of one more permutation up to its tokens. The block is the unit of windows, so a source that holds most rows is
many blocks, and offsets come from the sums of blocks. ``place`` in [0, 1) is how far the source has come: ordering
all rows by it interleaves the sources by weight at every point.

Defined results: the budget is met per source to within one document (the last one is taken if its middle lies inside
the budget). Documents without tokens (null or empty text) come once, in epoch 0, whatever the weights. A null source is a source of its own.
Rows are told apart by a hash of all their columns; equal rows share a block and keep their number (identifiers may
repeat or be null). No documents: no rows. No tokens at all: the rows as they are, weight null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.kept import kept_apart
from riskspark.session import scratch_path

GRID = 32
ROUNDS = 5
BLOCK_DOCS = 2000


@dataclass(frozen=True)
class Target:
    """What the weights must meet; ``None`` leaves a part out."""

    entropy: float | None = 0.95  # part of log(number of sources)
    repetition: float | None = 4.0  # most epochs of a source
    budget: float | None = 1.0  # tokens to yield, as a multiple of all; None: as many as let every source appear whole


def word_tokens(text):
    """Number of words (runs without the six ASCII white space characters)."""
    words = F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))
    return words.cast("long")


def _statistics(sources: DataFrame, grid: list[float]):
    """Per exponent: entropy of the weights, most epochs per unit of budget, and least."""
    points = F.array(*[F.lit(a) for a in grid])
    powered = sources.select("share", F.explode(points).alias("a")).withColumn("p", F.pow("share", "a"))
    # H = log Z - sum(p log p) / Z
    found = powered.groupBy("a").agg(
        F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("s"),
        F.max(F.col("p") / F.col("share")).alias("most"), F.min(F.col("p") / F.col("share")).alias("least"),
    )
    # one row per grid point
    return {r.a: (float(math.log(r.z) - r.s / r.z), r.most / r.z, r.least / r.z) for r in found.collect()}


def bisect_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for ``sources(share)``; 1 keeps the shares, 0 makes all sources equal."""
    n = sources.count()
    if n < 2:
        return 1.0
    wanted = None if target.entropy is None else target.entropy * math.log(n)

    def search(holds) -> float:
        """The largest exponent where ``holds`` (true at 0, false from some point on), else 0; 1 if it holds there."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            values = _statistics(sources, grid)
            good = [a for a in grid if holds(values[a])]
            if not good:
                return low
            if good[-1] >= high:
                return high
            low, high = good[-1], grid[grid.index(good[-1]) + 1]
        return low

    exponent = 1.0 if wanted is None else search(lambda v: v[0] >= wanted)
    if target.repetition is not None:
        def repeats(v) -> float:
            return v[1] * target.budget if target.budget is not None else v[1] / v[2]

        # epochs fall as the exponent grows: the smallest that is allowed is just above the largest that is not
        limit = search(lambda v: repeats(v) > target.repetition)
        if repeats(_statistics(sources, [exponent])[exponent]) > target.repetition:
            exponent = min(1.0, max(exponent, limit + GRID**-ROUNDS * 2))
    return exponent


def source_weights(tokens: DataFrame, target: Target) -> DataFrame:
    """``(source, n_docs, n_tokens, share, weight, yield_tokens, exponent)`` per source of ``tokens(source, n_tokens)``.

    Sources without tokens have no share and no weight.
    """
    spark = tokens.sparkSession
    path = scratch_path(spark, "source-sums")
    tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(path)
    sums = spark.read.schema("source string, n_docs long, n_tokens long").parquet(path)
    total = float(sums.agg(F.sum("n_tokens")).first()[0] or 0)
    shares = sums.withColumn("share", F.when(F.col("n_tokens") > 0, F.col("n_tokens") / F.lit(total or 1.0)))
    exponent = bisect_exponent(shares.where("share IS NOT NULL").select("share"), target)
    powered = F.pow("share", F.lit(exponent))
    z, least = shares.agg(F.sum(powered), F.min(powered / F.col("share"))).first()
    budget = total * target.budget if target.budget is not None else total * (z or 1.0) / (least or 1.0)
    weighted = shares.withColumn("weight", powered / F.lit(z or 1.0))
    return weighted.withColumn("yield_tokens", F.col("weight") * F.lit(budget)).withColumn("exponent", F.lit(exponent))


@kept_apart("whole", "weight", "yield_tokens", "b_tokens", "b_start", "rotation", "n_tokens", "turn")
def temperature_mix(
    docs: DataFrame, target: Target = Target(), source: str = "source", text: str = "text", seed: int = 11, block_docs: int = BLOCK_DOCS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, default all) drawn by the weights, once per time they are yielded, with
    ``__source, __tokens, __weight, __epoch, __block, __place``. The kept columns are shuffled once."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant", "void")]
    rows = docs.select(
        *[docs[c] for c in keep], F.coalesce(docs[source].cast("string"), F.lit("\0null")).alias("__source"),
        word_tokens(docs[text]).alias("__tokens"), F.xxhash64(*[docs[c] for c in plain], F.lit(seed)).alias("__hash"),
    )
    weights = source_weights(rows.select(F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens")), target)
    path = scratch_path(spark, "source-weights")
    weights.write.parquet(path)
    weights = spark.read.schema(weights.schema).parquet(path)
    parts = F.ceil(F.col("n_docs") / F.lit(block_docs))
    sized = weights.select(F.col("source").alias("__source"), parts.alias("__parts"))

    placed = rows.join(sized, "__source").withColumn("__block", F.pmod(F.xxhash64("__hash"), F.col("__parts"))).drop("__parts")
    blocks = placed.groupBy("__source", "__block").agg(F.sum("__tokens").alias("b_tokens"))
    whole = F.floor(F.col("yield_tokens") / F.col("n_tokens"))
    epochs = blocks.join(weights.withColumnRenamed("source", "__source"), "__source").withColumn("whole", F.coalesce(whole, F.lit(0)))
    # one more epoch than whole ones: the head of it fills the rest of the budget
    epochs = epochs.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    epochs = epochs.withColumn("turn", F.xxhash64("__source", "__block", "__epoch", F.lit(seed)))
    before = "sum(b_tokens) OVER (PARTITION BY __source, __epoch ORDER BY turn, __block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    epochs = epochs.selectExpr(
        "__source", "__block", "__epoch", "whole", "weight", "yield_tokens", "b_tokens",
        f"__epoch * n_tokens + coalesce({before}, 0) AS b_start", "pmod(turn, greatest(b_tokens, 1)) AS rotation",
    )

    # Order inside a block: by hash, in every epoch begun at another point of the block.
    inner = "sum(__tokens) OVER (PARTITION BY __source, __block ORDER BY __hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ordered = placed.selectExpr("*", f"coalesce({inner}, 0) AS __start")
    drawn = ordered.join(epochs, ["__source", "__block"])
    drawn = drawn.withColumn("__offset", F.expr("b_start + pmod(__start - rotation, greatest(b_tokens, 1))"))
    taken = F.expr(
        "CASE WHEN __tokens = 0 OR weight IS NULL THEN __epoch = 0 ELSE __epoch < whole OR __offset + __tokens / 2.0D <= yield_tokens END"
    )
    place = F.least(F.coalesce(F.col("__offset") / F.when(F.col("yield_tokens") > 0, F.col("yield_tokens")), F.lit(0.0)), F.lit(1.0))
    return drawn.where(taken).select(
        *keep, F.when(F.col("__source") != "\0null", F.col("__source")).alias("__source"), "__tokens", F.col("weight").alias("__weight"),
        "__epoch", "__block", place.alias("__place"),
    )
