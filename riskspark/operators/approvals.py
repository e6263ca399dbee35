"""Listing, paging, redacting and revoking approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.hashing import canonical_json, hmac_sha256, keyed_hash

# Listing order and page bounds.
LISTING_ORDER = (
    "expires_at", "repo_id_hash", "command_scope", "policy_version", "ruleset_version", "critical_fingerprint", "entry_id",
)
MAX_PAGE = 100
DEFAULT_PAGE = 50


def filter_approvals(approvals: DataFrame, repo_id: str | None = None, scope: str | None = None) -> DataFrame:
    """P6."""
    if repo_id is not None:
        approvals = approvals.where(F.col("repo_id") == repo_id)
    if scope is not None:
        approvals = approvals.where(F.col("command_scope") == scope)
    return approvals


def redact_public(approvals: DataFrame, key: bytes) -> DataFrame:
    """P14. Public view: identities only as keyed hashes; no path, URL or command."""
    source = F.col("provenance.source")
    return approvals.select(
        "entry_id",
        "entry_version",
        keyed_hash(F.col("repo_id"), key).alias("repo_id_hash"),
        F.lit(True).alias("repo_id_redacted"),
        F.col("remote_url").isNotNull().alias("has_remote_url"),
        keyed_hash(F.col("remote_url"), key).alias("remote_url_hash"),
        "head_commit",
        "critical_fingerprint",
        "command_scope",
        "decision",
        "approved_at",
        "expires_at",
        "approved_by",
        "policy_version",
        "ruleset_version",
        F.struct(
            F.col("provenance.schema").alias("schema"),
            source.alias("source"),
            F.col("provenance.migration_version").alias("migration_version"),
            F.coalesce(source == "legacy-migration", F.lit(False)).alias("migrated"),
            F.col("provenance.migrated_at").alias("migrated_at"),
            F.col("provenance.created_at").alias("created_at"),
        ).alias("provenance"),
    )


def order_approvals(public: DataFrame) -> DataFrame:
    """K2."""
    return public.orderBy(*LISTING_ORDER)


def page_approvals(public: DataFrame, after=None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """K3. The page after the row ``after`` (a mapping of the listing columns).

    Paging by key never skips or repeats rows and never sorts more than ``limit + 1`` rows per
    task. ``complete`` tells whether this is the last page.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 through {MAX_PAGE}")
    if after is not None:
        here = F.struct(*LISTING_ORDER)
        types = public.select(*LISTING_ORDER).schema
        last = F.struct(*[F.lit(after[f.name]).cast(f.dataType).alias(f.name) for f in types])
        public = public.where(here > last)
    page = public.orderBy(*LISTING_ORDER).limit(limit + 1)
    whole = Window.partitionBy()  # at most limit + 1 rows
    return (
        page.withColumn("complete", F.count("*").over(whole) <= limit)
        .orderBy(*LISTING_ORDER)
        .limit(limit)
    )


def snapshot_digest(approvals: DataFrame, key: bytes, prefix: int = 4) -> DataFrame:
    """A16. Keyed digest of a listing.

    Rows are hashed, spread by the first ``prefix`` hex digits of their hash, and digested per
    bucket; the buckets are then digested in order. The result does not depend on row order or
    partitioning, and no task sees more than one bucket.
    """
    fields = {name: F.col(name) for name in approvals.columns}
    rows = approvals.select(F.sha2(canonical_json(fields), 256).alias("row"))
    buckets = rows.groupBy(F.substring("row", 1, prefix).alias("bucket")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("row")), "\n"), 256).alias("digest")
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda b: b.getField("digest")), "\n")
    return buckets.agg(F.concat(F.lit("hmac-sha256:"), hmac_sha256(F.encode(joined, "UTF-8"), key)).alias("digest"))


def revoke(approvals: DataFrame, repo_id: str, now: Column, scope: str | None = None) -> DataFrame:
    """Approvals left after a revocation; expired ones go too."""
    gone = F.col("repo_id") == repo_id
    if scope is not None:
        gone = gone & (F.col("command_scope") == scope)
    return approvals.where((F.col("expires_at") > now) & ~gone)


def revoke_count(approvals: DataFrame, repo_id: str, now: Column, scope: str | None = None) -> DataFrame:
    """A19. How many live approvals a revocation removes."""
    live = filter_approvals(approvals, repo_id, scope).where(F.col("expires_at") > now)
    return live.agg(F.count("*").alias("removed"))
