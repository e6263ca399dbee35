"""Documentation links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.catalogue import rules as R
from riskspark.functions.regex import jre
from riskspark.functions.rows import exploded, numbered
from riskspark.functions.text import collapse_ws, ellipsize, line_number
from riskspark.operators.scan import describe, rule_applies

_MARK = "\u0002"
_HOST = "github.com"


def _clean_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[.,;:]+\z", "")


def _contexts(text: Column, pattern: str) -> Column:
    """Whole line, whitespace collapsed, of each match in order.

    Match starts are marked before the text is cut into lines, so a line yields its context once
    per match that starts on it and the result lines up with the extracted groups.
    """
    lines = F.split(F.regexp_replace(text, pattern, _MARK + "$0"), "\n")
    per_line = F.transform(
        F.filter(lines, lambda line: F.contains(line, F.lit(_MARK))),
        lambda line: F.array_repeat(
            collapse_ws(F.replace(line, F.lit(_MARK), F.lit(""))),
            F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit(""))),
        ),
    )
    return F.flatten(per_line)


def _matches(text: Column, pattern: str, label_group: int, url_group: int, raw: bool) -> Column:
    urls = F.regexp_extract_all(text, F.lit(pattern), url_group)
    labels = urls if raw else F.regexp_extract_all(text, F.lit(pattern), label_group)
    zipped = F.arrays_zip(labels.alias("label"), urls.alias("url"), _contexts(text, pattern).alias("context"))
    return F.transform(
        zipped,
        lambda m: F.struct(
            (_clean_url(m.getField("url")) if raw else m.getField("label")).alias("label"),
            _clean_url(m.getField("url")).alias("url"),
            m.getField("context").alias("context"),
            F.lit(raw).alias("raw"),
        ),
    )


def extract_links(docs: DataFrame) -> DataFrame:
    """R13. Badge, markdown, then bare links; a bare URL already listed is skipped."""
    text = F.when(F.contains(F.lower("text"), F.lit("http")) | F.contains(F.col("text"), F.lit("](")), F.col("text"))
    clean = F.replace(text, F.lit(_MARK), F.lit(" "))
    found = F.concat(
        _matches(clean, jre(R.BADGE_LINK, "i"), 1, 2, raw=False),
        _matches(clean, jre(R.MARKDOWN_LINK, "i"), 1, 2, raw=False),
        _matches(clean, jre(f"({R.RAW_URL})", "i"), 1, 1, raw=True),
    )
    listed = docs.where(F.col("text").isNotNull()).withColumn("found", found).withColumn("urls", F.col("found.url"))
    return (
        numbered(listed, F.col("found"), "ord", "link")
        .where(~F.col("link.raw") | (F.array_position("urls", F.col("link.url")) == F.col("ord") + 1))
        .select(
            "repo_id",
            "snapshot_id",
            "path",
            "ord",
            "link.label",
            "link.url",
            "link.context",
            line_number(F.col("text"), F.col("link.url")).alias("line"),
        )
    )


def docs_origin(docs: DataFrame, origins: DataFrame) -> DataFrame:
    """J15. Add the slug of the repository's own origin; null where unknown."""
    slugs = origins.groupBy("repo_id").agg(F.min(F.lower("origin_slug")).alias("origin_slug"))
    return docs.join(slugs, "repo_id", "left")


def origin_slug(config_text: Column) -> Column:
    """Owner and repository named by a git configuration text."""
    pattern = jre(
        r"url\s*=\s*(?:https://github\.com/|git@github\.com:)([^/\s]+/[^/\s]+?)(?:\.git)?\s*$", "m"
    )
    slug = F.regexp_extract(config_text, pattern, 1)
    return F.when(slug != "", F.lower(slug))


def _url_parts(url: Column) -> tuple[Column, Column]:
    scheme = r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
    host = F.lower(F.regexp_extract(url, rf"^{scheme}//([^/?#]*)", 1))
    path = F.regexp_extract(url, rf"^{scheme}(?://[^/?#]*)?([^?#]*)", 1)
    return host, F.regexp_replace(path, r";[^/]*\z", "")


def link_flags(links: DataFrame) -> DataFrame:
    """What wording, host and path say about a link, before any origin is known."""
    host, path = _url_parts(F.col("url"))
    wording = F.concat_ws(" ", "label", "context")
    return links.withColumns(
        {
            "release_words": wording.rlike(jre(R.RELEASE_WORDS, "i")),
            "installer_words": wording.rlike(jre(R.INSTALLER_WORDS, "i")),
            "raw_source": F.col("url").rlike(jre(R.RAW_SOURCE, "i")),
            "risky_payload": path.rlike(jre(R.RISKY_PAYLOAD, "i")),
            "parts": F.when(host == _HOST, F.split(F.regexp_replace(F.lower(path), r"^/+|/+\z", ""), "/")),
        }
    ).where(F.col("release_words") | F.col("installer_words") | (F.col("raw_source") & F.col("risky_payload")))


def classify_links(links: DataFrame, origins: DataFrame) -> DataFrame:
    """R14. First link per file and rule that its wording, host and shape give away.

    Only links that could matter are joined to origins; the winner per file and rule is a partial
    aggregate, so a document with any number of links never gathers in one place.
    """
    flagged = docs_origin(link_flags(links), origins)
    parts = F.col("parts")
    own = F.col("origin_slug").isNull() | (F.concat_ws("/", parts[0], parts[1]) == F.col("origin_slug"))
    release_page = F.coalesce((F.size(parts) >= 3) & (F.try_element_at(parts, F.lit(3)) == "releases") & own, F.lit(False))
    release_asset = F.coalesce(
        (F.size(parts) >= 5)
        & (F.try_element_at(parts, F.lit(3)) == "releases")
        & (F.try_element_at(parts, F.lit(4)) == "download")
        & own,
        F.lit(False),
    )
    release, installer = F.col("release_words"), F.col("installer_words")
    raw, risky = F.col("raw_source"), F.col("risky_payload")
    label = ellipsize(collapse_ws(F.col("label")), 80)
    short = ellipsize(F.col("url"), 160)

    def entry(condition: Column, rule: str, order: int, evidence: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(R.rule_number(rule)).alias("no"),
                (F.col("ord") * 3 + order).cast("int").alias("ord"),
                F.col("line").alias("line"),
                evidence.alias("evidence"),
            ),
        )

    arrow = F.concat(label, F.lit(" -> "), short)
    entries = F.array(
        entry(release & ~raw & ~release_page, "README_FAKE_RELEASE_LINK", 0, arrow),
        entry(
            (installer | (risky & release & ~raw)) & ~release_asset, "README_INSTALLER_FROM_NON_RELEASE_HOST", 1, arrow
        ),
        entry(
            raw & (release | risky), "README_RAW_SOURCE_ARCHIVE_DOWNLOAD", 2, F.concat(F.lit("raw archive -> "), short)
        ),
    )
    first = (
        exploded(flagged, entries, "e")
        .groupBy("repo_id", "snapshot_id", "path", "e.no")
        .agg(F.min_by("e", "e.ord").alias("e"))
        .select("repo_id", "snapshot_id", "path", "e.*")
    )
    return describe(first)


def documents(files: DataFrame) -> DataFrame:
    return files.where(rule_applies("readme", F.col("path")))
