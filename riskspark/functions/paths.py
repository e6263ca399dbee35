"""Path parts and path clean-up as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent directory, ``''`` at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; a leading dot starts a name, not an extension."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)/*$", 1)


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")).cast("int")


def ancestor_dirs(path: Column) -> Column:
    """All directories above ``path``, outermost first."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def strip(value: Column) -> Column:
    """Trim whitespace of any kind on both ends."""
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_quotes(value: Column) -> Column:
    return F.regexp_replace(value, "^[\"']+|[\"']+$", "")


def normalize_path(token: Column) -> Column:
    """Command token to repository path: trim, unquote, forward slashes, no leading ``./``."""
    cleaned = F.translate(strip_quotes(strip(token)), "\\", "/")
    return F.regexp_replace(cleaned, r"^\./", "")


def collapse_dots(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty parts; what would leave the root keeps a leading ``..``."""
    empty = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        empty,
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(
            (part == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        )
        .otherwise(F.concat(acc, F.array(part))),
    )
    return F.array_join(parts, "/")


def join_path(base: Column, target: Column) -> Column:
    return collapse_dots(F.when(base == "", target).otherwise(F.concat_ws("/", base, target)))


def _nfc_casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).casefold())


def collision_key(path: Column) -> Column:
    """NFC and case folding, which no built-in offers; vectorised per Arrow batch."""
    return F.pandas_udf(_nfc_casefold, StringType())(path)
