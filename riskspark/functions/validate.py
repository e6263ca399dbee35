"""Field, URL, reference and path checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.paths import strip

# Fixed values.
URL_ERROR = "MCP_REMOTE_URL_INVALID"
REF_ERROR = "MCP_REMOTE_REF_INVALID"
TREE_ERROR = "MCP_REMOTE_TREE_UNSAFE"
CLONE_ERROR = "UNSUPPORTED_CLONE_URL"
RESERVED_REFS = ("HEAD", "FETCH_HEAD", "ORIG_HEAD", "MERGE_HEAD", "CHERRY_PICK_HEAD", "REVERT_HEAD")
RESERVED_DEVICES = ("CON", "PRN", "AUX", "NUL")
LFS_HEADER = "version https://git-lfs.github.com/spec/v1\n"
HOST = "github.com"

_UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
_COMMIT = r"^[0-9a-f]{40}\z"
_FINGERPRINT = r"^sha256:[0-9a-f]{64}\z"


def is_uuid4(value: Column) -> Column:
    return F.coalesce(value.rlike(_UUID4), F.lit(False))


def is_commit(value: Column) -> Column:
    return F.coalesce(value.rlike(_COMMIT), F.lit(False))


def is_fingerprint(value: Column) -> Column:
    return F.coalesce(value.rlike(_FINGERPRINT), F.lit(False))


def bounded_field(value: Column, max_bytes: int = 4096) -> Column:
    """Non-empty, at most ``max_bytes`` of UTF-8, no control characters."""
    return F.coalesce(
        (F.octet_length(value) > 0)
        & (F.octet_length(value) <= max_bytes)
        & ~value.rlike(r"[\x00-\x1f\x7f-\x9f]"),
        F.lit(False),
    )


def validate_repo_url(url: Column) -> Column:
    """Canonical public HTTPS repository URL, split into owner and repository."""
    pattern = rf"^https://(?i:{HOST.replace('.', chr(92) + '.')})/([^/]+)/([^/]+)/?\z"
    owner = F.regexp_extract(url, pattern, 1)
    repository = F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git\z", "")
    ok = F.coalesce(
        ~url.rlike(r"[\x00-\x20\x7f\\%?#@]")
        & url.rlike(pattern)
        & owner.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?\z")
        & ~F.contains(owner, F.lit("--"))
        & repository.rlike(r"^[A-Za-z0-9_][A-Za-z0-9._-]{0,99}\z")
        & ~repository.rlike(r"[.-]\z"),
        F.lit(False),
    )
    return F.struct(
        F.when(ok, owner).alias("owner"),
        F.when(ok, repository).alias("repository"),
        F.when(ok, F.concat(F.lit(f"https://{HOST}/"), owner, F.lit("/"), repository)).alias("canonical_url"),
        F.when(~ok, F.lit(URL_ERROR)).alias("error_code"),
    )


def validate_ref(ref: Column) -> Column:
    """Explicit safe branch, tag, full ref or 40-hex commit (lower-cased)."""
    full = ref.rlike(r"^[0-9a-fA-F]{40}\z")
    bad = (
        (F.length(ref) == 0)
        | (F.length(ref) > 255)
        | (ref != strip(ref))
        | ref.rlike(r"^[-+/.]|[/.]\z|^@\z")
        | F.upper(ref).isin(*RESERVED_REFS)
        | ref.rlike(r"(?U)[\x00-\x1f\x7f]|[\\:*?\[\]~^\s]|\.\.|@\{|//")
        | ref.rlike(r"(?:^|/)\.|\.lock(?:/|\z)")
    )
    ok = F.coalesce(full | ~bad, F.lit(False))
    return F.struct(
        F.when(ok, F.when(full, F.lower(ref)).otherwise(ref)).alias("ref"),
        F.when(~ok, F.lit(REF_ERROR)).alias("error_code"),
    )


def validate_clone_url(url: Column) -> Column:
    """Only ``https`` clone URLs pass."""
    trimmed = strip(url)
    ok = F.coalesce(trimmed.rlike(r"^(?i:https):"), F.lit(False))
    return F.struct(
        F.when(ok, trimmed).alias("url"),
        F.when(~ok, F.lit(CLONE_ERROR)).alias("error_code"),
    )


def classify_location(value: Column) -> Column:
    """``local``, ``remote`` or ``empty`` for text given where a local path is expected."""
    raw = strip(value)
    slashed = F.translate(raw, "\\", "/")
    drive = raw.rlike(r"^[A-Za-z]:")
    remote = (
        slashed.startswith("//")
        | (~drive & slashed.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/"))
        | (~drive & raw.rlike(r"(?d)^(?:[^@\s/\\]+@)?[^:\s/\\]+:.+"))
        | raw.rlike(r"^(?i:git\s+clone|gh\s+repo\s+clone|hg\s+clone|svn\s+checkout)\b")
    )
    return F.when(raw == "", F.lit("empty")).when(remote, F.lit("remote")).otherwise(F.lit("local"))


def validate_tree_path(path: Column, max_depth: int = 32) -> Column:
    """Null for a safe tree path, otherwise the error code."""
    devices = "|".join(RESERVED_DEVICES)
    parts = F.filter(F.split(path, "/"), lambda part: ~part.isin("", "."))
    unsafe_part = rf"^\.\.\z|[. ]\z|^(?i:{devices}|COM[1-9]|LPT[1-9])(?:\.|\z)"
    bad = (
        (F.length(path) == 0)
        | path.rlike(r"[\x00-\x1f\x7f\\:]")
        | path.startswith("/")
        | (F.size(parts) > max_depth)
        | F.exists(parts, lambda part: part.rlike(unsafe_part))
    )
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(TREE_ERROR))


def entry_kind(mode: Column, object_type: Column, head: Column | None = None) -> Column:
    """What a tree entry is; ``head`` is the start of its content where known."""
    regular = mode.isin("100644", "100755") & (object_type == "blob")
    kind = F.when((mode == "160000") & (object_type == "commit"), F.lit("submodule")).when(
        (mode == "120000") & (object_type == "blob"), F.lit("symlink")
    )
    if head is not None:
        kind = kind.when(regular & F.coalesce(head.startswith(LFS_HEADER), F.lit(False)), F.lit("lfs_pointer"))
    return kind.when(regular, F.lit("regular")).otherwise(F.lit("invalid"))
