"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Every response yields one ``metadata`` and one ``conversion`` record (WARC/1.1). Both refer to the response by its
record identifier, keep its target address and date, and carry what later stages need of the source: its HTTP headers
(in the metadata block, field by field, in their order) and its block and payload digests. The conversion block is the
visible text of the page, one line per leaf block, with a block digest of its own.

Identifiers are derived from the response (type and refers-to identifier), so a task that runs again after a lost
executor writes the same records, and a rerun can be compared row by row. Digests are labelled ``sha256:`` and in hex.

Defined results: a null payload is empty (digest of nothing, no text); null headers are none; a null address or date is
left out of the record's header; a null record identifier gives no refers-to line. Equal responses yield equal
records. One pass, no shuffle; a record is never cut.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.html_blocks import leaf_blocks
from riskspark.llm.textbytes import small_batches

VERSION = "WARC/1.1"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_payload_digest string, source_block_digest string, block_digest string, content_length long, block string"
)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of addresses (fixed value)


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as WARC responses: identifier, address, date, HTTP headers and payload.

    The tables hold no transfer headers; what a server sends for the page at least is derived from it.
    """
    body = F.coalesce(pages[html].cast("string"), F.lit(""))
    identity = F.sha2(F.concat_ws("\n", pages[id_col].cast("string"), F.coalesce(pages[url], F.lit("")), body), 256)
    headers = F.array(
        F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")),
        F.struct(F.lit("Content-Length").alias("name"), F.octet_length(body).cast("string").alias("value")),
    )
    return pages.select(
        pages[id_col].alias("source_id"),
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(identity, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        pages[url].alias("target_uri"), F.lit(date).alias("warc_date"), F.lit("HTTP/1.1 200 OK").alias("status_line"), headers.alias("headers"),
        pages[html].cast("string").alias("payload"),
    )


def _digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def _line(value: object) -> str:
    """A header value on one line: a line break inside would begin another field."""
    return " ".join(str(value).split())


def http_block(status_line: str | None, headers: list[dict] | None, payload: str) -> bytes:
    """The response as sent: status line, headers, empty line, payload."""
    lines = [status_line or "HTTP/1.1 200 OK", *(f"{_line(h['name'])}: {_line(h['value'] or '')}" for h in headers or [] if h and h["name"])]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload.encode()


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload = response["payload"] or ""
    source = http_block(response["status_line"], response["headers"], payload)
    source_id, payload_digest = response["record_id"], _digest(payload.encode())
    text = "\n".join(b.text for b in leaf_blocks(payload))
    fields = [("status", response["status_line"] or "HTTP/1.1 200 OK"), ("payload-digest", payload_digest), ("block-digest", _digest(source))]
    fields += [(f"http-header-{h['name'].lower()}", h["value"] or "") for h in response["headers"] or [] if h and h["name"]]
    fields += [("text-digest", _digest(text.encode())), ("text-characters", len(text))]
    metadata = "".join(f"{_line(k)}: {_line(v)}\r\n" for k, v in fields)
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        name = f"{kind}:{source_id if source_id is not None else _digest(source)}"
        out.append(
            {
                "record_type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>", "refers_to": source_id,
                "target_uri": response["target_uri"], "warc_date": response["warc_date"], "content_type": content_type,
                "source_payload_digest": payload_digest, "source_block_digest": _digest(source), "block_digest": _digest(block.encode()),
                "content_length": len(block.encode()), "block": block,
            }
        )
    return out


def serialise(record: dict) -> bytes:
    """The record in WARC format: version, named fields, block, two empty lines."""
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Target-URI", record["target_uri"]), ("WARC-Date", record["warc_date"]), ("WARC-Payload-Digest", record["source_payload_digest"]),
        ("WARC-Block-Digest", record["block_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", record["content_length"]),
    ]
    head = "".join(f"{name}: {_line(value)}\r\n" for name, value in fields if value is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + record["block"].encode() + b"\r\n\r\n"


def _records(rows: Iterator[pa.RecordBatch], keep: list[str], names: list[str], as_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found: list[dict] = []
        source: list[int] = []
        for i, response in enumerate(batch.select([c for c in batch.schema.names if c not in keep]).to_pylist()):
            derived = derive({k[2:]: v for k, v in response.items()})
            found += derived
            source += [i] * len(derived)
        columns = [batch.column(k).take(pa.array(source, pa.int64())) for k in keep]
        columns += [pa.array([r[n] for r in found], pa.int64() if n == "content_length" else pa.string()) for n in names]
        if as_bytes:
            columns.append(pa.array([serialise(r) for r in found], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names, *["warc"] * as_bytes])


def derivatives(responses: DataFrame, keep: list[str] | None = None, as_bytes: bool = False) -> DataFrame:
    """Two records per row of ``responses`` (``record_id, target_uri, warc_date, status_line, headers, payload``).

    ``keep``: columns of ``responses`` to carry along (default: those a record does not have itself). ``as_bytes`` adds
    the records in WARC format (column ``warc``), ready to be written to files one after the other.
    """
    inputs = ["record_id", "target_uri", "warc_date", "status_line", "headers", "payload"]
    names = [f.strip().split()[0] for f in RECORD.split(",")]
    keep = [c for c in (responses.columns if keep is None else keep) if c not in inputs and c not in names and c != "warc"]
    source = small_batches(responses.select(*[responses[c] for c in keep], *[responses[c].alias(f"__{c}") for c in inputs]))
    schema = source.select(*keep).schema
    for field in RECORD.split(","):
        schema = schema.add(*field.split())
    if as_bytes:
        schema = schema.add("warc", "binary")
    return source.mapInArrow(lambda rows: _records(rows, keep, names, as_bytes), schema)
