"""WARC derivative builder: metadata and conversion records from response records.

A response keeps its identity: both derived records carry WARC-Refers-To with the response's record id, its target URI and
date, and the metadata record lists the source's headers, each as it was and in order, and its payload digest. Records are
rows; `to_bytes` gives each its WARC/1.1 serialisation (one gzip member), which concatenated are a file, and `parse` reads
such bytes back. All patterns take time in proportion to a page: what is opened and never closed reaches to its end.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, text_batches

#: Namespace that record ids of sources without one are derived in.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:warc")
#: Date of responses that bring none.
EPOCH = "1970-01-01T00:00:00Z"

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "source_headers", "block")]
                      + [T.StructField("content_length", T.LongType())])

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*(?:>|\Z)", re.I)
_TAG = re.compile(r"<[a-z/!?][^>]*(?:>|\Z)", re.I)
_LINK = re.compile(r"<(a|link|img|script|iframe)\b([^>]*)(?:>|\Z)", re.I)
_TARGET = re.compile(r"\b(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*>([^<]*)", re.I)
_HTML = re.compile(r"<html\b([^>]*)", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(block: bytes) -> str:
    """Labelled digest as WARC files write it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def plain_text(markup: str) -> str:
    """Visible text: scripts, styles and comments go, block elements break lines, entities are decoded, blanks collapse."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROPPED.sub(" ", markup))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def metadata(markup: str, refers_to: str, headers: list[tuple[str, str]], payload_digest: str) -> str:
    """application/warc-fields: the source's headers and digest, title, declared language and outlinks, in document order.
    A header is one field, `source-header: Name: value`, verbatim but for line ends, which become blanks."""
    clean = lambda s: " ".join(html.unescape(s).split())
    fields = [("via-record", refers_to), ("source-payload-digest", payload_digest)]
    fields += [("source-header", f"{one_line(k)}: {one_line(v)}") for k, v in headers]
    if m := _TITLE.search(markup):
        fields.append(("title", clean(m[1])))
    if (m := _HTML.search(markup)) and (m := _LANG.search(m[1])):
        fields.append(("declared-language", m[1]))
    for tag, inside in _LINK.findall(markup):
        if m := _TARGET.search(inside):
            fields.append(("outlink", f"{clean(m[2] or m[3] or m[4] or '')} {tag.lower()}/{m[1].lower()}"))
    return "".join(f"{k}: {v}\r\n" for k, v in fields)


def one_line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def derive(record_id: str, uri: str | None, date: str | None, headers: list[tuple[str, str]], payload: str) -> list[dict]:
    source = digest(payload.encode("utf-8", "surrogatepass"))
    out = []
    for kind, content_type, block in (
        ("metadata", "application/warc-fields", metadata(payload, record_id, headers, source)),
        ("conversion", "text/plain; charset=utf-8", plain_text(payload)),
    ):
        raw = block.encode("utf-8", "surrogatepass")
        out.append({
            "record_type": kind, "record_id": f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind}|{record_id}')}>", "refers_to": record_id, "target_uri": uri, "date": date or EPOCH,
            "content_type": content_type, "block_digest": digest(raw), "payload_digest": source, "source_headers": "".join(f"{one_line(k)}: {one_line(v)}\r\n" for k, v in headers), "block": block, "content_length": len(raw),
        })
    return out


def derivatives(
    responses: DataFrame, *, id_col: str = "page_id", url: Column | None = None, payload: Column | None = None, record_id: Column | None = None,
    date: Column | None = None, headers: Column | None = None,
) -> DataFrame:
    """Two rows per response: its id column and the fields of a metadata and a conversion record.

    headers is an array of structs (name, value), of which names may repeat and the order is kept, or a map of strings, whose
    entries are sorted; names and values are kept as they are. A source without headers has none in its records: nothing is
    made up. A missing record id is derived from the id and the address, so it is the same on every run; a missing date is
    the epoch's. A null payload counts as empty and a null address stays null; both still give two linked records with the
    digests of empty blocks. Very long payloads are converted whole. Repeated rows repeat their records; an empty table gives
    none. Only the named columns are read, so others may have any name; an id column named as a field of the record is refused.
    """
    if id_col in RECORD.fieldNames():
        raise ValueError(f"the id column is named as the record's field {id_col}")
    text_batches(responses.sparkSession)
    none = F.lit(None).cast("string")
    rows = responses.select(
        F.col(id_col), (F.col("url") if url is None else url).alias("url"), (F.col("html") if payload is None else payload).alias("text"), (none if record_id is None else record_id).alias("record"),
        (none if date is None else date.cast("string")).alias("date"), (headers if headers is not None else F.array().cast("array<struct<name:string,value:string>>")).alias("headers"),
    )
    sort = isinstance(rows.schema["headers"].dataType, T.MapType)
    if sort:
        rows = rows.withColumn("headers", F.map_entries("headers"))
    schema = T.StructType([rows.schema.fields[0], *RECORD.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                keys, found = [], []
                for i, r in enumerate(batch.select(["url", "text", "record", "date", "headers"]).to_pylist()):
                    own = r["record"] or f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'response|{batch.column(0)[i].as_py()}|{r['url']}')}>"
                    pairs = [tuple(x or "" for x in h.values()) for h in r["headers"] or [] if h]
                    if sort:
                        pairs.sort()
                    for record in derive(own, r["url"], r["date"], pairs, r["text"] or ""):
                        keys.append(i)
                        found.append(record)
                arrays = [pa.array([f[c.name] for f in found], pa.int64() if c.name == "content_length" else pa.string()) for c in RECORD.fields]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *arrays], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def to_bytes(record: dict) -> bytes:
    """One gzip member holding the WARC/1.1 record. WARC-Payload-Digest is that of the payload it refers to, the source's."""
    block = (record["block"] or "").encode("utf-8", "surrogatepass")
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Date", record["date"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Payload-Digest", record["payload_digest"]), ("Content-Type", record["content_type"]), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def serialise(records: DataFrame) -> DataFrame:
    """The records' id column and `warc`: bytes that are a WARC file when concatenated in any order."""
    schema = T.StructType([records.schema.fields[0], T.StructField("warc", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [to_bytes(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], schema.fieldNames())

    return records.mapInArrow(run, schema)


def parse(data: bytes) -> list[dict]:
    """Records of a (gzipped) WARC file: a dict of lower-cased headers, and the block under 'block'."""
    raw, out, at = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        out.append(fields | {"version": version, "block": raw[end + 4 : end + 4 + size]})
        at = end + 4 + size + 4
    return out
