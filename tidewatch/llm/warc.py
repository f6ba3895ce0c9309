"""WARC derivatives: every response record gives a metadata record and a plain-text conversion record that refer to it."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid

from pyspark.sql import DataFrame

from tidewatch.llm.common import slices

CRLF = "\r\n"
#: Elements whose content isn't text of the page, and those that break a line.
SILENT = "script|style|template|noscript|head|svg"
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
#: Outside quotes a tag ends before the next "<", so that text without any ">" is scanned once, not once for each "<".
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(""" + SILENT + r""")\b[^<>]*>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][a-zA-Z0-9]*)(?:"[^"]*"|'[^']*'|[^"'<>])*>|<[!?][^<>]*>""", re.S | re.I)
_TITLE = re.compile(r"<title[^<>]*>", re.I)
_HREF = re.compile(r"""<a\s(?:[^<>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s<>]+)""", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
DERIVED = "source_id string, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, block_digest string, content_length long, headers map<string,string>, block string"


def digest(data: bytes) -> str:
    """A labelled digest, as WARC headers hold it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that is the same each time it is derived from the same parts."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def plain_text(page: str) -> str:
    """Text of an HTML page: no comments, scripts or head; block elements end lines; entities are resolved."""
    made = _TAG.sub(lambda m: "\n" if m[2] and m[2].lower() in BREAKS else "", page)
    lines = (" ".join(x.split()) for x in html.unescape(made).split("\n"))
    return "\n".join(x for x in lines if x)


def response_record(uri: str, page: str, date: str, ident: str) -> bytes:
    """A WARC response record, uncompressed, for a page that was fetched."""
    payload = page.encode()
    block = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode() + payload
    head = {"WARC-Type": "response", "WARC-Record-ID": ident, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return serialise(head, block)


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """The bytes of a record."""
    return f"WARC/1.1{CRLF}{''.join(f'{k}: {v}{CRLF}' for k, v in headers.items())}{CRLF}".encode() + block + b"\r\n\r\n"


class Fields:
    """Header fields in order; names are found in any case, the first of repeated ones."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = pairs
        self._first = {name.lower(): value for name, value in reversed(pairs)}

    def get(self, name: str, default: str = "") -> str:
        return self._first.get(name.lower(), default)

    def __getitem__(self, name: str) -> str:
        return self._first[name.lower()]

    def json(self) -> dict[str, str | list[str]]:
        """By name as it was written; the values of repeated fields as a list."""
        out: dict = {}
        for name, value in self.pairs:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value] if name in out else value
        return out


def parse_headers(data: bytes) -> Fields:
    """Header fields, folded lines joined."""
    lines = (line.partition(":") for line in re.sub(rb"\r?\n[ \t]+", b" ", data).decode("utf-8", "replace").splitlines())
    return Fields([(name.strip(), value.strip()) for name, colon, value in lines if colon])


def parse_record(record: bytes) -> tuple[Fields, bytes]:
    """Headers and block of an uncompressed record; a block that is shorter than its length says is taken as it is."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = parse_headers(head.partition(b"\n")[2])
    length = headers.get("Content-Length")
    return headers, rest[: int(length)] if re.fullmatch("[0-9]{1,18}", length) else rest


def decoded(payload: bytes, kind: str) -> str:
    """The text of a payload by the charset of its content type; UTF-8 where that names none that text can be decoded by."""
    charset = re.search(r"charset=[\"']?([\w-]+)", kind, re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def title_of(page: str) -> str | None:
    """What stands in a page's first title, if that is closed."""
    begin = _TITLE.search(page)
    end = re.compile("</title", re.I).search(page, begin.end()) if begin else None
    return html.unescape(page[begin.end() : end.start()]).strip() if end else None


def derive(record: bytes) -> list[tuple]:
    """DERIVED rows, without source_id, of one record: metadata, then conversion; none if it isn't a response."""
    headers, block = parse_record(record)
    if headers.get("WARC-Type").lower() != "response":
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    http = parse_headers(head.partition(b"\n")[2])
    page = decoded(payload, http.get("Content-Type"))
    source, uri, date = (headers.get(f"WARC-{x}") for x in ("Record-ID", "Target-URI", "Date"))
    paid = headers.get("WARC-Payload-Digest") or digest(payload)
    bare = _COMMENT.sub("", page)
    links = [html.unescape(x.strip("\"'")) for x in _HREF.findall(bare)]
    status = head.split(b"\r\n", 1)[0].decode("latin-1")
    envelope = {"warc-header": headers.json(), "http-response": {"status": status, "headers": http.json(), "payload-digest": digest(payload), "payload-length": len(payload)}, "html": {"title": title_of(bare), "links": links}}
    out = []
    for kind, content, text in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", plain_text(page))):
        data = text.encode("utf-8", "replace")
        made = {"WARC-Type": kind, "WARC-Record-ID": record_id(source, uri, date, kind), "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": paid, "WARC-Block-Digest": digest(data), "Content-Type": content, "Content-Length": str(len(data))}
        out.append((kind, made["WARC-Record-ID"], source, uri, date, paid, made["WARC-Block-Digest"], len(data), made, data.decode()))
    return out


def response_records(pages: DataFrame, *, id: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(source_id, record): a response record for each row of pages, with an id of its url and content; null urls and pages count as empty."""
    import pyarrow as pa

    source = pages.select(pages[id].cast("string"), pages[url].cast("string"), pages[page].cast("string"))

    def run(batches):
        for batch in slices(batches):
            ids, urls, texts = (c.to_pylist() for c in batch.columns)
            made = [response_record(u or "", t or "", date, record_id("response", str(i), u or "", digest((t or "").encode()))) for i, u, t in zip(ids, urls, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(made, pa.binary())], names=["source_id", "record"])

    return source.mapInArrow(run, "source_id string, record binary")


def derivatives(records: DataFrame, *, id: str = "source_id", record: str = "record") -> DataFrame:
    """DERIVED rows of WARC records (uncompressed, one to a row): two for each response, in place, without a shuffle.

    Both refer to the response by its id, uri and date and keep its payload digest; the metadata block has all source
    headers as JSON. Ids are derived from the source's, so repeated rows and repeated runs give equal records. Null
    records and those of other types give no rows; a response with an empty page gives an empty conversion. Header names
    count in any case, and repeated fields are all kept. A charset that is no text encoding counts as UTF-8. Payloads are
    taken as they are: chunked and compressed ones, and gzip members of records, aren't unpacked. Other columns are not read.
    """
    import pyarrow as pa

    schema = pa.schema([("source_id", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.string())])

    def run(batches):
        for batch in slices(batches):
            rows = [(i, *r) for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x is not None for r in derive(bytes(x))]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if f.name == "headers" else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return records.select(records[id].cast("string"), records[record].cast("binary")).mapInArrow(run, DERIVED)


def record_bytes(headers: dict[str, str], block: str) -> bytes:
    """The bytes of a derived record, ready to be appended to a WARC file."""
    return serialise(headers, block.encode())
