"""Crawl records: derivatives (metadata and plain text) of response records, linked by identifiers and digests."""

from __future__ import annotations

import codecs
import hashlib
import html
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
EOL = "\r\n"
#: Elements whose content is no text of the page, and elements that end a line of it. Fixed values of HTML.
HIDDEN = ("script", "style", "template", "noscript", "textarea", "select")
TO_THE_END = ("script", "style")  # of these, the ones that hide the rest of a page where they are not closed
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_DECLARED = re.compile(rb"<meta[^>]{0,400}?charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_LABELS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252"}  # as browsers read them
BREAKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
_BLANKS = re.compile(r"[^\S\n]+")
RECORD = "warc_type string, record_id string, headers map<string,string>, block binary"
DERIVED = "source_id string, " + RECORD
_RECORD_TYPE = [("warc_type", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]


def record_id(*parts: str) -> str:
    """An identifier that follows from its parts, so that a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def digest(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode("ascii")


def header_value(text: str) -> str:
    """A value on one line: control characters would end the header."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", text).strip()


def to_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """The record as it stands in a WARC file."""
    head = VERSION + EOL + "".join(f"{k}: {v}{EOL}" for k, v in headers.items())
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records in a WARC file's bytes; the inverse of ``to_bytes``."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "surrogatepass").split(EOL)
        if lines[0] != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        length = int(headers["Content-Length"])
        out.append((headers, data[stop + 4 : stop + 4 + length]))
        at = stop + 4 + length + 4
    return out


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers (lower-case names, in order, repeated ones too) and body of an HTTP response.

    A line that starts with white space goes on with the value before it. Without a status line all of it is body.
    """
    if not block.startswith(b"HTTP/"):
        return None, [], block
    head, found, body = block.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split(EOL)
    words = first.split()
    fields: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip()
        else:
            name, has, value = line.partition(":")
            if has:
                fields.append((name.strip().lower(), value.strip()))
    return (int(words[1]) if len(words) > 1 and words[1].isdigit() else None), fields, body if found else b""


def _field(fields: list[tuple[str, str]], name: str) -> str:
    """All values of a header, as one list."""
    return ", ".join(v for k, v in fields if k == name)


def _without_chunks(body: bytes) -> bytes | None:
    """The body of a chunked transfer; None where the chunks are broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n > len(body):
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def _inflated(body: bytes, coding: str) -> bytes | None:
    """The content of a gzip, deflate or zstd body; None where it is no such body. Members of gzip follow each other."""
    try:
        if coding in ("gzip", "x-gzip"):
            out, rest = [], body
            while rest.startswith(b"\x1f\x8b"):
                member = zlib.decompressobj(zlib.MAX_WBITS | 16)
                out.append(member.decompress(rest) + member.flush())
                rest = member.unused_data
            return b"".join(out) if out else None
        if coding == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -zlib.MAX_WBITS)
        if coding == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as reader:
                return reader.read()
    except Exception:  # noqa: BLE001  whatever a broken body makes a decoder say
        return None
    return None


def content_of(fields: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content codings. Codings that are broken or not known are left as they are."""
    if "chunked" in _field(fields, "transfer-encoding").lower():
        whole = _without_chunks(body)
        body = body if whole is None else whole
    codings = [c.strip().lower() for c in _field(fields, "content-encoding").split(",") if c.strip()]
    for coding in reversed(codings):
        if coding != "identity":
            opened = _inflated(body, coding)
            if opened is None:
                break
            body = opened
    return body


def charset_of(fields: list[tuple[str, str]], content: bytes) -> str:
    """The charset of a page: a byte order mark, the content type, a declaration in the first 1,024 bytes, or UTF-8."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return name
    said = _CHARSET.search(_field(fields, "content-type").encode("utf-8", "replace")) or _DECLARED.search(content[:1024])
    name = said[1].decode("ascii", "replace").lower() if said else "utf-8"
    try:
        name = codecs.lookup(_LABELS.get(name, name)).name
        b"".decode(name)
        return name if isinstance(codecs.decode(b"", name), str) else "utf-8"
    except (LookupError, TypeError, ValueError):
        return "utf-8"


def page_text(fields: list[tuple[str, str]], body: bytes) -> str:
    """The page as text; bytes that the charset does not have become replacement characters."""
    content = content_of(fields, body)
    return content.decode(charset_of(fields, content), "replace")


def read_page(page: str, base: str) -> tuple[str, str, list[str]]:
    """Title, plain text and links of an HTML page, in one pass over its tags; broken markup never fails.

    The text is what stands outside tags, comments and ``HIDDEN`` elements, with character references resolved, a line
    end at every element of ``BREAKS``, other white space run together and empty lines dropped.
    """
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), page)  # ASCII alone, so that places stay
    pieces, links, title, at, size = [], [], None, 0, len(page)
    gone: set[str] = set()  # closing marks that no later text holds; each is searched to the end once
    titled = -1

    def skip(mark: str, begin: int) -> int:
        if mark in gone:
            return -1
        found = lowered.find(mark, begin)
        if found < 0:
            gone.add(mark)
        return found

    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            pieces.append(html.unescape(page[at:]))
            break
        if tag > at:
            pieces.append(html.unescape(page[at:tag]))
        if page.startswith("<!--", tag):
            end = skip("-->", tag + 4)
            at = end + 3 if end >= 0 else size
            continue
        closing = page.startswith("/", tag + 1)
        name = _NAME.match(lowered, tag + 1 + closing)
        if not name and page[tag + 1 : tag + 2] not in ("!", "?", "/"):
            pieces.append("<")
            at = tag + 1
            continue
        end = skip(">", tag + 1)
        if end < 0:
            break
        at = end + 1
        if not name:
            continue
        element = name[0]
        if element in BREAKS:
            pieces.append("\n")
        if element == "title":
            if closing and titled >= 0 and title is None:
                title = "".join(pieces[titled:])
            titled = len(pieces)
        elif element == "a" and not closing:
            fields = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(page, name.end(), end)}
            if "href" in fields:
                links.append(_resolved(base, html.unescape(fields["href"]).strip()))
        elif element in HIDDEN and not closing:
            shut = skip("</" + element, at)
            if shut >= 0:
                at = shut
            elif element in TO_THE_END:
                at = size
    lines = (_BLANKS.sub(" ", line).strip() for line in "".join(pieces).replace("\r", "\n").split("\n"))
    text = "\n".join(line for line in lines if line)
    return " ".join((title or "").split()), text, list(dict.fromkeys(link for link in links if link))


def _resolved(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def response_records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages, for tables that hold pages instead of records: columns of ``RECORD``.

    The page's key goes into the header X-Page-Id. Null url: empty target. Null page: an empty body.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, target, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = (page or "").encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(payload)}{EOL}{EOL}"
                block = head.encode("ascii") + payload
                identifier = record_id("response", "" if page_id is None else str(page_id), target or "", digest(payload))
                headers = {
                    "WARC-Type": "response",
                    "WARC-Record-ID": identifier,
                    "WARC-Date": date,
                    "WARC-Target-URI": header_value(target or ""),
                    "WARC-Payload-Digest": digest(payload),
                    "WARC-Block-Digest": digest(block),
                    "Content-Type": "application/http; msgtype=response",
                    "Content-Length": str(len(block)),
                }
                if page_id is not None:
                    headers["X-Page-Id"] = str(page_id)
                rows.append(("response", identifier, list(headers.items()), block))
            yield _records(rows, _RECORD_TYPE)

    return pages.select(key, F.col(url).cast("string"), F.col(body).cast("string")).mapInArrow(build, RECORD)


def _records(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


def derive(record: str, headers: dict[str, str], block: bytes) -> list[tuple[str, str, dict[str, str], bytes]]:
    """The metadata and the conversion record of one response record."""
    status, fields, body = split_http(block)
    target, date = headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", "")
    payload_digest = headers.get("WARC-Payload-Digest") or digest(body)
    title, text, links = read_page(page_text(fields, body), target)
    shared = {
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Refers-To": record,
        "WARC-Refers-To-Target-URI": target,
        "WARC-Refers-To-Date": date,
    }
    notes = [("title", header_value(title)), ("http-status", "" if status is None else str(status)), ("source-payload-digest", payload_digest)]
    notes += [("source-header", f"{k}: {header_value(v)}") for k, v in fields]
    notes += [("outlink", header_value(link)) for link in links]
    blocks = [
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}{EOL}" for k, v in notes).encode("utf-8", "surrogatepass")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass")),
    ]
    out = []
    for kind, content, data in blocks:
        identifier = record_id(kind, record)
        own = {"WARC-Type": kind, "WARC-Record-ID": identifier, **shared, "WARC-Block-Digest": digest(data), "Content-Type": content, "Content-Length": str(len(data))}
        if kind == "conversion":
            own["X-Source-Payload-Digest"] = payload_digest
        if "X-Page-Id" in headers:
            own["X-Page-Id"] = headers["X-Page-Id"]
        out.append((kind, identifier, own, data))
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for every response of ``records`` (columns of ``RECORD``): columns of ``DERIVED``.

    Records are built where their response lies; nothing is shuffled. The metadata record lists title, status, the
    response's own HTTP headers, its payload digest and its links, resolved against the target; the conversion record
    holds the plain text, read without transfer and content codings (chunked; gzip, deflate, zstd) and in the page's own
    charset. Digests are of the payload as it was sent. Both name the response in WARC-Refers-To, with its target and date, and carry a digest of
    their own block; identifiers follow from the response's, so the two can be found from it.

    Records of other types give nothing. Codings that are broken or not known: the body as it stands. Null block: empty. Null headers: no headers. Empty body: empty text, still two
    records. Repeated responses: repeated derivatives with the same identifiers. Empty table: empty result. Other
    columns are ignored.
    """
    kinds = [("source_id", pa.string()), *_RECORD_TYPE]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for identifier, headers, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for kind, own_id, own, data in derive(identifier or "", dict(headers or ()), block or b""):
                    rows.append((identifier, kind, own_id, list(own.items()), data))
            yield _records(rows, kinds)

    responses = records.where("warc_type = 'response'").select("record_id", "headers", "block")
    return responses.mapInArrow(build, DERIVED)


def warc_bytes(records: DataFrame) -> DataFrame:
    """The records as bytes of a WARC file, one row each, in column ``record``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [to_bytes(dict(h), b) for h, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    return records.select("headers", "block").mapInArrow(build, "record binary")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """One row per derivative of every page: identifiers, headers of the link back, digests, and the block as text."""
    made = derivatives(response_records(pages))
    header = lambda name: F.col("headers")[name]
    return made.select(
        header("X-Page-Id").cast("long").alias("page_id"),
        "warc_type",
        "record_id",
        header("WARC-Refers-To").alias("refers_to"),
        header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Block-Digest").alias("block_digest"),
        header("Content-Length").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("block"),
    )
