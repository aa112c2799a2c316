import email.parser
import gzip
import random
import re
import time
import zlib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from rewardloom.llm import warc

PAGE = (
    '<html><head><title>A &amp; B</title><script>var x="</p>"</script></head><body><p>x &lt; y<br>z<!-- <a href=no> -->'
    '<a href="/q?a=1&amp;b">go</a> <A HREF=rel>r</A> 1 < 2 <style>p{}</style>end'
)


def test_reading_a_page():
    title, text, links = warc.read_page(PAGE, "http://h.x/d/e")
    assert title == "A & B"
    assert text == "A & B\nx < y\nzgo r 1 < 2 end"
    assert links == ["http://h.x/q?a=1&b", "http://h.x/d/rel"]
    assert warc.read_page("", "") == ("", "", [])
    assert warc.read_page("plain", "")[1] == "plain"


@pytest.mark.parametrize("piece", ["<", "<!--", "<a ", "<script>", '<a href="', "&", "<p", "<title>", "</", "<a b='"])
def test_hostile_pages_stay_quick(piece):
    began = time.perf_counter()
    warc.read_page(piece * 100_000, "http://a/")
    assert time.perf_counter() - began < 10


def test_records_are_linked_and_come_back(spark):
    pages = [(1, "http://a.b/c", PAGE, 7), (2, None, None, 7), (None, "http://a.b/\r\nX: y", "é<p>" * 20_000, 7), (1, "http://a.b/c", PAGE, 7), (3, "http://[bad", "<a href='http://[x'>t</a>", 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, headers int").withColumn("block", F.lit(1))
    responses = warc.response_records(df)
    made = warc.derivatives(responses)
    held = {r.record_id: r for r in responses.collect()}
    rows = made.collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        source = held[r.headers["WARC-Refers-To"]]
        assert r.source_id == source.record_id and r.headers["WARC-Record-ID"] == r.record_id
        for mine, theirs in (("WARC-Refers-To-Target-URI", "WARC-Target-URI"), ("WARC-Refers-To-Date", "WARC-Date")):
            assert r.headers[mine] == source.headers[theirs]
        assert r.headers["WARC-Block-Digest"] == warc.digest(bytes(r.block))
        assert source.headers["WARC-Payload-Digest"] in (r.headers.get("X-Source-Payload-Digest"), *bytes(r.block).decode().split())
    assert {r.warc_type for r in rows} == {"metadata", "conversion"}
    assert len({r.record_id for r in rows}) == 2 * (len(pages) - 1)
    joined = b"".join(bytes(r.record) for r in warc.warc_bytes(made).collect())
    back = sorted((h["WARC-Record-ID"], b) for h, b in warc.parse_records(joined))
    assert back == sorted((r.record_id, bytes(r.block)) for r in rows)
    report = warc.page_derivatives(df).where("page_id = 1 AND warc_type = 'conversion'").first()
    assert report.block == "A & B\nx < y\nzgo r 1 < 2 end"


def test_gaps(spark):
    rows = [("response", None, None, None), ("request", "r", {}, b"x"), ("response", "q", {"WARC-Date": "d"}, bytearray(b"HTTP/1.1 404 Gone\r\nA: b\r\n\r\nhi"))]
    got = warc.derivatives(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert sorted((r.source_id or "", r.warc_type) for r in got) == [("", "conversion"), ("", "metadata"), ("q", "conversion"), ("q", "metadata")]
    notes = next(bytes(r.block).decode() for r in got if r.source_id == "q" and r.warc_type == "metadata")
    assert "http-status: 404" in notes and "source-header: a: b" in notes
    assert warc.derivatives(spark.createDataFrame([], warc.RECORD)).collect() == []


class Reader(HTMLParser):
    """Text, title and links by the standard library's parser, for pages that are well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden, self.titles, self.title = [], [], 0, 0, ""

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        self.titles += tag == "title"
        self.out.append("\n" if tag in warc.BREAKS else "")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.titles -= tag == "title"
        self.out.append("\n" if tag in warc.BREAKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            self.title += data if self.titles else ""


def test_pages_agree_with_another_parser():
    rng = random.Random(3)
    words = ["a", "b&amp;c", "&lt;x&gt;", "é", "1 &#60; 2", "漢&#x5b57;", "  two  "]

    def body(depth):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["text", "text", "p", "div", "span", "a", "br", "script", "select", "comment", "li"])
            inner = body(depth - 1) if depth else rng.choice(words)
            parts.append({
                "text": rng.choice(words), "br": "<br>", "comment": "<!-- <p>no</p> -->", "a": f"<A HREF='/p?{rng.randrange(9)}&amp;x'>{inner}</a>",
                "script": "<script>if (a) x = 1</script>", "select": "<select><option>no</option></select>",
            }.get(kind) or f"<{kind} class=x>{inner}</{kind}>")
        return " ".join(parts)

    for _ in range(300):
        page = f"<html><head><title>{rng.choice(words)}</title><style>p {{}}</style></head><body>{body(3)}</body></html>"
        reader = Reader()
        reader.feed(page)
        reader.close()
        lines = [" ".join(re.split(r"[^\S\n]+", line)).strip() for line in "".join(reader.out).split("\n")]
        title, text, links = warc.read_page(page, "http://h/")
        assert text == "\n".join(line for line in lines if line)
        assert title == " ".join(reader.title.split())
        assert links == list(dict.fromkeys("http://h" + v for v in reader.links))


@pytest.mark.parametrize("element", ["noscript", "select", "textarea", "template"])
def test_unclosed_elements_keep_the_rest(element):
    assert warc.read_page(f"<p>a<{element}>b<p>c", "")[1] == "a" + "b\nc"
    assert warc.read_page(f"<p>a<{element}>b</{element}>c", "")[1] == "ac"
    assert warc.read_page("<p>a<script>b<p>c", "")[1] == "a"


def test_headers_are_kept_one_by_one():
    head = "Set-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n  two\r\n\tthree\r\nEmpty:\r\nContent-Type: text/html"
    status, fields, body = warc.split_http(f"HTTP/1.1 203 Ok\r\n{head}\r\n\r\nrest\r\n\r\n".encode())
    other = email.parser.Parser().parsestr(head + "\r\n\r\n")
    assert (status, body) == (203, b"rest\r\n\r\n")
    assert fields == [(k.lower(), " ".join(v.split())) for k, v in other.items()]
    made = warc.derive("r", {}, f"HTTP/1.1 203 Ok\r\n{head}\r\n\r\nx".encode())
    assert made[0][3].decode().count("source-header: set-cookie") == 2


def chunked(data, size):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: x\r\n\r\n"


def conversion(headers, body):
    block = "HTTP/1.1 200 OK\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + body
    return warc.derive("r", {}, block)[1][3].decode()


def test_codings_are_undone():
    page = ("<p>été " + "x" * 5000).encode()
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    wanted = "été " + "x" * 5000
    two = gzip.compress(page[:100]) + gzip.compress(page[100:])
    for coding, body in (("gzip", gzip.compress(page)), ("x-gzip", two), ("deflate", zlib.compress(page)), ("Deflate", raw), ("identity", page), ("gzip, deflate", zlib.compress(gzip.compress(page)))):
        assert conversion([("Content-Encoding", coding)], body) == wanted, coding
        assert conversion([("Transfer-Encoding", "chunked"), ("Content-Encoding", coding)], chunked(body, 77)) == wanted, coding
    import zstandard

    assert conversion([("content-encoding", "zstd")], zstandard.ZstdCompressor().compress(page)) == wanted
    # What is broken or not known is read as it stands.
    for headers, body in (([("Content-Encoding", "gzip")], page), ([("Transfer-Encoding", "chunked")], page), ([("Content-Encoding", "unknown")], page)):
        assert conversion(headers, body) == wanted


def test_charsets():
    text = "déjà vu — ñ"
    for label, codec in (("iso-8859-1", "cp1252"), ("windows-1252", "cp1252"), ("utf-8", "utf-8"), ("UTF-16LE", "utf-16-le"), ("koi8-r", "koi8-r"), ("Shift_JIS", "shift_jis"), ("no-such", "utf-8"), ("rot13", "utf-8"), ("hex", "utf-8")):
        words = "Привет" if label == "koi8-r" else "日本語" if label == "Shift_JIS" else text
        assert conversion([("Content-Type", f"text/html; charset={label}")], f"<p>{words}".encode(codec)) == words, label
    declared = '<html><head><meta http-equiv="Content-Type" content="text/html; charset=koi8-r"></head><p>Привет'
    assert conversion([("Content-Type", "text/html")], declared.encode("koi8-r")) == "Привет"
    assert conversion([], ('<meta charset="windows-1252"><p>' + text).encode("cp1252")) == text
    for codec in ("utf-8-sig", "utf-16"):
        assert conversion([("Content-Type", "text/html; charset=koi8-r")], f"<p>{text}".encode(codec)) == text
    assert conversion([], b"<p>a\xffb") == "a\ufffdb"
