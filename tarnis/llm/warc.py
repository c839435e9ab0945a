"""Derivatives of web archive responses: linked metadata and plain-text conversion records.

A response gives two records that refer to it by its identifier and keep its address, date and payload digest: a
metadata record with the source's status line and headers, title, language and links, and a conversion record with
the page's text. Each is a row; `record` turns a row into the bytes of a WARC/1.1 record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a result batch.
ROWS = 200
CRLF = "\r\n"

#: Elements whose content is no text, and those that end a line. A head has no text of its own: what stands
#: in it beside a title, styles and scripts ends it, with or without its end tag.
SKIPPED = "script style noscript template iframe object svg math title"
#: Of these: elements whose content holds no elements; those that run to the end of the page if they aren't closed (of
#: others only the tag is skipped then); those that can be closed within their tag.
RAW, ENDLESS, FOREIGN = "script style iframe title".split(), ("script", "style"), ("svg", "math")
LINES = (
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead "
    "title tr ul"
).split()
CELLS = ("td", "th")
#: What stands for an element in the text.
_PUT = dict.fromkeys(LINES, "\n") | dict.fromkeys(CELLS, " ")
_SKIP = "|".join(SKIPPED.split())
_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*+>", re.I) for name in RAW}
#: A quoted value ends at its quote; one that runs into another tag is no value.
_REST = r"""(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+"""
_TAG = rf"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>{_REST})>"
_MARKUP = re.compile(rf"(?P<comment><!--)|<(?P<skip>{_SKIP})(?![a-zA-Z0-9:-])(?:{_REST}>|[^>]*+>)|<[!?][^>]*+>|{_TAG}", re.I)
_TITLE = re.compile(r"<title\b[^>]*+>(.*?)</title\s*+>", re.S | re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_META_CHARSET = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?([A-Za-z0-9_:-]+)""", re.I)
_ADDRESS = re.compile(r"""(?<![\w-])(href|src|action)\s*=\s*(?:"([^"<]*+)"|'([^'<]*+)'|([^\s"'<>]++))""", re.I)
LINKING = {"a": "href", "area": "href", "link": "href", "img": "src", "iframe": "src", "script": "src", "form": "action"}
#: Whichever begins first: a comment, or a script or style, in which comments don't begin.
_UNLINKED = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|(<(script|style)(?![a-zA-Z0-9:-])[^>]*+(?:>|\Z)).*?(</\2(?![a-zA-Z0-9:-])[^>]*+>|\Z)", re.S | re.I)
_ELEMENT = re.compile(_TAG.replace("(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)", f"(?P<name>{'|'.join(LINKING)})(?![a-zA-Z0-9:-])"), re.I)
#: Addresses that urljoin would leave as they are, and paths that it would only put behind the host.
_WHOLE = re.compile(r"https?://[a-z0-9.-]+(?:/[\w-]+(?:\.\w[\w-]*)*)*/?", re.A)
_PATH = re.compile(r"(?:/[\w-]+(?:\.\w[\w-]*)*)+/?|/", re.A)
_HOST = re.compile(r"(https?://[a-z0-9.-]+)(?:[/?#]|\Z)")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    """A record identifier that depends on the parts alone, so that a task that runs again gives the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and body as sent. A block without an HTTP head is all body."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    if not _ and b"\n\n" in block:
        head, _, body = block.partition(b"\n\n")
    lines = re.split(r"\r?\n", head.decode("latin-1"))
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, body


def payload(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content coding; what can't be decoded stays as it is."""
    fields = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in fields.get("transfer-encoding", ""):
        out, rest = [], body
        while True:
            size, found, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                out = out or [body]
                break
            if not found or n == 0:
                break
            out.append(rest[:n])
            rest = rest[n + 2 :]
        body = b"".join(out)
    for coding in reversed([c.strip() for c in fields.get("content-encoding", "").split(",") if c.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body) if body[:1] == b"x" else zlib.decompress(body, -15)
        except (OSError, EOFError, zlib.error):
            break
    return body


def decoded(headers: list[tuple[str, str]], data: bytes) -> tuple[str, str]:
    """Text and character set: of the header, else of a meta element, else UTF-8, else Latin-1."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    named = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", kind, re.I)
    if not named and (found := _META_CHARSET.search(data[:4096])):
        named = re.match(r"(.*)", found[1].decode("latin-1"))
    for charset in (named[1] if named else "utf-8", "utf-8"):
        try:
            return data.decode(charset), charset.lower()
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1"), "iso-8859-1"


def plain_text(page: str) -> str:
    """The page's text: no markup, comments or scripts; a line for each block; blanks within a line folded."""
    # white space of the source is one blank, lines come from elements alone
    page = " ".join(page.split())
    out: list[str] = []
    # skipped elements not closed yet, with what was put before them; how many of each name; names without a further end
    opened: list[tuple[str, int]] = []
    number, endless = dict.fromkeys(SKIPPED.split(), 0), set()
    at, last, size = 0, page.rfind(">") + 1, len(page)  # no tag ends behind the last one
    sought = 0
    while m := _MARKUP.search(page, sought, last):
        out.append(page[at : m.start()])
        at = m.end()
        if m["comment"]:
            end = page.find("-->", m.start() + 2)
            at = size if end < 0 else end + 3
        elif m["skip"]:
            name = m["skip"].lower()
            if name in RAW:
                end = None if name in endless else _END[name].search(page, at)
                if end:
                    at = end.end()
                elif name in ENDLESS:
                    at = size
                else:
                    endless.add(name)
            elif not (name in FOREIGN and m[0].endswith("/>")):
                opened.append((name, len(out)))
                number[name] += 1
            out.append("\n")
        elif m["name"]:
            name = m["name"].lower()
            if m["close"] and number.get(name):
                while True:  # what was opened within it and not closed ends with it
                    inner, before = opened.pop()
                    number[inner] -= 1
                    if inner == name:
                        break
                del out[before:]
                out.append("\n")
            else:
                out.append(_PUT.get(name, ""))
        sought = at
    rest = page[at:]
    cut = rest.find("<!--")
    out.append(rest if cut < 0 else rest[:cut])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def _absolute(base: str, host: str | None, target: str) -> str:
    if _WHOLE.fullmatch(target):
        return target
    if host and _PATH.fullmatch(target):
        return host + target
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def links(page: str, base: str) -> list[str]:
    """Addresses that the page links to, absolute where the base allows, in order, each once, with their element."""
    seen: dict[str, None] = {}
    host = found[1] if (found := _HOST.match(base)) else None
    for m in _ELEMENT.finditer(_UNLINKED.sub(lambda m: (m[1] or "") + (m[3] or ""), page)):
        name = m["name"].lower()
        found = _ADDRESS.search(m["rest"])
        if not found or found[1].lower() != LINKING[name]:
            continue
        target = html.unescape(next(x for x in found.groups()[1:] if x is not None)).strip()
        if target and not target.startswith(("#", "javascript:", "data:")):
            seen[f"{''.join(_absolute(base, host, target).split())} {name}/@{found[1].lower()}"] = None
    return list(seen)


def _one_line(text: str) -> str:
    return " ".join(text.split())


def derive(record_id: str | None, uri: str | None, date: str | None, block: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    block, uri = block or b"", uri or ""
    status, headers, body = split_http(block)
    data = payload(headers, body)
    page, charset = decoded(headers, data)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    is_html = "html" in kind.lower() or (not kind and "<" in page[:1000])
    own = digest(body)
    record_id = record_id or identifier("response", uri, date or "", own)
    titled = _TITLE.search(page) if is_html else None
    title = _one_line(html.unescape(titled[1])) if titled else ""
    lang = _LANG.search(page) if is_html else None
    fields = [("source-status", status), *(("source-header", f"{k}: {v}") for k, v in headers), ("source-payload-digest", own), ("charset", charset), ("title", title), ("language", lang[1] if lang else "")]
    fields += [("outlink", x) for x in (links(page, uri) if is_html else [])]
    text = plain_text(page) if is_html else page
    contents = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {_one_line(v)}{CRLF}" for k, v in fields if v)),
        "conversion": ("text/plain; charset=UTF-8", text),
    }
    code = re.match(r"HTTP/\S+\s+(\d{3})", status)
    out = []
    for name, (content_type, content) in contents.items():
        raw = content.encode("utf-8", "replace")
        out.append(
            {
                "kind": name, "record_id": identifier(name, record_id), "refers_to": record_id, "target_uri": uri or None, "warc_date": date,
                "content_type": content_type, "content_length": len(raw), "block_digest": digest(raw), "source_payload_digest": own,
                "source_block_digest": digest(block), "http_status": int(code[1]) if code else None, "title": title or None,
                "source_headers": [{"name": k, "value": v} for k, v in headers], "content": raw.decode("utf-8"),
            }
        )
    return out


_HEADER = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
        ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()),
        ("source_block_digest", pa.string()), ("http_status", pa.int32()), ("title", pa.string()), ("source_headers", _HEADER), ("content", pa.string()),
    ]
)
SCHEMA = (
    "kind string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, "
    "block_digest string, source_payload_digest string, source_block_digest string, http_status int, title string, "
    "source_headers array<struct<name:string,value:string>>, content string"
)


def derivatives(responses: DataFrame, key: str | None = None) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record.

    responses: record_id, target_uri, date (strings) and block (binary: the HTTP response). `key` names a column that is
    passed on; others are left out. A missing record_id is derived from address, date and payload; a null block counts as empty and gives an empty
    conversion. Bodies that aren't HTML are passed on as text. Repeated rows give repeated records with the same
    identifiers, since these depend on the response alone. Pages of any length are converted whole.
    """
    passed = [F.col(f"`{key}`")] if key else []
    rows = responses.select(F.col("record_id").cast("string"), F.col("target_uri").cast("string"), F.col("date").cast("string"), F.col("block").cast("binary"), *passed)
    schema = (f"`{key}` {rows.schema[key].dataType.simpleString()}, " if key else "") + SCHEMA

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                made, of = [], []
                for i, row in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                    own = derive(*row)
                    made += own
                    of += [i] * len(own)
                out = pa.RecordBatch.from_pylist(made, schema=_ARROW)
                if key:
                    out = pa.record_batch([batch.column(4).take(pa.array(of, pa.int64())), *out.columns], names=[key, *out.schema.names])
                yield out

    return rows.mapInArrow(run, schema)


def record(row: dict) -> bytes:
    """A derivative as the bytes of a WARC/1.1 record."""
    fields = [
        ("WARC-Type", row["kind"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"])),
    ]
    head = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + row["content"].encode() + b"\r\n\r\n"


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or gzip by record: record_id, target_uri, date, block. A file is read by
    one task, as archives of the usual size are."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getvalue()[:2] == b"\x1f\x8b" else raw
                held = []
                for fields, block in records(stream):
                    if fields.get("warc-type") == "response":
                        held.append({"record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "block": block})
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    schema = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("block", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, target_uri string, date string, block binary")


def as_responses(pages: DataFrame, date: str, key: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """Stored pages as response records, for tables that keep only address and body. A null body is an empty one."""
    body = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(head.cast("binary"), body)
    return pages.select(F.col(f"`{key}`").alias("page_id"), F.lit(None).cast("string").alias("record_id"), F.col(f"`{uri_col}`").cast("string").alias("target_uri"), F.lit(date).alias("date"), block.alias("block"))
