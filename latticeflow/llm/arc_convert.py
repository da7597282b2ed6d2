"""Legacy ARC archives: write, parse and convert to WARC, then read the WARC back.

ARC version 1 record line:  URL IP-address Archive-date Content-type Archive-length
ARC version 2 record line:  URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length
A file begins with a `filedesc://` record whose block holds the version line, the list of fields and so
the layout of all lines after it.  Each record's block is exactly Archive-length bytes and one line feed
follows it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import write_files
from .common import fresh_path, tidy

# The field lists of the two versions of the format.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
FILE_BYTES = 4 << 20
SALT = 16
STAMP = "20200101000000"


def arc_header(name: str, version: int) -> bytes:
    block = f"{version} 0 latticeflow\n{' '.join(FIELDS[version])}\n\n".encode()
    own = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": STAMP, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(own[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def plain_url(url: str | None) -> str:
    """The URL without blanks and line ends: these are percent-encoded; "-" for none."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"


def arc_record(version: int, url: str, block: bytes, date: str = STAMP, ip: str = "0.0.0.0", kind: str = "text/html", name: str = "-", offset: int = 0) -> bytes:
    """One record; blanks and line ends of the URL are percent-encoded, since the line is split at blanks."""
    url = plain_url(url)
    own = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(own[f] for f in FIELDS[version]).encode() + b"\n" + block + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of each record; the layout comes from the file's own version block.

    A line with too few or too many fields, or a length that overruns the file, raises ValueError.
    """
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        eol = data.index(b"\n", at)
        values = data[at:eol].decode("utf-8").rstrip("\r").split(" ")
        first = values[0].startswith("filedesc:")
        length = int(values[-1])
        block = data[eol + 1 : eol + 1 + length]
        if len(block) != length:
            raise ValueError(f"record at {at}: {length} bytes declared, {len(block)} left")
        if first:
            lines = block.decode("utf-8").split("\n")
            version = int(lines[0].split(" ")[0])
            fields = lines[1].split(" ") if len(lines) > 1 and lines[1] else FIELDS[version]
        elif len(values) != len(fields):
            raise ValueError(f"record at {at}: {len(values)} fields, the version block names {len(fields)}")
        else:
            yield dict(zip(fields, values, strict=True)), block
        at = eol + 1 + length


def http_split(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(header fields in lower case, header bytes, payload) of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return {}, b"", block
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, head + sep, body


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """ISO 8601 of an ARC date of 8 to 14 digits; missing parts are the least ones."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, key: str) -> str:
    """The same record always gets the same identifier, so a retried task writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{url} {date} {digest} {key}')}>"


def warc_info(name: str, version: int) -> bytes:
    """The record that begins a WARC file: what made it, and from which ARC version."""
    block = f"software: latticeflow\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC version {version}\r\n".encode()
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(name, warc_date(STAMP), base32_sha1(block), 'info')}", f"WARC-Date: {warc_date(STAMP)}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_record(fields: dict, block: bytes, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """The WARC/1.0 record of a parsed ARC record: response, or revisit (headers only) if refers_to is given.

    A revisit names the response by its record id, which follows from the response's url, page and the digest.
    """
    http, head, payload = http_split(block)
    digest, date = base32_sha1(payload), warc_date(fields["Archive-date"])
    key = http.get("x-page-id", "")
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(fields['URL'], date, digest, key)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_url or '-', date, digest, refers_to)}", f"WARC-Refers-To-Target-URI: {refers_url or '-'}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}", "WARC-Truncated: length"]
    kept = block if refers_to is None else head
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(kept)}", f"Content-Length: {len(kept)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + kept + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at {at} doesn't end where it declares")
        yield fields, block
        at = end + 8 + n


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), refers_to and refers_url: the largest page_id with the same payload, null for that page itself, and its url.

    Digests are counted with a partial aggregate; only digests of more than one page are joined back,
    and the pages of one digest are dealt over SALT keys, so no digest lands in one task.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    shared = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.max_by("url", F.struct("page_id", "url")).alias("last_url"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = rows.join(shared, ["digest", "salt"], "left")
    other = F.col("last") != F.col("page_id")
    return joined.select("page_id", "url", "html", F.when(other, F.col("last")).alias("refers_to"), F.when(other, F.col("last_url")).alias("refers_url"))


def convert(pages: DataFrame, out: str) -> DataFrame:
    """Put the pages into ARC files, convert these to WARC files, and write those to the table at `out`.

    One row of the table is one WARC file: name, n_records, content (write_archives() puts them out as files).  ARC versions 1 and 2 take turns.  Null
    url: "-"; null html: an empty payload.  Rows that repeat a page_id and its html are both response.
    A null page_id has an empty X-Page-Id and never counts as the largest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = 0
        for pdf in batches:
            arc, size, refers, version = [], 0, [], 1

            def flush():
                data = b"".join(arc)
                warc = [warc_record(f, b, *r) for (f, b), r in zip(parse_arc(data), refers, strict=True)]
                name = f"part-{TaskContext.get().partitionId()}-{turn}.warc"
                return pd.DataFrame({"name": [name], "n_records": [len(warc)], "content": [b"".join([warc_info(name, version), *warc])]})

            for page, url, html, ref, ref_url in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["refers_url"], strict=True):
                if not arc:
                    turn, version = turn + 1, 1 + turn % 2
                    arc.append(arc_header(f"part-{turn}.arc", version))
                    size = len(arc[0])
                payload = html.encode("utf-8")
                own = "" if page is None else page
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {own}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                arc.append(arc_record(version, url if isinstance(url, str) else "-", head + payload, offset=size))
                size += len(arc[-1])
                refers.append((ref, plain_url(ref_url)))
                if size >= FILE_BYTES:
                    yield flush()
                    arc, size, refers = [], 0, []
            if refers:
                yield flush()

    # Ids go as texts: a whole number beside a null would lose its last digits on the way.
    rows = with_roles(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    rows.mapInPandas(tidy(run), "name string, n_records int, content binary").write.option("compression", "zstd").parquet(out)
    return pages.sparkSession.read.parquet(out)


def read_back(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, warc_record_id, url of each record of the WARC files.

    A response's payload is digested anew and must agree with its header, else ValueError.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for fields, block in parse_warc(content):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = http_split(block)
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (base32_sha1(payload), len(payload)) != (digest, size):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    page = http.get("x-page-id", "")
                    ref = fields.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, size, digest, fields["WARC-Type"], int(ref) if ref else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"]))
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "warc_record_id", "url"]
                out = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}
                yield pd.DataFrame({n: pd.array(list(out[n]), dtype="Int64") if n in ("page_id", "refers_to") else list(out[n]) for n in names})

    return files.select("content").mapInPandas(tidy(run), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, warc_record_id string, url string")


def write_archives(files: DataFrame, folder: str) -> DataFrame:
    """Write each archive of convert()'s table as a .warc file of a folder that the tasks can reach; returns (name, bytes)."""
    return write_files(files.select("name", "content"), folder)


def round_trip(pages: DataFrame) -> DataFrame:
    return read_back(convert(pages, fresh_path(pages.sparkSession, "warc")))
