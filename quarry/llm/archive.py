"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

An ARC file starts with a description of itself whose second line names the version and whose third line names the fields of every
header line: five in version 1, ten in version 2; the last field is the length of what follows. The converter reads fields by these
names, takes exactly the declared bytes, and makes for each record what WARC asks for and ARC lacks: a record identifier, a date in
ISO form, a type (the description becomes warcinfo; HTTP responses become response; anything else becomes resource) and SHA-1
digests of block and payload. Files are runs of gzip members, one for each record, and end with a zero byte, which gzip takes as
padding; they are written by Spark, so any store and any lost executor will do, and their size is bounded whatever the input.

Identifiers are version 8 UUIDs: 64 bits hold the page's id, the rest a hash of the payload's digest and of the record's place (its
file's own name and its number there), so an identifier names its page, and repeated rows have identifiers of their own.

Defined cases: null html is an empty payload; a null url is written as unknown:; white space in a url is percent-encoded; a null
page id is left out and its identifier is a version 5 UUID; repeated rows give records each, and of equal payloads all rows with
the largest page id are responses, to one of which the others refer (if all ids are null, every row); an empty table gives no file and no row; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: The fields of a header line in both versions of the ARC format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = "\0"
LEVEL = 5
#: Fixed value: the profile of revisits whose payload is the same.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def packed(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(blob: bytes) -> Iterator[bytes]:
    """What each gzip member of a file holds, one at a time; a file that isn't compressed is one member."""
    if blob[:2] != b"\x1f\x8b":
        if blob.rstrip(b"\0"):
            yield blob
        return
    view, at = memoryview(blob), 0
    while at < len(view) and view[at] == 0x1F:
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            fed = view[at : at + 65536]
            if not fed:
                raise ValueError("a gzip member is cut off")
            out.append(d.decompress(fed))
            at += len(fed) - len(d.unused_data)
        yield b"".join(out)


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(page_id: int | None, digest: str, place: str) -> str:
    named = f"{digest} {place}"
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, named)}>"
    i, d = page_id & (2**64 - 1), int.from_bytes(hashlib.sha1(named.encode()).digest()[:8]) >> 6
    return f"<urn:uuid:{uuid.UUID(int=(i >> 16) << 80 | 8 << 76 | (i >> 4 & 0xFFF) << 64 | 2 << 62 | (i & 15) << 58 | d)}>"


def page_of(record_id: str) -> int | None:
    u = uuid.UUID(record_id[len("<urn:uuid:") : -1])
    if u.version != 8:
        return None
    i = u.int >> 80 << 16 | (u.int >> 64 & 0xFFF) << 4 | u.int >> 58 & 15
    return i - 2**64 if i >= 2**63 else i


def _blobs(rows: Iterator, head, made, most: int) -> Iterator[pd.DataFrame]:
    """Files of at most about `most` bytes and one record; head(k) starts the k-th, made(row, k) is a row's record in it."""
    body, size, k = [], 0, -1
    for row in rows:
        if not body:
            k += 1
            body, size = [head(k)], 0
        body.append(made(row, k))
        size += len(body[-1])
        if size >= most:
            yield pd.DataFrame({"blob": [b"".join(body)]})
            body = []
    if body:
        yield pd.DataFrame({"blob": [b"".join(body)]})


def arc_record(url: str, date: str, kind: str, body: bytes, version: int, ip: str = "0.0.0.0") -> bytes:
    own = {"URL": re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "unknown:", "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(own.get(f, "-") for f in ARC_FIELDS[version].split(" ")).encode() + b"\n" + body + b"\n"


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", versions: tuple[int, ...] = (1, 2), most: int = 8_000_000) -> None:
    """ARC files of page_id, url and html, by turns of each version."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def version(k: int) -> int:
            return versions[k % len(versions)]

        def head(k: int) -> bytes:
            about = f"{version(k)} 0 quarry\n{ARC_FIELDS[version(k)]}\n\n".encode()
            return packed(arc_record(f"filedesc://part-{common.partition_id()}-{k}.arc", date, "text/plain", about, version(k)))

        def made(row: tuple, k: int) -> bytes:
            page_id, url, html = row
            payload = html.encode() if isinstance(html, str) else b""
            named = "" if page_id is pd.NA else f"X-Page-Id: {page_id}\r\n"
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(payload)}\r\n\r\n".encode()
            return packed(arc_record(url if isinstance(url, str) else "", date, "text/html", http + payload, version(k)))

        rows = (r for f in frames for r in zip(f["page_id"].astype("Int64"), f["url"], f["html"], strict=True))
        yield from _blobs(rows, head, made, most)

    common.write_blobs(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, "blob binary"), path, END)


def arc_records(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by the names that the file's own description gives them, and body of each record."""
    fields = None
    for data in members(blob):
        at = 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = data.index(b"\n", at)
            line = data[at:end].decode("utf-8", "replace").rstrip("\r")
            names = fields or ARC_FIELDS[1].split(" ")
            if fields is None:  # the description: its length is the last field in either version
                length = int(line.rsplit(" ", 1)[1])
                about = data[end + 1 : end + 1 + length].decode("utf-8", "replace").split("\n")
                fields = about[1].strip().split(" ")
                if fields != ARC_FIELDS.get(int(about[0].split(" ")[0]), "").split(" "):
                    raise ValueError(f"an ARC version that isn't known: {about[0]}")
                names = fields
            values = line.rsplit(" ", len(names) - 1)
            head = dict(zip(names, values, strict=True))
            length = int(head["Archive-length"])
            body = data[end + 1 : end + 1 + length]
            if len(body) != length:
                raise ValueError("a record is shorter than declared")
            yield head, body
            at = end + 1 + length


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its empty line, payload, and fields by their lower-case names."""
    cut = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or cut < 0:
        return b"", block, {}
    lines = block[:cut].decode("latin-1").split("\r\n")[1:]
    return block[: cut + 4], block[cut + 4 :], {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def warc_record(kind: str, record_id: str, date: str, block: bytes, **more: str) -> bytes:
    d = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    own = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": d} | {k.replace("_", "-"): v for k, v in more.items()}
    own |= {"WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


CONVERTED = "page_id long, kind string, url string, date string, payload_bytes long, payload_digest string, place string, head binary, member binary"


def convert(arc: DataFrame, with_records: bool = True) -> DataFrame:
    """Of files (content), one row for each record: its WARC type, identifiers and digests, and the whole WARC record, packed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob in f["content"]:
                rows, size, file = [], 0, hashlib.sha1(blob).hexdigest()[:16]
                for k, (head, body) in enumerate(arc_records(blob)):
                    if head["URL"].startswith("filedesc:"):
                        kind, http, payload, own, media = "warcinfo", b"", body, {}, "text/plain"
                    elif body.startswith(b"HTTP/") and head["URL"].split(":")[0].lower() not in ("dns", "ftp"):
                        kind, media = "response", "application/http; msgtype=response"
                        http, payload, own = http_parts(body)
                    else:
                        kind, http, payload, own, media = "resource", b"", body, {}, head["Content-type"]
                    page_id, digest = int(own["x-page-id"]) if "x-page-id" in own else None, sha1(payload)
                    member, place = None, f"{file}:{k}"
                    if with_records:
                        member = packed(warc_record(kind, record_uuid(page_id, digest, place), head["Archive-date"], body, WARC_Target_URI=head["URL"], WARC_IP_Address=head["IP-address"], WARC_Payload_Digest=f"sha1:{digest}", Content_Type=media))
                        size += len(member)
                    rows.append((page_id, kind, head["URL"], head["Archive-date"], len(payload), digest, place, http, member))
                    if len(rows) >= 2000 or size >= 8_000_000:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})

    names = [x.split(" ")[0] for x in CONVERTED.split(", ")]
    out = arc.mapInPandas(run, CONVERTED)
    return out if with_records else out.select("page_id", "kind", "payload_bytes", "payload_digest", "place")


def write_warc(arc: DataFrame, path: str, least: int = 0, most: int = 8_000_000, salts: int = 16) -> None:
    """Converts ARC files to WARC files. Of responses with equal payloads of at least `least` bytes, that of the largest page stays;
    the others become revisits of it. Only digests meet in groups; a frequent payload's records are dealt out by salts."""
    light = convert(arc, False).where((F.col("kind") == "response") & (F.col("payload_bytes") >= least))
    groups = light.groupBy("payload_digest", "payload_bytes").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place"))).alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1 and most is not null")
    groups = groups.select("payload_digest", "payload_bytes", F.col("most.page_id").alias("first"), F.col("most.place").alias("first_place"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("place"), F.lit(salts)).cast("int")
    full = convert(arc).where("kind <> 'warcinfo'").withColumn("salt", salt).join(groups, ["payload_digest", "payload_bytes", "salt"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def head(k: int) -> bytes:
            about = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
            return packed(warc_record("warcinfo", record_uuid(None, sha1(f"{common.partition_id()}-{k}".encode()), "warcinfo"), "20240101000000", about, Content_Type="application/warc-fields"))

        def made(r, k: int) -> bytes:
            page_id = None if r.page_id is pd.NA else int(r.page_id)
            if r.kind != "response" or r.first is pd.NA or page_id == int(r.first):
                return r.member
            named = {"WARC_Target_URI": r.url, "WARC_Payload_Digest": f"sha1:{r.payload_digest}", "WARC_Profile": REVISIT, "WARC_Refers_To": record_uuid(int(r.first), r.payload_digest, r.first_place)}
            return packed(warc_record("revisit", record_uuid(page_id, r.payload_digest, r.place), r.date, r.head, Content_Type="application/http; msgtype=response", **named))

        rows = (r for f in frames for r in f.astype({"page_id": "Int64", "first": "Int64"}).itertuples())
        yield from _blobs(rows, head, made, most)

    common.write_blobs(full.mapInPandas(run, "blob binary"), path, END)


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def warc_records(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for data in members(blob):
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            length = int(head["content-length"])
            block = data[end + 4 : end + 4 + length]
            if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
                raise ValueError("a record is not as long as declared")
            yield head, block
            at = end + 8 + length


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Of each response or revisit: page_id, url, payload_bytes and payload_digest of the full payload, record_type, refers_to; on demand the payload (null for revisits)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for blob in f["content"]:
                rows = []
                for head, block in warc_records(blob):
                    kind = head["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    _, payload, own = http_parts(block)
                    page_id, told = page_of(head["warc-record-id"]), head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        if sha1(payload) != told:
                            raise ValueError(f"the payload of page {page_id} isn't what its digest says")
                        rows.append((page_id, head["warc-target-uri"], len(payload), told, kind, None, payload if with_payload else None))
                    else:
                        rows.append((page_id, head["warc-target-uri"], int(own["content-length"]), told, kind, page_of(head["warc-refers-to"]), None))
                yield pd.DataFrame(rows, columns=[*(x.split(" ")[0] for x in READ.split(", ")), "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    out = common.read_blobs(spark, path).mapInPandas(run, READ + ", payload binary")
    return out if with_payload else out.drop("payload")
