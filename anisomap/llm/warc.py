"""WARC archives: writing with segments and chunked bodies, and reassembly from continuation records.

Writing: each page is a record whose payload is its html in UTF-8 (null: empty). Of pages with equal payloads of at
least ``least`` bytes, the one with the largest page_id is the response and the others are revisits of it; shorter
payloads are all responses. A response's HTTP message has a chunked body; one of more than ``segment`` characters goes
on in continuation records. Files are gzipped text files of Spark, of at most ``FILE_RECORDS`` records, which end with
two line ends as WARC wants.

Reading: files, of one gzip member or of many (such as one a record), are decompressed and parsed in parts of bounded
size; continuation records are grouped by origin identifier, ordered by segment number, held against the total length,
and their chunked framing is decoded. Wrong lengths, numbers or digests raise.

Repeated rows: of those with the largest page_id, one with the smallest url (null first) is the response, whatever the
order of rows. Null page_ids are never a response if another page has the payload; without one each is a response. Null
urls are written as about:blank; control characters and blanks in urls are percent-encoded. An empty table gives no
rows. Other columns of ``pages`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.llm.common import scratch, written
from anisomap.storage import written_with

CHUNK, FILE_RECORDS = 8192, 2048
#: Bytes that are decompressed at once, and of records that a worker hands on at once.
PART_BYTES, BATCH_BYTES = 1 << 20, 1 << 22
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def _record(kind: str, record: str, block: str, **fields: object) -> str:
    """A record without the two line ends that follow it."""
    head = {"WARC-Type": kind, "WARC-Record-ID": record, "WARC-Date": _DATE, **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}}
    lines = [f"{k}: {v}\r\n" for k, v in head.items()]
    return f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}\r\n\r\n{block}"


def _uri(url: object) -> str:
    return "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url) if isinstance(url, str) and url else "about:blank"


def chunked(text: str) -> str:
    parts = (text[i : i + CHUNK] for i in range(0, len(text), CHUNK))
    return "".join(f"{len(p.encode('utf-8', 'surrogatepass')):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def unchunked(raw: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = raw.index(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(raw[at : at + size])
        if len(out[-1]) != size or raw[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        at += size + 2


def records_of(page: str | None, url: str | None, html: str, digest: str, role: str, refers: str | None, uid: int, segment: int) -> list[str]:
    """The records of one page."""
    own, name = "null" if page is None else page, "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    if role == "revisit":
        length = len(html.encode("utf-8", "surrogatepass"))
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
        target = f"<urn:page:{refers}:{digest}>"
        return [_record("revisit", f"<urn:revisit:{own}:{uid}>", block, WARC_Target_URI=_uri(url), WARC_Profile=_PROFILE, WARC_Refers_To=target, WARC_Payload_Digest=name, Content_Type="application/http;msgtype=response")]
    record = f"<urn:page:{own}:{digest}>" if role == "response" else f"<urn:page:{own}:{digest}:{uid}>"
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(html)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = _record("response", record, parts[0], WARC_Target_URI=_uri(url), WARC_Payload_Digest=name, Content_Type="application/http;msgtype=response", WARC_Segment_Number=1 if len(parts) > 1 else None)
    total = len(block.encode("utf-8", "surrogatepass")) if len(parts) > 1 else 0
    return [first] + [
        _record("continuation", f"<urn:segment:{own}:{digest}:{uid}:{n}>", part, WARC_Target_URI=_uri(url), WARC_Segment_Origin_ID=record, WARC_Segment_Number=n, WARC_Segment_Total_Length=total if n == len(parts) else None)
        for n, part in enumerate(parts[1:], 2)
    ]


def _roles(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (page_id, url, html, digest) with their role and the page_id of the response that they refer to."""
    grouped = F.octet_length("html") >= least
    same = rows.where(grouped).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    best = same.groupBy(F.col("digest").alias("key")).agg(F.max(F.struct("page_id", "n")).alias("best")).select("key", F.col("best.page_id").alias("refers"), "best.n")
    best, (_, most) = written_with(best, "responses", F.max(F.when(F.col("refers").isNotNull(), F.col("n"))))
    rows = rows.withColumn("key", F.when(grouped, F.col("digest"))).join(best, "key", "left")
    role = F.when(F.col("refers").isNull(), "single").when(F.col("page_id").eqNullSafe(F.col("refers")), F.when(F.col("n") == 1, "response").otherwise("tie")).otherwise("revisit")
    rows = rows.withColumn("role", role).drop("key")
    if (most or 0) < 2:
        return rows.drop("n")
    # Repeated rows are counted, and made again from their counts: no row's own number decides.
    ties = rows.where("role = 'tie'").groupBy("page_id", "url", "digest", "refers", F.spark_partition_id().alias("at")).agg(F.count("*").alias("n"), F.min("html").alias("html"))
    ties = written(ties, "ties")
    first = ties.groupBy("digest").agg(F.min(F.struct("url", "at")).alias("first"))
    copies = ties.join(first, "digest").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    response = F.col("url").eqNullSafe(F.col("first.url")) & (F.col("at") == F.col("first.at")) & (F.col("copy") == 1)
    copies = copies.withColumn("role", F.when(response, "response").otherwise("revisit"))
    return rows.where("role <> 'tie'").drop("n").unionByName(copies.select("page_id", "url", "html", "digest", "refers", "role"))


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = 1 << 15) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``."""

    @F.pandas_udf("array<string>")
    def records(page: pd.Series, url: pd.Series, html: pd.Series, digest: pd.Series, role: pd.Series, refers: pd.Series, uid: pd.Series) -> pd.Series:
        return pd.Series([records_of(*r, segment) for r in zip(page, url, html, digest, role, refers, uid, strict=True)], dtype="object")

    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = _roles(rows, least)
    # The number only makes names of records differ.
    uid = F.monotonically_increasing_id()
    made = rows.select(F.explode(records(F.col("page_id").cast("string"), "url", "html", "digest", "role", F.col("refers").cast("string"), uid)).alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def members(content: bytes) -> Iterator[bytes]:
    """What a file holds, in parts: that of all its gzip members, or the file itself."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest.strip(b"\0"):  # zeros may follow the last member
        one = zlib.decompressobj(47)
        while not one.eof:
            part = one.decompress(rest, PART_BYTES)
            rest = one.unconsumed_tail
            if part:
                yield part
            elif not one.eof and not rest:
                raise ValueError("a gzip member ends too early")
        rest = one.unused_data


def parse(parts: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of an archive."""
    parts = iter([parts] if isinstance(parts, bytes) else parts)
    held = bytearray()

    def have(n: int) -> bool:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while have(1):
        end = held.find(b"\r\n\r\n")
        while end < 0:
            seen = len(held)
            if not have(seen + 1):
                raise ValueError("a record's header does not end")
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
        version, *lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record where one should begin")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        after = end + 4 + int(head["content-length"])
        if not have(after + 4) or held[after : after + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield head, bytes(held[end + 4 : after])
        del held[: after + 4]


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


PARSED = "origin string, segment int, total long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, block binary"


def _digest(payload: bytes, claimed: str | None) -> str:
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if claimed is not None and claimed != own:
        raise ValueError("a payload is not what its digest says")
    return own


def _page(record: str) -> int | None:
    found = record.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple | None:
    """A record's row of ``PARSED``; None for kinds that are not read."""
    kind, record = head["warc-type"], head["warc-record-id"]
    claimed = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    number = int(head.get("warc-segment-number", 0))
    if kind == "revisit":
        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n")[1:] if x)
        return record, 0, None, kind, _page(record), _page(head["warc-refers-to"]), int(fields["Content-Length"]), claimed, None, None
    if number:
        total = head.get("warc-segment-total-length")
        origin = head["warc-segment-origin-id"] if kind == "continuation" else record
        return origin, number, int(total) if total else None, "response", _page(origin), None, None, claimed, None, block
    if kind == "response":
        p = payload_of(block)
        return record, 0, None, kind, _page(record), None, len(p), _digest(p, claimed), p if with_payload else None, None
    return None


def _parsed(with_payload: bool):
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns, dtype=object).astype({"segment": "int32", "total": "Int64", "page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for head, block in parse(members(content)):
                    row = _row(head, block, with_payload)
                    if row is not None:
                        out.append(row)
                        held += len(block)
                    if held >= BATCH_BYTES:
                        yield frame(out)
                        out, held = [], 0
                yield frame(out)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of all records under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = written(files.mapInPandas(_parsed(with_payload), PARSED), "records")

    @F.pandas_udf("payload_bytes long, payload_digest string, payload binary")
    def joined(parts: pd.Series, total: pd.Series, claimed: pd.Series) -> pd.DataFrame:
        out = []
        for segments, length, digest in zip(parts, total, claimed, strict=True):
            if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
                raise ValueError("segments are missing or repeated")
            block = b"".join(s["block"] for s in segments)
            if len(block) != length:
                raise ValueError("segments do not have the total length")
            p = payload_of(block)
            out.append((len(p), _digest(p, digest), p if with_payload else None))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_digest", "payload"])

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    whole = parsed.where("segment = 0").select(*columns)
    parts = parsed.where("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max("payload_digest").alias("claimed"), F.max("page_id").alias("page_id"),
    )
    parts = parts.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), joined("parts", "total", "claimed").alias("j"))
    got = whole.unionByName(parts.select("page_id", "j.*", "record_type", "refers_to"))
    return got if with_payload else got.drop("payload")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
