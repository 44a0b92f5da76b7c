"""WARC archives and a two-level index of their captures.

Records are written to gzip members of WARC files in the shared folder.  The
index sorts captures by reversed-host URL keys into compressed blocks; a sparse
directory with one row per block says where a block stands.  A look-up finds
its block by binary search in the directory, its captures by binary search in
the block, and reads just the records' bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalwise.llm.common import shared_folder, staged, text_bytes

#: Payloads under so many bytes are always written whole.
LEAST_BYTES = 100
#: A WARC file ends with the record that brings it to so many bytes.
FILE_BYTES = 1 << 30
#: Captures in one block of the index.
BLOCK_LINES = 3000

CAPTURES = (
    "url_key string, url string, page_id long, payload_digest string, record_type string, refers_to long, "
    "file string, offset long, length long"
)
DIRECTORY = "part int, block int, first_key string, last_key string, n_captures long, file string, offset long, length long"


def _open(uri: str, mode: str):
    """A file of the shared folder, whatever file system that is on."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then path and query; scheme, port 80/443, ``www.`` and fragment go.

    ``http://www.example.org/a?b=1`` gives ``org,example)/a?b=1``.  What cannot
    be split as a URL is its own key, NULL is the empty key.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    suffix = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + suffix + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _urn(page_id: int | None, digest: str) -> str:
    name = "none" if page_id is None else str(page_id)
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{digest}')}>"


def record(row: dict, payload: bytes, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    whole = row["record_type"] == "response"
    page = "" if row["page_id"] is None else str(row["page_id"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if whole else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['page_id'], row['payload_digest'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(row['url'] or '', safe=_URL_SAFE)}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {page}",
    ]
    if not whole:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(row['refers_to'], row['payload_digest'])}",
            f"X-Refers-To-Page-ID: {row['refers_to']}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters that stay as they are in a URI header (a fixed value).
_URL_SAFE = "%:/?#[]@!$&'()*+,;=-._~"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and payload (after the HTTP head) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        headers[name.lower()] = value
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def capture_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages with payload, payload_digest, record_type and refers_to.

    The first page of each digest is a map-side minimum; pages then meet it in
    an equi-join on the digest, which adaptive execution splits where one
    payload has very many pages.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_bytes("html").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select(F.col("payload_digest").alias("first_digest"), "first_id")
    )
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(firsts, F.col("payload_digest") == F.col("first_digest"), "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first_id")).alias("refers_to"),
    )


@dataclass
class Archive:
    """Where an archive stands: its folder, its captures and its block directory."""

    folder: str
    captures: DataFrame
    directory: DataFrame


def write_archive(
    pages: DataFrame,
    least_bytes: int = LEAST_BYTES,
    file_bytes: int = FILE_BYTES,
    block_lines: int = BLOCK_LINES,
    date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Write a record per page and the index over all records.

    NULL html is an empty payload, a NULL URL an empty one; NULL or repeated
    page ids and URLs are written like others.  Of equal payloads of ``least_bytes`` or more, rows
    with the smallest page id that is not NULL are responses and the rest
    revisit it; where all ids are NULL all are responses.  Other columns are
    ignored; no pages give an empty archive.  Files get a new name in each
    attempt of a task, and only files of attempts that ended well are indexed.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at = None, "", 0
        try:
            for batch in batches:
                done = []
                for page, url, payload, digest, kind, refers in zip(
                    batch["page_id"].astype("Int64"),
                    batch["url"],
                    batch["payload"],
                    batch["payload_digest"],
                    batch["record_type"],
                    batch["refers_to"].astype("Int64"),
                    strict=True,
                ):
                    if out is None:
                        name = f"{folder}/data/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                        out, at = _open(name, "w"), 0
                    row = {
                        "page_id": None if page is pd.NA else int(page),
                        "url": url,
                        "payload_digest": digest,
                        "record_type": kind,
                        "refers_to": None if refers is pd.NA else int(refers),
                    }
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(row, bytes(payload), date)) + squeeze.flush()
                    out.write(member)
                    done.append(row | {"url_key": url_key(url), "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                    if at >= file_bytes:
                        out.close()
                        out = None
                if done:
                    yield _captures(done)
        finally:
            if out is not None:
                out.close()

    captures = staged(capture_types(pages, least_bytes).mapInPandas(write, CAPTURES), "captures")
    return Archive(folder, captures, staged(_index(captures, folder, block_lines), "directory"))


def _captures(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURES.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


#: Columns of a line of the index, in this order; tabs and line feeds in URLs are escaped.
_LINE = ("url_key", "page_id", "file", "offset", "length", "record_type", "refers_to", "payload_digest", "url")


def _line(row) -> str:
    cells = ["" if v is None or v is pd.NA else str(v) for v in row]
    return "\t".join(c.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n") for c in cells)


def _unline(line: str) -> dict:
    cells = [re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n"}.get(m[1], m[1]), c) for c in line.split("\t")]
    row: dict = dict(zip(_LINE, cells, strict=True))
    for k in ("page_id", "offset", "length", "refers_to"):
        row[k] = int(row[k]) if row[k] else None
    return row


def _index(captures: DataFrame, folder: str, block_lines: int) -> DataFrame:
    """Sorted, compressed blocks in files; one directory row per block.

    Range partitioning also splits a host or a URL that has very many captures,
    because file and offset follow in the order.
    """
    order = ("url_key", "file", "offset")
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order).select(*_LINE)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, at, out, name = TaskContext.get().partitionId(), 0, 0, None, ""
        keys: list[str] = []
        lines: list[str] = []

        def flush() -> dict:
            nonlocal at, block
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            row = {
                "part": part, "block": block, "first_key": keys[0], "last_key": keys[-1],
                "n_captures": len(lines), "file": name, "offset": at, "length": len(packed),
            }
            at, block = at + len(packed), block + 1
            keys.clear()
            lines.clear()
            return row

        try:
            for batch in batches:
                done = []
                if out is None and len(batch):
                    name = f"{folder}/index/{part:06d}-{uuid.uuid4().hex}.blocks"
                    out = _open(name, "w")
                for c in ("page_id", "refers_to"):
                    batch[c] = batch[c].astype("Int64")
                for row in zip(*(batch[c] for c in _LINE), strict=True):
                    keys.append(row[0])
                    lines.append(_line(row))
                    if len(lines) >= block_lines:
                        done.append(flush())
                if done:
                    yield pd.DataFrame(done)
            if lines:
                yield pd.DataFrame([flush()])
        finally:
            if out is not None:
                out.close()

    return ranged.mapInPandas(blocks, DIRECTORY)


def _block(file: str, offset: int, length: int) -> list[str]:
    with _open(file, "r") as source:
        return zlib.decompress(source.read_at(length, offset)).decode().split("\n")


RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, http_bytes long, payload binary"
)


def _records(rows: Iterator[dict], payloads: bool) -> Iterator[dict]:
    """Range-read records; rows of one file that follow each other share its handle."""
    source, name = None, None
    try:
        for row in rows:
            if row["file"] != name:
                if source is not None:
                    source.close()
                source, name = _open(row["file"], "r"), row["file"]
            headers, payload = parse(zlib.decompress(source.read_at(row["length"], row["offset"]), 31))
            whole = headers["warc-type"] == "response"
            page, refers = headers["x-page-id"], headers.get("x-refers-to-page-id", "")
            stated = headers["warc-payload-digest"].removeprefix("sha256:")
            digest = hashlib.sha256(payload).hexdigest() if whole else stated
            if digest != stated:
                raise ValueError(f"record at {row['file']}:{row['offset']} does not have the digest it states")
            yield {
                "page_id": int(page) if page else None,
                "url": row["url"],
                "record_type": headers["warc-type"],
                "refers_to": int(refers) if refers else None,
                "payload_digest": digest,
                "http_bytes": len(payload) if whole else None,
                "payload": payload if whole and payloads else None,
            }
    finally:
        if source is not None:
            source.close()


def _as_records(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "http_bytes": "Int64"})


def _fetched(places: DataFrame, payloads: bool, kept: str | None = None) -> DataFrame:
    """Records at their places, dealt and sorted by file and offset, so that each task reads files from front to back.

    ``kept`` names a column of the places that goes along.
    """
    carry = [kept] if kept else []

    def framed(rows: list[dict], along: list) -> pd.DataFrame:
        return _as_records(rows).assign(**{c: along for c in carry})

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, along, size = [], [], 0
            said = batch[kept].tolist() if kept else [None] * len(batch)
            for x, one in zip(_records(batch[["file", "offset", "length", "url"]].to_dict("records"), payloads), said, strict=True):
                held.append(x)
                along.append(one)
                size += len(x["payload"] or b"")
                if size > 1 << 24:
                    yield framed(held, along)
                    held, along, size = [], [], 0
            if held:
                yield framed(held, along)

    nearby = places.select("file", "offset", "length", "url", *carry).repartitionByRange("file", "offset")
    return nearby.sortWithinPartitions("file", "offset").mapInPandas(fetch, RECORDS + "".join(f", {c} string" for c in carry))


def read_archive(archive: Archive, payloads: bool = True) -> DataFrame:
    """Every record, read through the index: blocks, then ranges of the files.

    Captures of all blocks are sorted by file and offset first, so that a file
    is read from front to back.  A digest that does not fit raises.  NULL and
    empty payloads come back empty, repeated pages as often as they were
    written; an empty archive gives no rows.
    """

    def captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                yield _captures([_unline(x) for x in _block(file, offset, length)])

    listed = archive.directory.select("file", "offset", "length").repartition("file", "offset").mapInPandas(captures, CAPTURES)
    return _fetched(listed, payloads)


def look_up(archive: Archive, urls: DataFrame, url: str = "url", payloads: bool = True, exact: bool = False) -> DataFrame:
    """Records of the URLs asked for, each with ``asked``, the URL as it was asked.

    A URL finds all captures of its key; with ``exact`` only those of the very
    URL, NULL as the empty one, so that asking for the URLs of all pages gives
    every record once.

    Level one: the directory's sorted first keys are searched for each URL's
    key.  The directory has one row per block, ``1 / block_lines`` of the
    captures; it is cut into ranges of its own order, so that tasks hold a
    range of it and never the whole.  Level two: the block is read and searched.
    The places found are then dealt by file and offset and range-read.
    Repeated, NULL and unknown URLs are fine; unknown ones give no row.
    """
    said = F.col(url).cast("string")
    asked = urls.select((F.coalesce(said, F.lit("")) if exact else said).alias("asked")).distinct()

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(url_key=[url_key(u) for u in batch["asked"]])

    keys = asked.mapInPandas(keyed, "asked string, url_key string").select(
        F.col("url_key").alias("at"), F.lit(1).alias("kind"), "asked", *[F.lit(None).cast(t).alias(c) for c, t in _PLACE]
    )
    blocks = archive.directory.select(
        F.col("part").alias("range"), F.col("first_key").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("asked"), *[c for c, _ in _PLACE]
    )
    parts = archive.directory.groupBy("part").agg(F.min("first_key").alias("from_key"), F.max("last_key").alias("to_key"))
    # each range of the directory meets the keys that fall into it: a bounded list of range borders finds the ranges
    borders = [(r["from_key"], r["to_key"], r["part"]) for r in parts.orderBy("from_key", "part").collect()]

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = [b[0] for b in borders]
        ends = [b[1] for b in borders]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                low = bisect.bisect_left(ends, row.at)
                for b in borders[low : bisect.bisect_right(starts, row.at)]:
                    out.append((b[2], *row))
            yield pd.DataFrame(out, columns=["range", *batch.columns])

    kinds = ", ".join(f"{c} {t}" for c, t in _PLACE)
    sent = keys.mapInPandas(routed, f"range int, at string, kind int, asked string, {kinds}")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[str] = []
        places: list = []
        held_range: object = None
        for batch in batches:
            wanted: dict = {}
            for row in batch.itertuples(index=False):
                if row.range != held_range:
                    held_range, first, places = row.range, [], []
                if row.kind == 0:
                    first.append(row.first_key)
                    places.append(row)
                    continue
                low = max(0, bisect.bisect_left(first, row.at) - 1)
                for place in places[low : bisect.bisect_right(first, row.at)]:
                    if place.last_key >= row.at:
                        here = wanted.setdefault((place.file, int(place.offset), int(place.length)), {})
                        here.setdefault(row.at, set()).add(row.asked)
            for place, asked_here in wanted.items():
                lines = _block(*place)
                block_keys = [x.split("\t", 1)[0] for x in lines]
                found = []
                for key, said in asked_here.items():
                    written = _line([key])
                    for line in lines[bisect.bisect_left(block_keys, written) : bisect.bisect_right(block_keys, written)]:
                        row = _unline(line)
                        same = ([row["url"]] if row["url"] in said else []) if exact else said
                        found += [(row["file"], row["offset"], row["length"], row["url"], one) for one in same]
                if found:
                    yield pd.DataFrame(found, columns=["file", "offset", "length", "url", "asked"])

    ordered = sent.unionByName(blocks).repartition("range").sortWithinPartitions("range", "kind", "at", "offset")
    places = ordered.mapInPandas(search, "file string, offset long, length long, url string, asked string")
    return _fetched(places, payloads, "asked")


_PLACE = (
    ("first_key", "string"),
    ("last_key", "string"),
    ("file", "string"),
    ("offset", "long"),
    ("length", "long"),
)
