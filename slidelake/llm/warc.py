"""WARC archives with a two-level capture index.

Records are written to archives, one gzip member each.  Index lines are sorted
by reversed-host URL keys and packed into compressed blocks that hold the place
of every record; a sparse directory holds the first key of each block, and the
first key of each directory page is small enough to travel to every task.  A
lookup searches page, block and line by bisection and reads only the bytes of
the records asked for.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.session import cut_lineage, scratch_path

#: Payloads below this many bytes are always stored.
MIN_REVISIT_BYTES = 100
BLOCK_LINES = 256
PAGE_BLOCKS = 256
#: Directory pages whose first keys may travel to every task; 65,536 lines each.
MAX_PAGES = 1_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:`` is one scheme among others."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` in lower-case host order; a null URL gives ``)``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(?::\d*)?([\s\S]*)$"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(url, pattern, 2))


def _escape(text: str) -> str:
    """One line without tabs, whatever the URL holds."""
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def plan_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages with key, digest, record type and the page they refer to.

    The smallest non-null id of an equal payload is stored, the others revisit
    it.  Where all ids are null, every record is stored.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.concat(url_key(F.col("url")), F.lit(" "), F.coalesce(F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lit("-"))).alias("key"),
        body.alias("payload"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_digest"),
    )
    # Only payloads that occur more than once have to meet; their ids are combined before the shuffle.
    first = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
        .select("payload_digest", "_first")
    )
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return (
        rows.join(first, "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_first")))
        .drop("_first")
    )


def _record(page_id, url: str, payload: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_escape(url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises when payload and digest do not fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {fields['WARC-Page-ID']}")
    refers = fields.get("WARC-Refers-To-Page")
    return {
        "page_id": int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None, "url": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": int(refers) if refers else None,
    }


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write all pages as WARC archives; returns the index blocks and the sparse directory.

    ``pages(page_id, url, html)``: null html is an empty payload, a null URL has
    the key ``)``, repeated rows give one record each, an empty table no archive;
    further columns are ignored.  Blocks are ``(block, first_key, lines BINARY)``,
    the directory has no lines but page numbers.  A retried task
    writes archives of its own name; the index names those of committed tasks only.
    """
    spark = pages.sparkSession
    folder = (folder or scratch_path(spark, "warc")).rstrip("/")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["page_id", "url", "key", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, out, place = TaskContext.get(), None, 0
        archive = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        try:
            for frame in frames:
                rows = []
                for r in frame.itertuples(index=False):
                    if out is None:
                        store, path = open_store(archive)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    page = None if pd.isna(r.page_id) else int(r.page_id)
                    refers = None if pd.isna(r.refers_to) else int(r.refers_to)
                    data = gzip.compress(_record(page, r.url, r.payload, r.payload_bytes, r.payload_digest, r.record_type, refers), 1, mtime=0)
                    out.write(data)
                    rows.append((_escape(r.key), archive, place, len(data)))
                    place += len(data)
                yield pd.DataFrame(rows, columns=["key", "archive", "place", "length"])
        finally:
            if out is not None:
                out.close()

    # Payloads move once at most, to meet their first copy; the sort works on index lines alone.
    lines = cut_lineage(
        plan_records(pages, min_bytes).select(*columns).mapInPandas(write, "key string, archive string, place bigint, length bigint")
    )

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number, held, last = TaskContext.get().partitionId() << 32, 0, [], None

        def block() -> pd.DataFrame:
            nonlocal held, number
            packed = zlib.compress("\n".join("\t".join(x) for x in held).encode("utf-8", "surrogatepass"))
            row = pd.DataFrame({"block": [base + number], "first_key": [held[0][0]], "lines": [packed]})
            held, number = [], number + 1
            return row

        for frame in frames:
            for key, archive, place, length in frame.itertuples(index=False):
                if len(held) >= BLOCK_LINES and key != last:  # equal keys stay in one block
                    yield block()
                held.append((key, archive, str(place), str(length)))
                last = key
        if held:
            yield block()

    blocks = cut_lineage(
        lines.repartitionByRange(width, "key").sortWithinPartitions("key").mapInPandas(fold, "block bigint, first_key string, lines binary")
    )
    # Range partitions follow key order, so block numbers rise with the keys.
    part = F.shiftright("block", 32)
    inside = F.col("block") - F.shiftleft(part, 32)
    directory = blocks.select("block", "first_key", F.shiftleft(part, 32).bitwiseOR((inside / PAGE_BLOCKS).cast("bigint")).alias("page"))
    return blocks, directory


def lookup(keys: DataFrame, blocks: DataFrame, directory: DataFrame) -> DataFrame:
    """Records of the asked ``key`` values, each once, found by bisection and read by byte ranges.

    Keys without a record give no row.
    """
    spark = keys.sparkSession
    tops = directory.groupBy("page").agg(F.min(F.struct("block", "first_key")).alias("t")).select("page", "t.first_key")
    top = tops.orderBy("page").limit(MAX_PAGES + 1).collect()
    if len(top) > MAX_PAGES:
        raise ValueError(f"over {MAX_PAGES} directory pages; raise PAGE_BLOCKS")
    shared = spark.sparkContext.broadcast(([r.first_key for r in top], [r.page for r in top]))

    def to_page(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, pages = shared.value
        for frame in frames:
            at = [bisect_right(firsts, _escape(k)) - 1 for k in frame["key"]]
            kept = [(k, pages[i]) for k, i in zip(frame["key"], at) if i >= 0]
            yield pd.DataFrame(kept, columns=["key", "page"])

    asked = keys.select("key").distinct().mapInPandas(to_page, "key string, page bigint")

    # One row per directory page: the bisection inside a page needs no range join.
    sheet = directory.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("block", "first_key"))).alias("sheet"))

    def to_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for asked_keys, numbers, firsts in zip(frame["keys"], frame["blocks"], frame["firsts"]):
                firsts = list(firsts)
                out += [(k, numbers[bisect_right(firsts, _escape(k)) - 1]) for k in asked_keys]
            yield pd.DataFrame(out, columns=["key", "block"])

    # A page holds PAGE_BLOCKS * BLOCK_LINES different keys at most.
    grouped = asked.groupBy("page").agg(F.collect_list("key").alias("keys"))
    found = (
        grouped.join(sheet, "page")
        .select("keys", F.col("sheet.block").alias("blocks"), F.col("sheet.first_key").alias("firsts"))
        .mapInPandas(to_block, "key string, block bigint")
    )
    # A block holds some hundred lines, so its asked keys fit one row.
    wanted = found.groupBy("block").agg(F.collect_list("key").alias("keys"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "key"]
        for frame in frames:
            for lines, asked_keys in zip(frame["lines"], frame["keys"]):
                pending = {_escape(k): k for k in asked_keys}
                entries = [x.split("\t") for x in zlib.decompress(lines).decode("utf-8", "surrogatepass").split("\n")]
                out = []
                # One archive is open at a time, its ranges in order.
                for archive, part in groupby(sorted((e[1], int(e[2]), int(e[3]), e[0]) for e in entries if e[0] in pending), key=lambda e: e[0]):
                    store, path = open_store(archive)
                    with store.open_input_file(path) as source:
                        for _, place, length, key in part:
                            out.append(parse_record(gzip.decompress(source.read_at(length, place))) | {"key": pending[key]})
                rows = pd.DataFrame(out, columns=names)
                yield rows.astype({"page_id": "Int64", "refers_to": "Int64"})

    return blocks.join(wanted, "block").select("lines", "keys").mapInPandas(
        read,
        "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, key string",
    )


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, then fetch every page's record through the index."""
    blocks, directory = write_archives(pages, folder)
    keys = pages.select(
        F.concat(
            url_key(F.col("url")), F.lit(" "), F.coalesce(F.lpad(F.col("page_id").cast("bigint").cast("string"), 20, "0"), F.lit("-"))
        ).alias("key")
    )
    return lookup(keys, blocks, directory)
