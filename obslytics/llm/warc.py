"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member for each capture into archive files in a shared folder; of captures with
equal payloads the one with the largest id is the response and the others are revisits that refer to it.
``build_index`` sorts the captures by reversed-host URL key and id into compressed blocks; beside each index file
lies its sparse directory with the first key of every block.  The list of index files is one more file of the same form.
``lookup`` finds captures by binary search, first among the index files, then in one directory, and reads one block and
then the record by byte range.

Folders can be in any store that ``pyarrow.fs`` opens by URI.  A task that is run again writes new files; files of
lost attempts are named by no index row.

Defined results: null payload is empty, a null URL has the key ``-``; equal ids with equal payloads are all
responses; repeated rows give repeated records; an empty table gives an empty index; columns other than id, URL and
payload are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslytics.llm.common import hot_keys, join_apart, new_folder, stored

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 500
LEVEL = 3  # of compression
DATE = "2020-01-01T00:00:00Z"  # the pages carry no capture time


def surt(url: Column) -> Column:
    """Key of a URL: the host's labels reversed, ``)``, port and the rest; other texts stay as they are."""
    whole = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(:[0-9]+)?(.*)$"
    host = F.lower(F.regexp_extract(url, whole, 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.regexp_extract(url, whole, 2), F.lit(")"), F.regexp_extract(url, whole, 3))
    return F.coalesce(F.when(host == "", url).otherwise(key), F.lit("-"))


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


# ---- records ------------------------------------------------------------------------------------------------

def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One compressed record; ``refers_to``: the id of the response that a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in raw.decode().split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """Fields of a compressed record; the payload of a response is held against its digest."""
    raw = zlib.decompress(raw, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    head = headers(head)
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    ident = lambda name: (lambda x: int(x) if x else None)(head.get(name, "<urn:page:>")[10:-1])
    out = {"page_id": ident("warc-record-id"), "record_type": head["warc-type"], "refers_to": ident("warc-refers-to"),
           "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(headers(http)["content-length"]),
           "payload": None, "url": head.get("warc-target-uri")}
    if out["record_type"] == "response":
        if len(payload) != out["payload_bytes"] or sha1(payload) != out["payload_digest"]:
            raise ValueError(f"damaged record of page {out['page_id']}")
        out["payload"] = payload
    return out


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing ------------------------------------------------------------------------------------------------

CAPTURE_DDL = "key string, page_id long, file string, at long, size long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Captures (key, page_id, file, at, size) of the records written.  Payloads below ``min_bytes`` are never revisits."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(payload_col, F.lit("")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    same = stored(rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1")
                  .agg(F.count("*").alias("n"), F.max("page_id").alias("response")).where("n > 1"), "equal-payloads")
    # payloads that very many pages share stay where they are
    hot = hot_keys(same, ["sha1"], "n", max(1, same.agg(F.sum("n")).first()[0] or 0))
    rows = (join_apart(rows, same.select("sha1", "response"), ["sha1"], hot, "left")
            .select(surt(F.col("url")).alias("key"), "page_id", "url", "payload", F.unhex("sha1").alias("sha1"),
                    F.when(~F.col("page_id").eqNullSafe(F.col("response")) & (F.octet_length("payload") >= min_bytes), F.col("response"))
                    .alias("refers_to")))

    def write(batches):
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    key, page_id, url, payload, digest, refers_to = row
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    raw = record(page_id, url, payload.encode(), base64.b32encode(digest).decode(), refers_to)
                    out.write(raw)
                    lines.append((key, page_id, name, at, len(raw)))
                    at += len(raw)
                cols = list(zip(*lines, strict=True)) or [()] * 5
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 names=["key", "page_id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return stored(rows.mapInArrow(write, CAPTURE_DDL), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Index files over ``captures``; returns their list (file, key, page_id, blocks): the first entry of each.

    The list itself is written as one more file of the same form, named ``ROOT``: a reader holds its directory, one
    entry for each ``BLOCK_LINES`` index files, and no task a list of all files."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    files = stored(ordered.mapInArrow(_index_writer(folder), INDEX_DDL), "index-files")
    lines = files.select("key", "page_id", "file", F.lit(0).cast("long").alias("at"), "blocks")
    stored(lines.repartition(1).sortWithinPartitions("key", "page_id").mapInArrow(_index_writer(folder, ROOT), INDEX_DDL), "index-root").count()
    return files


ROOT = "root"
INDEX_DDL = "file string, key string, page_id long, blocks long"


def _index_writer(folder: str, own_name: str | None = None):
    """Writes sorted lines as compressed blocks and a directory with the first key of each."""

    def write(batches):
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        name = own_name or f"index-{uuid.uuid4().hex}"
        out, first, directory, at, lines = None, None, [], 0, []

        def flush():
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), LEVEL)
            out.write(raw)
            directory.append((lines[0][0], lines[0][1], at, len(raw)))
            at += len(raw)
            lines.clear()

        for batch in batches:
            for line in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out, first = store.open_output_stream(f"{path}/{name}.blocks"), line
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        with store.open_output_stream(f"{path}/{name}.directory") as side:
            side.write("\n".join(json.dumps(x) for x in directory).encode())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (first[0], pa.string()), (first[1], pa.int64()),
                                                                        (len(directory), pa.int64()))], names=["file", "key", "page_id", "blocks"])

    return write


# ---- reading ------------------------------------------------------------------------------------------------

def place(key: str, page_id: int | None) -> tuple:
    """Sorts as Spark does: by key, and null ids first."""
    return key, page_id is not None, page_id or 0


class Index:
    """Reader of an index and its archives; holds a few directories, blocks and open files at a time."""

    def __init__(self, folder: str):
        self.store, self.path = open_folder(folder)
        self.kept: OrderedDict = OrderedDict()

    def _cached(self, what: tuple, make):
        if what in self.kept:
            self.kept.move_to_end(what)
        else:
            self.kept[what] = make()
            if len(self.kept) > 32:
                self.kept.popitem(last=False)
        return self.kept[what]

    def read(self, name: str, at: int, size: int) -> bytes:
        file = self._cached(("file", name), lambda: self.store.open_input_file(f"{self.path}/{name}"))
        file.seek(at)
        return file.read(size)

    def directory(self, name: str) -> tuple[list, list]:
        def load():
            with self.store.open_input_file(f"{self.path}/{name}.directory") as f:
                rows = [json.loads(x) for x in f.read().decode().split("\n")]
            return rows, [place(r[0], r[1]) for r in rows]
        return self._cached(("directory", name), load)

    def block(self, name: str, entry: list) -> tuple[list, list]:
        def load():
            raw = zlib.decompress(self.read(f"{name}.blocks", entry[2], entry[3]))
            rows = [json.loads(x) for x in raw.decode().split("\n")]
            return rows, [place(r[0], r[1]) for r in rows]
        return self._cached(("block", name, entry[2]), load)

    def lines(self, name: str, low: tuple, high: tuple, before: bool) -> Iterator[list]:
        """Lines of an index file from ``low`` to ``high``, both included; with ``before`` also the last line below ``low``."""
        rows, firsts = self.directory(name)
        at = max(0, bisect.bisect_left(firsts, low) - 1)
        while at < len(rows) and firsts[at] <= high:
            lines, places = self.block(name, rows[at])
            start = bisect.bisect_left(places, low)
            yield from lines[max(0, start - 1) if before and at <= max(0, bisect.bisect_left(firsts, low) - 1) else start: bisect.bisect_right(places, high)]
            at += 1

    def find(self, low: tuple, high: tuple) -> Iterator[list]:
        """Index lines from ``low`` to ``high``, both included: through the root, the directory and the blocks of the files."""
        for entry in self.lines(ROOT, low, high, before=True):
            yield from self.lines(entry[2], low, high, before=False)

    def captures(self, key: str) -> Iterator[dict]:
        """All captures of a key."""
        for line in self.find((key,), (key, True, float("inf"))):
            yield parse(self.read(line[2], line[3], line[4]))


FOUND_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def lookup(wanted: DataFrame, index: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """Captures of ``wanted(key, page_id)``, read through the index files that ``index`` lists.

    Wanted keys are sorted, so a task reads neighbouring blocks."""
    if index.limit(1).count() == 0:
        return wanted.sparkSession.createDataFrame([], FOUND_DDL)

    def read(batches):
        reader = Index(folder)
        for batch in batches:
            out = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = place(key, page_id)
                for line in reader.find(at, at):
                    x = parse(reader.read(line[2], line[3], line[4]))
                    out.append((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"], x["payload"] if keep_payload else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    ordered = wanted.distinct().repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(read, FOUND_DDL)


def archive_and_read(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     keep_payload: bool = False) -> DataFrame:
    """Write archives and index of ``pages`` to the shared folder, then read every capture back by its key and id."""
    folder = new_folder(pages.sparkSession, "warc")
    index = build_index(write_archives(pages, folder, min_bytes, id_col, url_col, payload_col), folder)
    wanted = pages.select(surt(F.col(url_col)).alias("key"), F.col(id_col).cast("long").alias("page_id"))
    found = lookup(wanted, index, folder, keep_payload).withColumnRenamed("page_id", id_col)
    return found if keep_payload else found.drop("payload")
