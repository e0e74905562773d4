"""WARC volumes and their fixity: Merkle trees over records and ordered offset ranges.

Records are written as WARC/1.1 resource records, read back from files, and
audited. A volume's tree has a leaf for each range of RANGE_BYTES offsets: the
SHA-256 of the offsets, lengths and digests of the records that begin there,
in order. FANOUT neighbouring nodes have one parent, up to the volume's root;
volumes are joined by the leading hex digits of their names' digests, up to
one root for a replica. An audit compares the roots and descends, one level at
a time, only below nodes that differ, until it holds the records in question.

Files are read and digested by Arrow functions, trees are DataFrame functions.
A parent reads at most FANOUT children or the records of one range; only the
nodes by prefix grow, with the number of volumes over 16**DIGITS.

Pages should have ids of their own: the record ids of a repeated id repeat.
All records have one date, as pages have none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.runtime import cut

#: Offsets that a leaf covers, children of a node, hex digits by which volumes are joined.
RANGE_BYTES, FANOUT, DIGITS = 1 << 16, 16, 3
#: Bytes that are expanded, or sent on, at once.
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF, END = "\r\n", "\r\n\r\n"
#: The name that Spark gives a file of a partition, after whose number a random part follows.
_PART = re.compile(r"^(part-\d+)-.*$")


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The WARC record of a page, without the two line ends that close it. Nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""),
        body,
    ]
    return F.concat_ws(CRLF, *lines)


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(row_no, page_id, record): one row per page; repeated and null ids are rows like any other."""
    return pages.select(F.monotonically_increasing_id().alias("row_no"), F.col(page_id).alias("page_id"), record(F.col(page_id), F.col(url), F.col(html)).alias("record"))


def write_warc(pages: DataFrame, path: str, compression: str = "gzip", **columns: str) -> None:
    """A folder of WARC files, one for each partition of the scan, each a gzip stream (or plain: "none")."""
    records(pages, **columns).select("record").write.option("lineSep", END).option("compression", compression).text(path)


_LENGTH = re.compile(rb"^content-length:\s*(\d+)\s*$", re.IGNORECASE | re.MULTILINE)
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.MULTILINE)


def content(data: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces, expanded if it is gzip (of one member or many)."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(data, PIECE)
            data = member.unconsumed_tail
            if not piece and not data and not member.eof:
                raise ValueError("the gzip stream ends early")
            yield piece
        data = member.unused_data


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes, str]]:
    """(offset, length, headers, block, digest) of each record of a file; a damaged rest is an error.

    digest: SHA-256 of the record without the two line ends that close it. One
    record and one piece are in memory at a time.
    """
    held, at, rest = bytearray(), 0, iter(pieces)

    def more() -> bool:
        piece = next(rest, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        seen = 0
        while (stop := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                if held:
                    raise ValueError(f"no WARC record at offset {at}")
                return
        head = bytes(held[:stop])
        size = _LENGTH.search(head)
        if not head.startswith(b"WARC/") or not size:
            raise ValueError(f"no WARC record at offset {at}")
        begin, end = stop + 4, stop + 4 + int(size[1])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} does not end where its length says")
        record = bytes(held[:end])
        del held[: end + 4]
        yield at, end + 4, {k.decode().lower(): v.decode() for k, v in _FIELD.findall(head)}, record[begin:], sha256(record).hexdigest()
        at += end + 4


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """volume, offset, length, uri, record_id, digest, block (null without `blocks`): the records of a file or folder.

    A volume is a file, by name up to its part number where Spark wrote it. One
    task reads a file, which Spark's reader limits to 2 GB as stored; records
    are parsed as they are expanded and leave in batches of about PIECE bytes.
    """
    names = ["volume", "offset", "length", "uri", "record_id", "digest", "block"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                volume, held = _PART.sub(r"\1", name.rsplit("/", 1)[-1]), 0
                for offset, length, head, block, digest in parse_warc(content(data.as_py())):
                    out.append((volume, offset, length, head.get("warc-target-uri"), head.get("warc-record-id"), digest, block if blocks else None))
                    held += length if blocks else 200
                    if held >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "volume string, offset long, length long, uri string, record_id string, digest string, block binary")


def _joined(rows: DataFrame, keys: list[str], order: str, parts: list[str]) -> DataFrame:
    """keys, hash: the digest of each group's parts in order; a group has a bounded number of rows."""
    line = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("hash"))


def tree(archive: DataFrame) -> list[DataFrame]:
    """Levels of a replica's tree from the ranges up; archive: volume, offset, length, digest.

    The first levels are keyed by (volume, k), the last by a prefix in `volume`
    and k = 0; the last one is the root. An empty archive has an empty root.
    """
    ranges = archive.withColumn("k", F.floor(F.col("offset") / RANGE_BYTES))
    levels = [cut(_joined(ranges, ["volume", "k"], "offset", ["offset", "length", "digest"]))]
    top = levels[0].agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    while top > 0:
        up = levels[-1].select("volume", F.floor(F.col("k") / FANOUT).alias("k"), F.col("k").alias("child"), F.col("hash").alias("h"))
        levels.append(cut(_joined(up, ["volume", "k"], "child", ["child", "h"])))
        top //= FANOUT
    for n in range(DIGITS, -1, -1):
        name = F.sha2("volume", 256) if n == DIGITS else F.col("volume")
        up = levels[-1].select(F.substring(name, 1, n).alias("up"), F.lit(0).cast("long").alias("k"), F.col("volume").alias("child"), F.col("hash").alias("h"))
        levels.append(cut(_joined(up.withColumnRenamed("up", "volume"), ["volume", "k"], "child", ["child", "h"])))
    return levels


def root(levels: list[DataFrame]) -> str | None:
    """A replica's root; none for an empty archive."""
    row = levels[-1].first()
    return row["hash"] if row else None


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """volume, offset, length, digest, other_length, other_digest: the records in which replica b differs from a.

    A record that only one replica has shows nulls for the other. Only
    branches whose hashes differ are read below the roots; equal replicas end
    at the roots with an empty result. Offsets are unique within a volume.
    """
    trees = tree(a), tree(b)
    height = [len(t) - DIGITS - 1 for t in trees]  # levels keyed by (volume, k)
    common = min(height)
    keys = ["volume", "k"]
    differ = None
    if root(trees[0]) == root(trees[1]):
        found = a.limit(0).select("volume", F.lit(0).cast("long").alias("k"))
    else:
        pairs = [(trees[0][height[0] + i], trees[1][height[1] + i], i) for i in range(DIGITS, -1, -1)]
        pairs += [(trees[0][i], trees[1][i], i - common) for i in range(common - 1, -1, -1)]
        for x, y, step in pairs:
            both = x.select(*keys, F.col("hash").alias("p")).join(y.select(*keys, F.col("hash").alias("q")), keys, "full")
            if differ is not None:
                if step >= 0:  # prefixes: a child's parent is the prefix one digit shorter
                    parent = [F.expr(f"substring(volume, 1, {DIGITS - step - 1})").alias("pv"), F.lit(0).cast("long").alias("pk")]
                elif step == -1:  # the highest level of volumes that both trees have; its parent is the volume's group
                    parent = [F.substring(F.sha2("volume", 256), 1, DIGITS).alias("pv"), F.lit(0).cast("long").alias("pk")]
                else:
                    parent = [F.col("volume").alias("pv"), F.floor(F.col("k") / FANOUT).alias("pk")]
                both = both.select("*", *parent).join(differ.select(F.col("volume").alias("pv"), F.col("k").alias("pk")), ["pv", "pk"], "left_semi")
            differ = cut(both.where(~F.col("p").eqNullSafe(F.col("q"))).select(*keys))
        found = differ
    at = F.floor(F.col("offset") / RANGE_BYTES).alias("k")
    left = a.select("volume", "offset", "length", "digest", at).join(found, keys, "left_semi").drop("k")
    right = b.select("volume", "offset", F.col("length").alias("other_length"), F.col("digest").alias("other_digest"), at).join(found, keys, "left_semi").drop("k")
    both = left.join(right, ["volume", "offset"], "full")
    same = F.col("length").eqNullSafe(F.col("other_length")) & F.col("digest").eqNullSafe(F.col("other_digest"))
    return both.where(~same).select("volume", "offset", "length", "digest", "other_length", "other_digest")
