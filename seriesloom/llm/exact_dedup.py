"""Exact duplicates by deterministic block naming. DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. Equal blocks
get one integer name, found by sorting the blocks; then adjacent names are
paired and each distinct pair is named in the same way, until every document
has a single name. Names come from ranks in sorted order and never from a hash,
so two documents share a name exactly when their texts are identical.

Scale. Blocks are combined in every task before they are shuffled and sorted, so
a block travels once a task however many rows repeat it. A row then finds its
block's name by a 64-bit hash that is known to belong to one block only; rows of
hashes that do not are named by the blocks themselves. Later rounds carry
8-byte names of half as many rows each, named in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.text import ascii_lower
from seriesloom.runtime import cut, with_marked

#: Bytes of a block.
BLOCK_BYTES = 4096
#: Names of pairs are bucket * 2**RANK_BITS + rank in the bucket.
BUCKETS, RANK_BITS = 1 << 20, 40


def _ranked(df: DataFrame, keys: list[str]) -> Column:
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy(*keys))
    return F.shiftleft(bucket, RANK_BITS) + rank.cast("long")


def _name_blocks(rows: DataFrame) -> DataFrame:
    """rows with `block` replaced by `name`: a number above zero, the same for equal blocks only."""
    rows = rows.withColumn("h", F.xxhash64("block"))
    ordered = rows.select("h", "block").distinct().sortWithinPartitions("h", "block")
    names = cut(ordered.select("h", (F.monotonically_increasing_id() + 1).alias("name")))  # partition and rank; fixed once it is stored
    shared = cut(names.groupBy("h").count().where("count > 1").select("h"))  # hashes of several blocks
    whole = rows.drop("block").join(names, "h")
    if not shared.isEmpty():
        few = rows.join(shared, "h", "left_semi")
        own = few.select("block").distinct()
        own = cut(own.sortWithinPartitions("block").select("block", (-1 - F.monotonically_increasing_id()).alias("name")))
        whole = whole.join(shared, "h", "left_anti").unionByName(few.join(own, "block").drop("block"))
    return whole.drop("h")


def _name_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with `name`; distinct pairs are ranked, so that repeats never meet in one sort."""
    distinct = pairs.select("a", "b").distinct()
    names = distinct.withColumn("name", _ranked(distinct, ["a", "b"]))
    return pairs.join(names, ["a", "b"]).drop("a", "b")


def text_identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: row_no, doc_id, text_sha256, level, name.

    (level, name) is equal for two rows exactly when their texts are equal
    after lower-casing A-Z; a null text is the empty text. row_no is the row's
    number in the scan of `docs`, which must be a stored table: it is read
    more than once.
    """
    text_bytes = ascii_lower(F.col(text)).cast("binary")
    source = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(doc_id).alias("doc_id"), text_bytes.alias("bytes"))
    blocks_of = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block_bytes)).cast("int")
    spread = source.select("row_no", "doc_id", "bytes", blocks_of.alias("n"), F.explode(F.sequence(F.lit(0), blocks_of - 1)).alias("pos"))
    first = F.col("pos") == 0
    rows = spread.select(
        "row_no", "n", "pos",
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.sha2("bytes", 256)).alias("text_sha256"),
        F.substring("bytes", F.col("pos") * block_bytes + 1, F.lit(block_bytes)).alias("block"),
    )
    named = cut(_name_blocks(rows))
    level, done, most = 0, [], named.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    while True:
        done.append(named.where("n = 1").select("row_no", "doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        pairs = (
            named.where("n > 1")
            .groupBy("row_no", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),  # no name is 0
                F.max("doc_id").alias("doc_id"),
                F.max("text_sha256").alias("text_sha256"),
            )
        )
        named, level, most = cut(_name_pairs(pairs)), level + 1, -(-most // 2)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row_no, doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Of the rows with equal texts (A-Z lower-cased, null as empty) the one with
    the largest doc_id is kept; a null doc_id is smaller than any other. If
    that doc_id occurs in several rows of a group, one of those rows is kept.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows = text_identities(docs, doc_id, text, block_bytes)
    groups = rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row_no")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    shared = cut(groups.where("group_size > 1"))  # the other rows need no partner; apart from the join, which may then split a large group
    joined = rows.join(shared, ["level", "name"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "row_no",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep.row_no") == F.col("row_no"))).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns.

    Rows are told by their number in the scan, so `docs` must be a stored
    table, whose files every scan reads in the same order.
    """
    kept = exact_dedup(docs, doc_id, text).where("kept").select(F.col("row_no").alias("__row_no"))
    numbered = docs.withColumn("__row_no", F.monotonically_increasing_id())
    found = with_marked(numbered, kept, "__row_no", keep=True)
    if found is None:
        found = numbered.join(kept, "__row_no", "left_semi")
    return found.drop("__row_no")
