"""Exact dedup by progressive refinement.

Rows are grouped by normalised length, those whose length recurs by a hash of their prefix too, and only rows whose
length and prefix recur have their full content hashed. The first two steps work on a narrow table of ids and keys,
written once: texts are never shuffled to find out that they are unique. What is left is a set of ids. A bitmap of
their hashes, sized by their count, tells the second scan whose full content to hash; a bucket shared by chance only
costs a needless hash, for groups are formed by length and SHA-256 alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import carried, column, free_name, materialise

PREFIX_CHARS = 64
#: Bits of the bitmap for each surviving id (about one id in 16 then passes by chance), and its least and greatest size.
#: The greatest, 128 MB as a broadcast, serves a hundred million survivors so; with more of them more rows are hashed
#: needlessly, up to one hash a row, and still no text is shuffled.
BITS_PER_ID = 16
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 30
_PAGE_BITS = 32_768  # of one bitmap of bitmap_construct_agg


def normalised(text: Column) -> Column:
    """A text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


@dataclass(frozen=True)
class Sieve:
    """Bitmap pages of id hashes; ``bits`` in all."""

    pages: DataFrame
    bits: int

    def applied(self, df: DataFrame, id_col: str, hit: str) -> DataFrame:
        """``df`` with boolean ``hit``: whether the row's id may be among those of the bitmap (a null one always)."""
        bucket, page, bits = (free_name(df, n) for n in ("sieve_bucket", "sieve_page", "sieve_bits"))
        at = df.withColumn(bucket, _bucket(column(id_col), self.bits)).withColumn(page, F.expr(f"{bucket} div {_PAGE_BITS}"))
        pages = self.pages.select(F.col("page").alias(page), F.col("bits").alias(bits))
        byte = F.conv(F.hex(F.expr(f"substring({bits}, cast(({bucket} % {_PAGE_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        found = F.coalesce(byte, F.lit(0)).bitwiseAND(F.expr(f"shiftleft(1, cast({bucket} % 8 as int))")) != 0
        joined = at.join(F.broadcast(pages), page, "left")  # MOST_BITS at most, whatever the data
        return joined.withColumn(hit, column(id_col).isNull() | found).drop(bucket, page, bits)


def _bucket(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(bits).cast("bigint"))


def survivors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Column ``id``: of the rows that share normalised length and prefix hash with another row; repeats included."""
    norm = docs.select(column(id_col).alias("id"), normalised(column(text_col)).alias("norm"))
    prefix = F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))
    keys = materialise(norm.select("id", F.length("norm").alias("len"), prefix.alias("prefix")), "dedup-keys")
    # counts are aggregated before they are joined back, and both sides are read from files, so that a hot key's rows
    # can be split
    lens = materialise(keys.groupBy("len").count().where("count > 1").select("len"), "dedup-lens")
    left = keys.join(lens, "len", "left_semi")
    pairs = materialise(left.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix"), "dedup-prefixes")
    return keys.join(pairs, ["len", "prefix"], "left_semi").select("id")


def sieve(ids: DataFrame) -> Sieve:
    """The bitmap of ids, sized by their count."""
    ids = materialise(ids.where("id is not null"), "dedup-survivors")
    wanted = BITS_PER_ID * ids.count()
    bits = LEAST_BITS
    while bits < wanted and bits < MOST_BITS:
        bits *= 2
    buckets = ids.select(_bucket(F.col("id"), bits).alias("b"))
    pages = buckets.groupBy(F.expr(f"b div {_PAGE_BITS}").alias("page")).agg(F.bitmap_construct_agg(F.col("b") % _PAGE_BITS).alias("bits"))
    return Sieve(materialise(pages, "dedup-sieve"), bits)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, digest_col: str | None = None
) -> DataFrame:
    """Every row of ``docs`` (its ``carry`` columns, all by default) with ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when identical without ASCII white space; null counts as empty. Of a group the row with the
    most code points in its original text stays, then the smallest id (null last), then an arbitrary but single
    one of rows that repeat an id. ``keep_id`` is that row's id; ids are of any type that sorts. A carried column named
    like one of the three gives way to it. ``digest_col`` names a further output column, the SHA-256 of every row's
    normalised text; all full contents are then hashed, once, and the refinement uses the same hash. An empty table
    gives an empty result. Two scans of the text; the carried columns are written once, and only rows that share
    length and prefix with another are shuffled, by a join whose hot keys adaptive execution can split.
    """
    own = ["keep_id", "group_size", "kept"] + ([digest_col] if digest_col else [])
    carry = [c for c in carried(docs, *own) if carry is None or c in carry]
    row = F.struct(*[column(c) for c in carry]) if carry else F.struct(F.lit(0).alias("_"))
    text = column(text_col)
    table = docs.select(row.alias("row"), column(id_col).alias("id"), text.alias("text"))
    table = sieve(survivors(docs, id_col, text_col)).applied(table, "id", "hit")
    norm = normalised(F.col("text"))
    full = F.sha2(norm, 256) if digest_col else F.when(F.col("hit"), F.sha2(norm, 256))
    # the length is that of what was hashed: equal digests with unequal lengths are unequal texts
    table = table.select(
        "row", "id", F.length(F.coalesce("text", F.lit(""))).alias("points"), F.monotonically_increasing_id().alias("rid"), "hit",
        F.when(F.col("hit"), F.length(norm)).alias("len"), full.alias("full"),
    )
    table = materialise(table, "dedup-rows")
    left = table.where("hit")
    order = F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col("rid"))
    groups = left.groupBy("len", "full").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # read back, so that the join below may split a hot group; shuffled at every size, for groups grow with the data
    groups = materialise(groups.select("len", "full", "n", F.col("best.id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "dedup-groups")
    decided = left.join(groups.hint("merge"), ["len", "full"], "left").select(
        "row", "full", F.when(F.col("keep_rid").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"), F.coalesce(F.col("keep_rid") == F.col("rid"), F.lit(True)).alias("kept"),
    )
    unique = table.where("not hit").select("row", "full", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    digest = [F.col("full").alias(digest_col)] if digest_col else []
    return unique.unionByName(decided).select(*[F.col("row").getField(c).alias(c) for c in carry], "keep_id", "group_size", "kept", *digest)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its group that stays, and the digest of its normalised text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"], digest_col="text_sha256")


OP5_SQL = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
    FROM documents
), g AS (
    SELECT doc_id, sha256(norm) AS text_sha256,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
