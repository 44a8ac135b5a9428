"""Exact dedup: two passes over a Bloom filter find possible repeats, only these shuffle.

Texts are equal if they are identical once each run of ASCII white space is one space.
All of it is DataFrame functions; no Python runs on the executors.

1. The first pass reads a hash of every text. A hash sets ``BITS`` bits of one 64-bit word
   of a filter; set bits are counted with partial sums in each task, so a text that a third
   of all rows hold is a few rows per task. Bits set at least twice make up the second
   filter. It has ``BITS_PER_ROW`` bits for each row of the table, up to ``MOST_WORDS_LOG2``.
2. The second filter is a table of shards of 2^``SHARD_LOG2`` words, one for each range of
   hashes, broadcast (64 MiB at most). The second pass looks its row's word up: a row with
   all bits set is a possible repeat. All other rows are certainly alone and go straight to
   the result, in the task that read them.
3. Possible repeats are written with the SHA-256 of their text, counted exactly by it, and
   joined with groups of two and more, a table of its own, so that adaptive execution can
   split a hot group.

A filter that a very large corpus has filled sends more rows through step 3 and changes no
result: about 1 row in 200 that is alone goes there as long as the filter has 16 bits a row,
a sixth at 4 bits, all beyond that.

Defined cases: a null text counts as empty; of rows with equal texts the smallest id stays;
a row with a null id stays only if no row of its group has an id; rows that repeat an id
and a text are each counted, and stay or go together; extra columns pass through, a name
already taken gets a number; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import own_name

BITS, BITS_PER_ROW = 4, 16
SHARD_LOG2, MOST_WORDS_LOG2 = 10, 23

#: Runs of white space other than one plain space.
_RUNS = r"[\t-\r][ \t-\r]*| [ \t-\r]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def filter_log2(rows: int) -> int:
    """Words of the filter as a power of two: enough bits for ``rows``, two shards at least, never over the bound."""
    words = max(1, rows * BITS_PER_ROW // 64)
    return min(MOST_WORDS_LOG2, max(SHARD_LOG2 + 1, (words - 1).bit_length()))


def _bit_places() -> list[Column]:
    return [F.expr(f"shiftrightunsigned(hash, {6 * i}) & 63L") for i in range(BITS)]


def repeat_filter(hashes: DataFrame, log2: int) -> DataFrame:
    """(shard, bits): the bits that ``hashes`` (hash long) set twice, as arrays of 2^``SHARD_LOG2`` words."""
    word = F.shiftrightunsigned("hash", 64 - log2)
    bits = hashes.select(F.explode(F.array_distinct(F.array(*[word * 64 + b for b in _bit_places()]))).alias("bit"))
    again = bits.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blank = hashes.sparkSession.range(1 << log2).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = (again.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63L AS int))").alias("bits"))
             .unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    return (words.groupBy(F.shiftright("word", SHARD_LOG2).alias("shard"))
            .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("held"))
            .select("shard", F.col("held.bits").alias("bits")))


def _possible_repeat(log2: int) -> Column:
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(hash, {6 * i}) & 63L AS int))" for i in range(BITS)))
    at = (F.shiftrightunsigned("hash", 64 - log2) % (1 << SHARD_LOG2)).cast("int")
    return F.get("bits", at).bitwiseAND(mask) == mask


def mark_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with keep_id, group_size, kept and text_sha256.

    Possible repeats travel with the carried columns, so a caller that needs only the
    verdicts carries the id alone.
    """
    carry = docs.columns if carry is None else carry
    keep, size, kept, digest = (own_name(docs.select(*carry), n) for n in ("keep_id", "group_size", "kept", "text_sha256"))
    # Names of one module's own, so that no column of the caller is hidden by them.
    keyed = docs.select(F.struct(*carry).alias("row"), F.col(id_column).alias("id"),
                        F.sha2(normalised(F.col(text_column)), 256).alias("digest")).withColumn("hash", F.xxhash64("digest"))
    log2 = filter_log2(docs.count())
    shards = stage(repeat_filter(keyed.select("hash"), log2), "exact-filter")
    looked_up = keyed.join(F.broadcast(shards), F.shiftrightunsigned("hash", 64 - log2 + SHARD_LOG2) == F.col("shard"))
    repeat = _possible_repeat(log2)
    suspects = stage(looked_up.filter(repeat).select("row", "id", F.unhex("digest").alias("digest")), "exact-suspects")
    groups = stage(suspects.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first")).filter("size > 1"), "exact-groups")
    alone = looked_up.filter(~repeat).select(
        "row.*", F.col("id").alias(keep), F.lit(1).cast("bigint").alias(size), F.lit(True).alias(kept), F.col("digest").alias(digest))
    first = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("first"))
    confirmed = suspects.join(groups, "digest", "left").select(
        "row.*", first.alias(keep), F.coalesce("size", F.lit(1)).alias(size),
        F.col("id").eqNullSafe(first).alias(kept), F.lower(F.hex("digest")).alias(digest))
    return alone.unionByName(confirmed)


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    marked = mark_copies(docs, id_column, text_column)
    return marked.filter(F.col(marked.columns[len(docs.columns) + 2])).select(*docs.columns)
