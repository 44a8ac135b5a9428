"""Line dedup: two Bloom filters find suspects, only these shuffle.

1. One pass puts every document's long lines in a pair of fixed-size Bloom filters, for
   what was seen in one document and what was seen in another again.
2. A second pass emits a row only for lines the second filter suspects: a 16-byte digest
   of the key and the document's id.
3. Digests are counted exactly and the largest id is found, with partial sums before the
   shuffle: a line that a third of all documents hold is a row for each task there.
4. Documents get the digests they lose; the text is cut by them.

A key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``min_chars`` code points held by at least ``min_docs`` documents stay in the document of
the largest id only, with all lines it has of that key.

Defined cases: a null or empty text is one empty line and stays as it is; rows that
repeat an id count once for a key and are cut alike; a row with a null id counts for no
key and loses nothing; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..staging import stage
from .bloom import WORDS_LOG2, second_filter, sketch_cells, suspected
from .common import batch, columns, extend_rows, own_name

MIN_CHARS, MIN_DOCS = 40, 5
SPACE = " \t\n\x0b\x0c\r"

HOLDERS = columns("digest binary, doc_id bigint")


def long_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line as UTF-8, or None if it is too short. bytes.lower touches A-Z only."""
    if len(line) < min_chars or len(line := line.strip(SPACE)) < min_chars:
        return None
    return line.encode().lower()


def long_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes]:
    """The distinct long keys of a text."""
    if not text or len(text) < min_chars:
        return []
    keys = {long_key(line, min_chars) for line in text.split("\n")}
    keys.discard(None)
    return list(keys)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                   words_log2: int = WORDS_LOG2) -> DataFrame:
    """(doc_id, digests): the keys each document loses. ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL")
    again = spark.sparkContext.broadcast(second_filter(sketch_cells(
        docs.select("text"),
        lambda b: [_hashes(long_keys(t, min_chars)) for t in b.column(0).to_pylist()], words_log2), words_log2))

    def suspects(batches):
        for b in batches:
            digests, ids = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = long_keys(text, min_chars)
                for i in np.flatnonzero(suspected(again.value, _hashes(keys))).tolist():
                    digests.append(digest(keys[i]))
                    ids.append(doc_id)
            yield batch(HOLDERS, [digests, ids])

    holders = stage(docs.select("doc_id", "text").mapInArrow(suspects, HOLDERS).distinct(), "line-holders")
    # A table of its own: a join whose sides are both dealt for it can be split where a digest is hot.
    common = stage(holders.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                   .filter(F.col("n") >= min_docs).drop("n"), "common-lines")
    return (holders.join(common, "digest").filter("doc_id != keeper")
            .groupBy("doc_id").agg(F.collect_list("digest").alias("digests")))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` and kept_text, n_lines, n_dropped (a name already taken gets a number)."""
    drops = repeated_lines(docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")),
                           min_chars, min_docs)
    key, lost = own_name(docs, "drop_id"), own_name(docs, "drop_digests")
    drops = drops.select(F.col("doc_id").alias(key), F.col("digests").alias(lost))
    joined = docs.join(drops, docs[id_column].cast("bigint") == drops[key], "left").drop(key)

    def cut(values):
        kept, counts, dropped = [], [], []
        for text, digests in zip(*values):
            lines = (text or "").split("\n")
            counts.append(len(lines))
            if digests:
                gone = set(digests)
                lines = [x for x in lines if (key := long_key(x, min_chars)) is None or digest(key) not in gone]
            kept.append("\n".join(lines) if digests else text or "")
            dropped.append(counts[-1] - len(lines))
        return None, [kept, counts, dropped]

    names = [own_name(docs, n) for n in ("kept_text", "n_lines", "n_dropped")]
    types = ("string", "bigint", "bigint")
    return extend_rows(joined, ", ".join(map(" ".join, zip(names, types))), [text_column, lost], cut).drop(lost)
