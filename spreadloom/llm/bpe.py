"""Byte-level BPE over a whole table: each distinct word of the corpus is encoded once.

1. The rows that one task reads are cut in chunks of some megabytes. In a chunk every
   pre-token becomes the number of its word, and the list of numbers is the positions.
   The distinct words leave the chunk in packs, one for each word bucket.
2. Packs are shuffled by bucket. A word belongs to one bucket and a bucket to one task, so
   each distinct word of the corpus is encoded once there; the ids go back to the chunk as packs of
   the same order.
3. Ids and positions of a chunk meet by one shuffle on the chunk, and each document's ids
   are put together by position.

A word is sent once for each chunk that holds it, not once for each place: the commonest
word of the corpus is a row entry per chunk. Memory of a task is a chunk, or the words of
a bucket; the number of buckets is the session's number of shuffle partitions.

The chunk's name is a hash of its content, and steps 1 and 3 read ``docs`` each: the table
must give the same rows in the same order when it is read again, as files do. If it does
not, a chunk misses packs and the job fails; it can't return wrong ids.

Defined cases: a null or empty text has no ids; a null id stays null; equal rows and equal
ids are rows of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import batch, columns, partitions
from .pretokens import splitter

CHUNK_BYTES = 16 << 20
#: Ids in a batch of results.
BLOCK_IDS = 1 << 20

PACKS = columns("chunk bigint, bucket int, payload binary")
PARTS = columns("chunk bigint, part int, doc_ids bigint[], sizes bigint[], payload binary")
IDS = columns("doc_id bigint, ids int[]")
BYTES = columns("doc_id bigint, bytes binary")


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The token table of a rank file: id to bytes."""
    with open(path, "rb") as f:
        return {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    ranks = {token: rank for rank, token in token_bytes(path).items()}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2**32, by byte planes, compressed."""
    planes = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        planes += [len(a).to_bytes(8, "little"), a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        n = int.from_bytes(raw[at:at + 8], "little")
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
        at += 8 + 4 * n
    return out


def pack_words(words: list[bytes]) -> bytes:
    text = b"".join(words)
    return zstandard.ZstdCompressor(level=3).compress(
        len(words).to_bytes(8, "little") + np.fromiter(map(len, words), "<u4", len(words)).tobytes() + text)


def unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64) + 8 + 4 * n).tolist()
    return [raw[a:z] for a, z in zip([8 + 4 * n, *ends[:-1]], ends)]


class _Chunk:
    """Documents read one after the other: the distinct words, and with ``places`` also where each stands."""

    def __init__(self, split, n_buckets: int, places: bool):
        self.split, self.n_buckets = split, n_buckets
        self.number: dict[str, int] = defaultdict()  # in the order of first appearance
        self.number.default_factory = self.number.__len__
        self.doc_ids, self.places, self.size, self.content = [], [] if places else None, 0, xxhash.xxh3_64(seed=7)

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = self.split(text) if text else []
        self.doc_ids.append(doc_id)
        if self.places is None:
            self.number.update(dict.fromkeys(words, 0))
        else:
            self.places.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        raw = (text or "").encode()
        self.size += len(raw) + 64
        self.content.update(f"{doc_id} {len(raw)} ".encode())
        self.content.update(raw)

    def name(self) -> int:
        return self.content.intdigest() - (1 << 63)

    def dealt(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words as UTF-8, their buckets, and their order in the packs: by bucket, then by appearance."""
        coded = [w.encode() for w in self.number]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(coded))
        bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        return coded, bucket, np.argsort(bucket, kind="stable")

    def packs(self):
        coded, bucket, order = self.dealt()
        found, begins = np.unique(bucket[order], return_index=True)
        for own, a, z in zip(found.tolist(), begins.tolist(), [*begins[1:].tolist(), len(order)]):
            yield self.name(), own, pack_words(sorted(coded[i] for i in order[a:z].tolist()))

    def positions(self) -> tuple[int, int, list, list[int], bytes]:
        """Positions by frequency rank, which compress well, and the place of each rank among the packed words."""
        places = np.concatenate(self.places) if self.places else np.empty(0, np.int32)
        by_rank = np.argsort(-np.bincount(places, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(by_rank), np.int64)
        rank[by_rank] = np.arange(len(by_rank))
        coded, bucket, order = self.dealt()
        begins = np.unique(bucket[order], return_index=True)[1].tolist()
        for a, z in zip(begins, [*begins[1:], len(order)]):
            order[a:z] = sorted(order[a:z].tolist(), key=coded.__getitem__)  # as the packs are sorted
        place = np.empty(len(by_rank), np.int64)
        place[order] = np.arange(len(by_rank))
        return self.name(), -1, self.doc_ids, [len(p) for p in self.places], pack(rank[places], place[by_rank])


def _chunks(batches, pattern: str, n_buckets: int, chunk_bytes: int, places: bool):
    split = splitter(pattern)
    chunk = _Chunk(split, n_buckets, places)
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            chunk.add(doc_id, text)
            if chunk.size >= chunk_bytes:
                yield chunk
                chunk = _Chunk(split, n_buckets, places)
    if chunk.doc_ids:
        yield chunk


def _encode_packs(batches, path: str, pattern: str):
    """Packs sorted by bucket: words met before in the bucket are not encoded again."""
    code, bucket, known = encoding(path, pattern), None, {}
    for b in batches:
        for chunk, own, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
            if own != bucket:
                bucket, known = own, {}
            lengths, flat = [], []
            for word in unpack_words(payload):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = tuple(code.encode_ordinary(word.decode()))
                lengths.append(len(ids))
                flat += ids
            yield batch(PARTS, [[chunk], [own], [[]], [[]], [pack(np.array(lengths, np.int64), np.array(flat, np.int64))]])


def _put_together(doc_ids: list, sizes: list[int], payload: bytes, parts: list[tuple[np.ndarray, np.ndarray]]):
    places, of_rank = unpack(payload)
    lengths = np.concatenate([p[0] for p in parts] or [np.empty(0, np.int64)])
    flat = np.concatenate([p[1] for p in parts] or [np.empty(0, np.int64)]).astype(np.int32)
    if len(lengths) != len(of_rank):
        raise RuntimeError("a chunk misses words: the table gave other rows when it was read again")
    begins = np.cumsum(lengths) - lengths
    lengths, begins = lengths[of_rank], begins[of_rank]
    n_ids = lengths[places]
    ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    total = np.concatenate(([0], np.cumsum(n_ids)))
    i = 0
    while i < len(doc_ids):
        j = max(i + 1, int(np.searchsorted(total[ends], total[ends[i]] + BLOCK_IDS, "right")) - 1)
        own = places[ends[i]:ends[j]]
        n = n_ids[ends[i]:ends[j]]
        before = np.cumsum(n) - n
        values = flat[np.repeat(begins[own] - before, n) + np.arange(int(n.sum()))]
        offsets = (total[ends[i:j + 1]] - total[ends[i]]).astype(np.int32)
        yield batch(IDS, [doc_ids[i:j], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))])
        i = j


def _assemble(batches):
    """Rows sorted by (chunk, part): positions first, then the packs in the order of their buckets."""
    chunk, placed, parts = None, [], {}

    def flush():
        for doc_ids, sizes, payload in placed:
            yield from _put_together(doc_ids, sizes, payload, list(parts.values()))

    for b in batches:
        for own, part, doc_ids, sizes, payload in zip(*(b.column(i).to_pylist() for i in range(5))):
            if own != chunk:
                yield from flush()
                chunk, placed, parts = own, [], {}
            if part < 0:
                placed.append((doc_ids, sizes, payload))
            else:
                parts[part] = tuple(unpack(payload))  # equal chunks send equal packs
    yield from flush()


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``, by the rank file at ``path``; no special tokens."""
    n = partitions(docs)
    given = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))

    def words(batches):
        for chunk in _chunks(batches, pattern, n, chunk_bytes, False):
            for row in chunk.packs():
                yield batch(PACKS, [[x] for x in row])

    def positions(batches):
        for chunk in _chunks(batches, pattern, n, chunk_bytes, True):
            yield batch(PARTS, [[x] for x in chunk.positions()])

    coded = (given.mapInArrow(words, PACKS).repartition(n, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(lambda batches: _encode_packs(batches, path, pattern), PARTS))
    return (given.mapInArrow(positions, PARTS).unionByName(coded)
            .repartition(n, "chunk").sortWithinPartitions("chunk", "part").mapInArrow(_assemble, IDS))


def _rows_of_ids(b: pa.RecordBatch):
    """The ids of each row as a list of Python numbers, or None; the values of a batch are unpacked at once."""
    lists = b.column(1)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, offsets = lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_pylist()
    for known, a, z in zip(lists.is_valid().to_pylist(), offsets, offsets[1:]):
        yield values[a:z] if known else None


def _table(path: str) -> list[bytes]:
    """The token table as a list by id; ids without a token are gaps."""
    tokens = token_bytes(path)
    return [tokens.get(i) for i in range(max(tokens) + 1)]


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes): the ids of each row joined with the token table, which is as large as the vocabulary."""

    def run(batches):
        table = _table(path)
        for b in batches:
            yield batch(BYTES, [b.column(0), [None if ids is None else b"".join(map(table.__getitem__, ids))
                                              for ids in _rows_of_ids(b)]])

    return coded.select("doc_id", "ids").mapInArrow(run, BYTES)


def round_trip_digests(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows, each decoded from its ids."""
    schema = columns("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        table = _table(path)
        said = [str(i) for i in range(len(table))]
        for b in batches:
            n, names, texts = [], [], []
            for ids in _rows_of_ids(b):
                n.append(len(ids))
                names.append(hashlib.sha256(" ".join(map(said.__getitem__, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(b"".join(map(table.__getitem__, ids))).hexdigest())
            yield batch(schema, [b.column(0), n, names, texts])

    return coded.select("doc_id", "ids").mapInArrow(run, schema)
