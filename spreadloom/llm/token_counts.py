"""Token counts of whole texts; huge texts are cut in overlapping chunks and spliced.

A text of up to ``chunk_chars`` code points is counted where it is read. A longer one is
cut in chunks of that length which overlap by ``overlap``; the chunks are dealt over the
cluster, each is encoded on its own, and two neighbours are spliced at an offset where
both agree.

Why a splice is right: pre-tokens are matched from left to right, and a match depends only
on where it starts and on the text up to one code point behind its end. So if an offset is
a pre-token border in both chunks, everything behind it is the same in the right chunk as
in the whole text, and everything before it the same in the left chunk, as long as
neither view was disturbed by its own edge. The offset therefore keeps ``margin`` code points
from the end of the left chunk and from the start of the right one, with a margin longer than any
special string: a special string across the offset would be whole in both chunks, and
the offset inside it no border. Where two chunks share no such offset (one pre-token over
the whole overlap) the document is cut again with chunks and overlaps of twice the
length, until it is aligned or one chunk holds it.

Encoders: ``.json`` (tokenizers), ``.tiktoken`` (tiktoken), ``.model`` (sentencepiece;
no proof of a stable border is known for it, so its texts are encoded whole).

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null id stays null; equal rows and
equal ids are counted row by row; other columns are not read.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage
from .common import batch, columns, partitions
from .pretokens import LATIN_END, splitter

CHUNK_CHARS = 32_768
OVERLAP = 512
#: Distinct pre-tokens whose counts a worker keeps; beyond it the memory is emptied.
KEPT_WORDS = 600_000

SCHEMA = columns("doc_id bigint, n_bytes bigint, n_tokens bigint")


class Counter:
    """Token counts by one vocabulary file, and the pre-token borders of a chunk."""

    def __init__(self, path: str, pattern: str):
        self.split, self.known, self.special = splitter(pattern), {}, ()
        self.bordered = True
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
            with open(path, encoding="utf-8") as f:
                form = json.load(f)
            before = form.get("pre_tokenizer") or {}
            self.bordered = (before.get("type") == "ByteLevel" and before.get("use_regex", True)
                             and not before.get("add_prefix_space", True) and not form.get("normalizer")
                             and not form.get("truncation") and not form.get("padding"))
            self.whole = lambda text: len(self.library.encode(text, add_special_tokens=False))
            self.words = lambda words: [
                len(x) for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.whole = lambda text: len(self.library.encode_ordinary(text))
            self.words = lambda words: [len(self.library.encode_ordinary(w)) for w in words]
        else:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda text: len(self.library.encode(text))
            self.bordered = False

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                known.clear()
                new = list(dict.fromkeys(words))
            known.update(zip(new, self.words(new)))
        return [known[w] for w in words]

    def simple(self, text: str) -> bool:
        """Whether the text's pre-tokens can be counted one by one."""
        return (self.bordered and (text.isascii() or max(text) < LATIN_END)
                and not any(s in text for s in self.special))

    def count(self, texts: list[str]) -> list[int]:
        out, parts, at = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.simple(text):
                at.append((i, len(parts)))
                parts += self.split(text)
            else:
                out[i] = self.whole(text)
        counts = np.fromiter(self.counts(parts), np.int64, len(parts))
        sums = np.concatenate(([0], np.cumsum(counts)))
        ends = [a for _, a in at[1:]] + [len(parts)]
        for (i, a), z in zip(at, ends):
            out[i] = int(sums[z] - sums[a])
        return out

    def borders(self, text: str) -> tuple[list[int], list[int]]:
        """Offsets at which pre-tokens begin, the text's end last, and the tokens before each."""
        if self.simple(text):
            words = self.split(text)
            lengths, counts = list(map(len, words)), self.counts(words)
        elif hasattr(self.library, "get_added_tokens_decoder"):
            code = self.library.encode(text, add_special_tokens=False)
            starts, before, last = [], [], object()
            for k, (word, (a, _)) in enumerate(zip(code.word_ids, code.offsets)):
                # A special string has no word number: it starts a border of its own.
                if word is None or word != last:
                    starts.append(a)
                    before.append(k)
                last = word
            return starts + [len(text)], before + [len(code)]
        else:
            words = self.split(text)
            lengths, counts = list(map(len, words)), self.counts(words)
        return ([0, *np.cumsum(lengths).tolist()], [0, *np.cumsum(counts).tolist()])


@functools.lru_cache(maxsize=4)
def _counter(path: str, pattern: str) -> Counter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel unit
    return Counter(path, pattern)


def splice(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], low: int, high: int):
    """(tokens before the common border in the left chunk, and in the right one), or None.

    Offsets are those of the document; the border lies in ``low``..``high``.
    """
    of_right = dict(zip(*right))
    for offset, count in zip(*left):
        if low <= offset <= high and offset in of_right:
            return count, of_right[offset]
    return None


def count_tokens(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id",
                 text_column: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs``: its id, UTF-8 bytes and tokens by the vocabulary at ``path``."""
    given = docs.select(F.col(id_column).cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    if path.endswith(".model"):
        return given.mapInArrow(_count_whole(path, pattern), SCHEMA)
    short = given.filter(F.char_length("text") <= chunk_chars).mapInArrow(_count_whole(path, pattern), SCHEMA)
    # The row's place tells rows with equal or null ids apart.
    rest = given.filter(F.char_length("text") > chunk_chars)
    long = stage(rest.withColumn("place", F.monotonically_increasing_id()), "long-texts")
    counted = [short]
    while True:
        done = stage(_count_chunked(long, path, pattern, chunk_chars, overlap), "long-counts")
        counted.append(done.filter("aligned").select("doc_id", "n_bytes", "n_tokens"))
        failed = done.filter("NOT aligned").select("place")
        if failed.isEmpty():
            break
        long = stage(long.join(failed, "place", "left_semi"), "long-texts")
        chunk_chars, overlap = 2 * chunk_chars, 2 * overlap
    return functools.reduce(DataFrame.unionByName, counted)


def _count_whole(path: str, pattern: str):
    def run(batches):
        counter = _counter(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(SCHEMA, [b.column(0), [len(t.encode()) for t in texts], counter.count(texts)])

    return run


_CHUNKS = columns("doc_id bigint, place bigint, part int, start bigint, n_bytes bigint, final boolean, piece string")
_CODED = columns("doc_id bigint, place bigint, part int, start bigint, stop bigint, n_bytes bigint, n_tokens bigint, "
                 "head bigint[], head_counts bigint[], tail bigint[], tail_counts bigint[]")


def _count_chunked(long: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    def cut(batches):
        for b in batches:
            for doc_id, text, place in zip(*(b.column(i).to_pylist() for i in range(3))):
                starts = range(0, max(1, len(text) - overlap), chunk)
                rows = []
                for part, a in enumerate(starts):
                    z = len(text) if part == len(starts) - 1 else a + chunk + overlap
                    own = text[a:len(text) if part == len(starts) - 1 else a + chunk]
                    rows.append((doc_id, place, part, a, len(own.encode()), part == len(starts) - 1, text[a:z]))
                    if len(rows) == 16:
                        yield batch(_CHUNKS, list(zip(*rows)))
                        rows = []
                if rows:
                    yield batch(_CHUNKS, list(zip(*rows)))

    def code(batches):
        counter = _counter(path, pattern)
        for b in batches:
            rows = []
            for doc_id, place, part, start, n_bytes, final, piece in zip(*(c.to_pylist() for c in b.columns)):
                offsets, counts = counter.borders(piece)
                offsets = [start + o for o in offsets]
                stop = start + len(piece)
                head = [i for i, o in enumerate(offsets) if o <= start + overlap] if part else []
                tail = [] if final else [i for i, o in enumerate(offsets) if o >= stop - overlap]
                rows.append((doc_id, place, part, start, stop, n_bytes, counts[-1],
                             [offsets[i] for i in head], [counts[i] for i in head],
                             [offsets[i] for i in tail], [counts[i] for i in tail]))
            yield batch(_CODED, list(zip(*rows)))

    margin = max([len(s) for s in _counter(path, pattern).special] + [2]) + 1
    joined = columns("doc_id bigint, place bigint, n_bytes bigint, n_tokens bigint, aligned boolean")

    def join(batches):
        for b in batches:
            rows = []
            for d, p, stop, n_bytes, n, tail, tail_n, nxt, nxt_head, nxt_n in zip(*(c.to_pylist() for c in b.columns)):
                if nxt is None:
                    rows.append((d, p, n_bytes, n, True))
                    continue
                at = splice((tail, tail_n), (nxt_head, nxt_n), nxt + margin, stop - margin)
                rows.append((d, p, n_bytes, at[0] - at[1] if at else 0, at is not None))
            yield batch(joined, list(zip(*rows)))

    coded = (long.select("doc_id", "text", "place").mapInArrow(cut, _CHUNKS)
             .repartition(partitions(long), "place", "part").mapInArrow(code, _CODED))
    order = Window.partitionBy("place").orderBy("part")
    pairs = coded.select(
        "doc_id", "place", "stop", "n_bytes", "n_tokens", "tail", "tail_counts",
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("start", "head", "head_counts")])
    return pairs.mapInArrow(join, joined).groupBy("place").agg(
        F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"),
        F.sum("n_tokens").alias("n_tokens"), F.min("aligned").alias("aligned"))
