"""Fill-in-middle transformation: texts are cut in units and the middle moves to the end.

A unit is a line with its line end, or what stands behind the last line end. The cuts are
found without splitting a text: the UTF-8 bytes of a whole batch are viewed as 64-bit
words; arithmetic on a word marks the bytes that end a unit, ``bitwise_count`` gives the
marks of each word, a search in their running sum gives the word that holds the k-th mark,
and clearing lower marks gives its byte. Code points are counted from marks of bytes that
begin one.

The cuts and the form depend on the document's id and a seed alone, so they are the same
whatever the partitioning. The form is plain (text unchanged) if the text is empty or holds
a marker, or by the share ``rate``; else spm (suffix first) by ``spm_share``, or psm. No
marker can arise where two parts meet, since a marker has its first character nowhere else
in it; so the output alone gives back the text.

Nothing shuffles. Defined cases: a null text counts as empty; a row with a null id is cut
as one with an empty id; rows that repeat an id are cut by the same numbers, each in its own text; a text without
line end is one unit; extra columns pass through, a name already taken gets a number; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import extend_rows, own_name

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 7, 100, 50

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_ONE = np.uint64(1)


def as_words(data: bytes) -> np.ndarray:
    """The bytes as 64-bit words, with zeros behind them up to a whole word, and one word more."""
    padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return padded.view("<u8")


def marks_of(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``; no carry leaves a byte, so no mark is false."""
    other = words ^ (np.uint64(byte) * _ONES)
    return ~(((other & _LOW) + _LOW) | other | _LOW)


def code_point_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point (all but those of the form 10xxxxxx)."""
    return ~(words & ~(words << _ONE)) & _HIGH


class Marks:
    """Marked bytes: how many stand before a byte, and at which byte the k-th stands."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), dtype=np.int64, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 3
        below = (_ONE << ((at & 7) * 8).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the k-th mark, counted from 0; every k must have one."""
        word = np.searchsorted(self.before, k, "right") - 1
        ahead = k - self.before[word]
        held = self.marks[word]
        for step in range(7):
            held = np.where(ahead > step, held & (held - _ONE), held)
        below = (held & (~held + _ONE)) - _ONE  # the bits under the lowest mark, which is bit 7 of its byte
        return word * 8 + (np.bitwise_count(below).astype(np.int64) >> 3)


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers that a document's id and the seed fix."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    code = hashlib.sha256(name.encode()).hexdigest()
    return [int(code[i:i + 8], 16) for i in range(0, 32, 8)]


def cut_places(data: bytes, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other in ``data`` up to ``ends``: units, the two
    cuts as places in ``data``, and the code points of prefix and middle. ``numbers``: four draws each."""
    words = as_words(data)
    lines = Marks(marks_of(words, 0x0A))
    begins = np.concatenate(([0], ends[:-1]))
    before, through = lines.rank(begins), lines.rank(ends)
    closed = np.zeros(len(ends), bool)
    filled = ends > begins
    closed[filled] = np.frombuffer(data, np.uint8)[ends[filled] - 1] == 0x0A
    n = through - before + (filled & ~closed)
    units = np.sort(numbers[:, :2] % (n + 1)[:, None], axis=1)
    cuts = np.empty_like(units)
    for i in (0, 1):
        k = units[:, i]
        inside = (k > 0) & (k <= through - before)
        cuts[:, i] = np.where(k == 0, begins, ends)
        cuts[inside, i] = lines.select(before[inside] + k[inside] - 1) + 1
    points = Marks(code_point_marks(words))
    at = [points.rank(x) for x in (begins, cuts[:, 0], cuts[:, 1])]
    return n, cuts[:, 0], cuts[:, 1], at[1] - at[0], at[2] - at[1]


def fill_middle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED,
                rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """All columns of ``docs`` with fim_text, fim_form, n_units, prefix_chars and middle_chars."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def transform(values):
        ids, texts = values
        parts = [(t or "").encode() for t in texts]
        if not parts:
            return None, [[], [], [], [], []]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        numbers = np.array([draws(i, seed) for i in ids], np.int64)
        n, first, second, prefix, middle = cut_places(b"".join(parts), ends, numbers)
        begins = ends - np.fromiter(map(len, parts), np.int64, len(parts))
        out, forms = [], []
        for i, text in enumerate(parts):
            a, z = int(first[i] - begins[i]), int(second[i] - begins[i])
            if not text or numbers[i, 2] % 100 >= rate or any(mark in text for mark in marks):
                forms.append("plain")
                out.append(text)
            elif numbers[i, 3] % 100 < spm_share:
                forms.append("spm")
                out.append(b"".join((s, text[z:], p, text[:a], m, text[a:z])))
            else:
                forms.append("psm")
                out.append(b"".join((p, text[:a], s, text[z:], m, text[a:z])))
        moved = [f != "plain" for f in forms]
        return None, [[x.decode() for x in out], forms, n.tolist(),
                      *[[v if k else None for v, k in zip(x.tolist(), moved)] for x in (prefix, middle)]]

    names = [own_name(docs, x) for x in ("fim_text", "fim_form", "n_units", "prefix_chars", "middle_chars")]
    types = ("string", "string", "bigint", "bigint", "bigint")
    return extend_rows(docs, ", ".join(map(" ".join, zip(names, types))), [id_column, text_column], transform)


def restored(output: str, form: str) -> str:
    """The text that ``output`` was made from."""
    if form == "plain":
        return output
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    second, third = output.index(marks[1]), output.index(marks[2])
    one, two = output[len(marks[0]):second], output[second + len(marks[1]):third]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + output[third + len(marks[2]):] + suffix


def restore(docs: DataFrame, output_column: str = "fim_text", form_column: str = "fim_form") -> DataFrame:
    """All columns of ``docs`` with restored_text, read from output and form alone; null where either is."""
    return extend_rows(docs, f"{own_name(docs, 'restored_text')} string", [output_column, form_column], lambda values: (
        None, [[None if o is None or f is None else restored(o, f) for o, f in zip(*values)]]))
