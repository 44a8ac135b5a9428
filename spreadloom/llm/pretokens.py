"""The split of a text into pre-tokens, as byte-level vocabularies define it.

``split`` gives what the pattern of the public rank files gives. Texts of code points
below U+0250 (Latin letters) take a pattern of the standard library with the same classes
written out, several times as fast; all others take the pattern itself.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import regex

LATIN_END = "ɐ"


@functools.lru_cache(maxsize=4)
def _patterns(pattern: str):
    def ranges(kind: str) -> str:
        points = [c for c in range(ord(LATIN_END)) if unicodedata.category(chr(c))[0] == kind]
        return "".join(f"\\u{c:04x}" for c in points)

    whole = regex.compile(pattern)
    letters, numbers, space = ranges("L"), ranges("N"), r"\t-\r \x85\xa0"
    quick = (pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]")
             .replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s+", f"[{space}]+")
             .replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
    return whole, None if re.search(r"\\[psS]", quick) else re.compile(quick)


def splitter(pattern: str):
    """A function from a text to its pre-tokens, in order; joined they are the text."""
    whole, quick = _patterns(pattern)

    def split(text: str) -> list[str]:
        if quick is not None and (text.isascii() or max(text) < LATIN_END):
            return quick.findall(text)
        return whole.findall(text)

    return split
