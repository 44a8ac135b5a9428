"""Personal data found by anchors: one Aho-Corasick pass, then local parsers.

The automaton looks for at-signs, plus signs, digits, scheme marks and identifier cues in
one linear pass over the whole text. Each hit starts a small deterministic parser at that
place, which widens it to the value's borders and validates it. No parser looks at a
character twice for one kind, so a text without personal data costs one pass and a text
of one repeated character stays linear.

Kinds, in the order of the result. The first four are the base:

- ``email``, ``ip`` (four parts of at most 255), ``card`` (16 to 19 digits, Luhn),
  ``phone`` (plus sign, 8 to 15 digits): leftmost, not overlapping, a failing match is
  dropped and not tried again;
- ``address``: scheme, ``://`` and the characters up to white space, a quote, a bracket or
  final punctuation, with at least one character of a host name;
- ``account``: an identifier of 6 to 34 letters and digits (hyphens inside allowed) with
  at least four digits, after a cue such as "iban", "account" or "ssn", in any case. An IBAN
  must pass its check digits, and may stand in groups with single spaces between: the
  longest run of groups that passes is taken. A social security number may have a space or a hyphen
  between its three groups.

Schemes and cues are searched in a copy of the text with A-Z lower-cased.

Defined cases: a null or empty text has no spans; a null id stays null; equal rows are
treated alike, each on its own; other columns are not read and not returned by
``find_personal_data``. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from .common import ASCII_LOWER, batch, columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("address", "account")

#: What may announce an identifier.
CUES = ("iban", "account", "acct", "ssn", "passport", "customer id", "tax id", "licence no", "license no")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "postgres://", "mysql://")

SCHEMA = columns("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                 "kinds string[], starts int[], ends int[]")
DIGESTS = columns("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
                  "base_sha256 string, spans string")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[^\s\"'<>()\[\]{}|\\^`]+")
_AFTER_CUE = re.compile(r"(?:\s+(?:no|nr|number|id)(?![A-Za-z0-9]))?\.?[\s:=#]{0,4}", re.I)
_ACCOUNT = re.compile(r"[A-Za-z0-9](?:-?[A-Za-z0-9]){5,33}(?![A-Za-z0-9])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]")


@functools.lru_cache(maxsize=1)
def _automaton():
    found = ahocorasick.Automaton()
    for sign, what in (("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789")):
        found.add_word(sign, (what, 1))
    for words, what in ((SCHEMES, "scheme"), (CUES, "cue")):
        for word in words:
            found.add_word(word, (what, len(word)))
    found.make_automaton()
    return found


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def passes_iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _identifier(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier that begins at ``at``, as the cue asks for it."""
    if cue == "iban":
        m = _IBAN.match(text, at)
        end = m.end() if m else at
        while end > at:
            # A group ends where no letter or digit follows.
            if not text[end:end + 1].isalnum() and 15 <= len(value := text[at:end].replace(" ", "")) <= 34 and passes_iban(value):
                return at, end
            end = text.rfind(" ", at, end)
        return None
    m = cue == "ssn" and _SSN.match(text, at) or _ACCOUNT.match(text, at)
    return m.span() if m and sum(c.isdigit() for c in m.group()) >= 4 else None


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Start and end of every value, by kind, each list in the order of the text."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not text:
        return found
    email_from = ip_from = card_from = phone_from = address_from = account_from = 0
    low = text.lower() if text.isascii() else text.translate(ASCII_LOWER)
    for last, (what, width) in _automaton().iter(low):
        at = last - width + 1
        if what == "digit":
            if at >= ip_from:
                m = _IP.match(text, at)
                if m is None:
                    ip_from = _DIGITS.match(text, at).end()
                else:
                    ip_from = m.end()
                    if all(map(_part_fits, m.group().split("."))):
                        found["ip"].append(m.span())
            if at >= card_from:
                m = _CARD.match(text, at)
                card_from = at + 1 if m is None else m.end()
                if m is not None:
                    digits = _NOT_DIGIT.sub("", m.group())
                    if 16 <= len(digits) <= 19 and passes_luhn(digits):
                        found["card"].append(m.span())
        elif what == "at":
            start = at
            while start > email_from and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m is not None:
                found["email"].append((start, m.end()))
                email_from = m.end()
            else:
                email_from = max(email_from, at + 1)
        elif what == "plus":
            m = _PHONE.match(text, at) if at >= phone_from else None
            if m is not None:
                phone_from = m.end()
                if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            if at >= address_from and (at == 0 or not text[at - 1].isalnum()):
                m = _HOST.match(text, last + 1)
                body = m.group().rstrip(".,;:!?") if m else ""
                if body and any(c.isalnum() for c in body):
                    address_from = last + 1 + len(body)
                    found["address"].append((at, address_from))
        elif at >= account_from and (at == 0 or not text[at - 1].isalnum()):
            begin = _AFTER_CUE.match(text, last + 1).end()
            span = _identifier(text, begin, low[at:last + 1]) if begin > last + 1 else None
            if span is not None:
                found["account"].append(span)
                account_from = span[1]
    return found


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds and all spans. No shuffle."""

    def run(batches):
        for b in batches:
            each = [spans(t) for t in b.column(1).to_pylist()]
            yield batch(SCHEMA, [
                b.column(0).cast("int64"), *[[len(s[k]) for s in each] for k in BASE_KINDS],
                [[k for k in KINDS for _ in s[k]] for s in each],
                *[[[span[i] for k in KINDS for span in s[k]] for s in each] for i in (0, 1)]])

    return docs.select(id_column, text_column).mapInArrow(run, SCHEMA)


def personal_data_digests(found: DataFrame) -> DataFrame:
    """The spans of ``find_personal_data`` as strings, the base ones as a digest."""
    def run(batches):
        for b in batches:
            base, every = [], []
            for row in zip(*(b.column(i).to_pylist() for i in (5, 6, 7))):
                said = [(kind, f"{kind}:{a}:{z}") for kind, a, z in zip(*row)]
                base.append(hashlib.sha256(",".join(x for k, x in said if k in BASE_KINDS).encode()).hexdigest())
                every.append(",".join(x for _, x in said))
            yield batch(DIGESTS, [b.column(i) for i in range(5)] + [base, every])

    return found.mapInArrow(run, DIGESTS)
