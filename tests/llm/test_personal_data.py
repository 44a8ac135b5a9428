"""Personal data against plain regular expressions, and hand-written cases."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from spreadloom.llm.entries import op8_personal_data
from spreadloom.llm.personal_data import BASE_KINDS, find_personal_data, passes_luhn, spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = {}
    for kind, pattern in PLAIN.items():
        found[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                    "card": 16 <= len(digits) <= 19 and passes_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                found[kind].append(m.span())
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- 2(90:/é%", max_size=60))
def test_base_kinds_equal_plain_patterns(text):
    got = spans(text)
    assert {k: got[k] for k in BASE_KINDS} == plain(text)


@pytest.mark.parametrize("text, kind, value", [
    ("mail bob.t@mail8.example.com now", "email", "bob.t@mail8.example.com"),
    ("see https://a.example.org/x?y=1, then", "address", "https://a.example.org/x?y=1"),
    ("IBAN: DE89370400440532013000.", "account", "DE89370400440532013000"),
    ("Account no 12-3456-78 is", "account", "12-3456-78"),
    ("card 4111 1111 1111 1111!", "card", "4111 1111 1111 1111"),
    ("IBAN: DE89 3704 0044 0532 0130 00 is it", "account", "DE89 3704 0044 0532 0130 00"),
    ("iBan DE89 3704 0044 0532 0130 00 00 more", "account", "DE89 3704 0044 0532 0130 00"),
    ("SSN 123 45 6789", "account", "123 45 6789"),
    ("ssn: 123-45-6789.", "account", "123-45-6789"),
    ("Tax ID: 12-3456789", "account", "12-3456789"),
    ("Customer ID 123456", "account", "123456"),
    ("License No D1234567", "account", "D1234567"),
    ("é CUSTOMER id number: AB-123456, ü", "account", "AB-123456"),
    ("HTTPS://A.example.org/é", "address", "HTTPS://A.example.org/é"),
])
def test_expanded_values(text, kind, value):
    assert [text[a:z] for a, z in spans(text)[kind]] == [value]


def test_no_span_without_borders_or_check_digits():
    assert spans("IBAN DE00370400440532013000")["account"] == []
    assert spans("unaccount 12345678")["account"] == []
    assert spans("accounting 2019 and on")["account"] == []
    assert spans("http:// nothing")["address"] == []


def test_long_runs_stay_linear():
    for unit in ("1", "a", "@", "+1", "1.", "a@", "(", "account "):
        spans(unit * 200_000)


def test_nulls_repeats_and_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.cd", "x"), (1, "a@b.cd", "y"), (None, "1.2.3.4", None), (2, None, "z"), (3, "", "z")],
        "doc_id long, text string, kinds string")
    rows = sorted(((r.doc_id or 0, r.n_email, r.n_ip) for r in find_personal_data(docs).collect()))
    assert rows == [(0, 0, 1), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)]
    assert find_personal_data(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows) and any(r.n_phone for r in rows)
    for r in rows:
        want = plain(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{z}" for k in BASE_KINDS for a, z in want[k])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in BASE_KINDS]
        assert r.spans.startswith(said)
