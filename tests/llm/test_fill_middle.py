"""Fill-in-middle against brute force, and the word arithmetic against plain loops."""

import hashlib
import random
import re

import numpy as np

from spreadloom.llm.entries import op11_fill_middle
from spreadloom.llm.fill_middle import Marks, as_words, code_point_marks, fill_middle, marks_of, restore


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * i:8 * i + 8], 16) for i in range(4)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


CASES = [
    (1, "one\ntwo\nthree"), (2, "one\ntwo\n"), (3, "\n"), (4, "\n\n\n\n\n\n\n\n\n\n"), (5, "no end"), (6, ""), (7, None),
    (8, "é\n漢字\n😀😀\nx\n"), (9, "a <P> b\nc"), (10, "a\n<S"), (11, "<M\nP>\n<"), (12, "\r\n\x0b\x85 \nx"),
    (13, "\x00\n\x8a\n\x0b\n"), (14, "line\n" * 40_000 + "end"), (15, "漢" * 100_001 + "\n"), (None, "a\nb\nc"), (None, None),
    (20, "p\nq\nr\n"), (20, "p\nq\nr\n"), (20, "another\ntext"), (-5, "x\ny")] + [
    (100 + i, "\n".join("word é"[: i % 7] * (j % 3) for j in range(i))) for i in range(60)]


def test_defined_cases(spark):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in CASES], "doc_id long, text string, n_units int, fim_form string")
    got = restore(fill_middle(df.repartition(3)), "fim_text", "fim_form_1")
    assert got.columns == ["doc_id", "text", "n_units", "fim_form", "fim_text", "fim_form_1", "n_units_1", "prefix_chars", "middle_chars", "restored_text"]
    rows = got.collect()
    have = sorted(((r.doc_id, r.text, r.n_units_1, r.fim_form_1, r.prefix_chars, r.middle_chars, r.fim_text) for r in rows), key=str)
    assert have == sorted(((a, b, *plain(a, b)) for a, b in CASES), key=str)
    assert all(r.restored_text == (r.text or "") for r in rows)
    assert {"plain", "psm", "spm"} == {r.fim_form_1 for r in rows}
    assert fill_middle(df.limit(0)).count() == 0


def test_shares(spark):
    df = spark.createDataFrame([(i, "a\nb\nc\nd\n") for i in range(1000)], "doc_id long, text string")
    for seed, rate, spm in ((7, 30, 50), (8, 100, 0), (9, 0, 50)):
        rows = fill_middle(df, seed=seed, rate=rate, spm_share=spm).collect()
        assert {(r.doc_id, r.fim_form, r.fim_text) for r in rows} == {
            (i, f, t) for i in range(1000) for _, f, _, _, t in [plain(i, "a\nb\nc\nd\n", seed, rate, spm)]}


def test_words_against_loops():
    rnd = random.Random(3)
    for size in (0, 1, 7, 8, 9, 63, 64, 1000):
        data = bytes(rnd.choice((0x0A, 0x0B, 0x8A, 0x00, 0x80, 0xFF, 0x09, 0x41)) for _ in range(size))
        found = Marks(marks_of(as_words(data), 0x0A))
        places = [i for i, x in enumerate(data) if x == 0x0A]
        assert found.select(np.arange(len(places))).tolist() == places
        assert found.rank(np.arange(size + 1)).tolist() == [data[:i].count(0x0A) for i in range(size + 1)]
    text = "".join(rnd.choice("aé漢😀\n") for _ in range(500))
    data = text.encode()
    points = Marks(code_point_marks(as_words(data)))
    ends = np.cumsum([len(c.encode()) for c in text])
    assert points.rank(ends).tolist() == list(range(1, 501))


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = sorted((i, n, f, p, m, digest(out), digest(t or "")) for i, t in docs for n, f, p, m, out in [plain(i, t)])
    got = op11_fill_middle(spark, sf_dir)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
