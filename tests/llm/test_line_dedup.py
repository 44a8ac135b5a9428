"""Line dedup and its Bloom filters against brute force."""

import hashlib
from collections import defaultdict

import numpy as np

from spreadloom.llm.bloom import Sketch, merge, places, suspected
from spreadloom.llm.entries import op5_line_dedup
from spreadloom.llm.line_dedup import drop_repeated_lines

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(docs, min_docs=5, min_chars=40):
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_defined_cases(spark):
    long, other = "A line of more than forty code points, é", "the other line that is long enough for a key"
    docs = [(i, f"{long.upper() if i % 2 else long}  \nx{i}\n\t{long}") for i in range(1, 8)]
    docs += [(7, f"again {i}\n{long}") for i in range(2)] + [(None, f"{long}\n{other}"), (20, None), (21, ""), (22, "\n\n")]
    docs += [(30, other), (30, other), (30, other), (30, other), (30, other), (31, other + "\n" + other)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, n_lines int, drop_id int")
    got = drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "drop_id", "kept_text", "n_lines_1", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines_1, r.n_dropped, r.kept_text) for r in got.collect()), key=str) == plain(docs)
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_no_repeat_escapes_the_filters():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    whole, parts = [], []
    for task in range(5):
        sketch = Sketch(9)  # far too small: suspects too many, misses none
        for doc in range(40):
            own = np.unique(rng.choice(values, 50))
            whole.append(own)
            sketch.add(own)
        sketch.settle()
        parts.append(sketch.cells)
    word, once, again = merge(*(np.concatenate(x) for x in zip(*parts)))
    table = np.zeros(1 << 9, np.uint64)
    table[word] = again
    seen, n = np.unique(np.concatenate(whole), return_counts=True)
    assert suspected(table, seen[n > 1]).all()
    assert len(np.unique(word)) == len(word) and (places(seen, 9)[0] < 512).all()


def test_a_large_enough_filter_suspects_few():
    rng = np.random.default_rng(2)
    sketch = Sketch(16)
    values = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    sketch.add(values)
    sketch.add(values[:1000])
    sketch.settle()
    table = np.zeros(1 << 16, np.uint64)
    table[sketch.cells[0]] = sketch.cells[2]
    assert suspected(table, values[:1000]).all() and suspected(table, values[1000:]).mean() < 0.01


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in plain(docs)]
    assert sorted((tuple(r) for r in op5_line_dedup(spark, sf_dir).collect()), key=str) == sorted(want, key=str)
    assert any(c for _, _, c, _ in want)
