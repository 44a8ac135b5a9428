"""Passage dedup against brute force, and planted passages."""

import random
import re

import xxhash

from spreadloom.llm.entries import op7_substring_dedup
from spreadloom.llm.passage_dedup import drop_repeated_passages, without


def plain_paragraphs(text, size=12, window=8):
    """(first word, word behind the last, words) by loops over the definition, with the words themselves for a digest."""
    spans = [m.span() for m in re.finditer(r"\S+", text or "")]
    words = [text[a:z].lower() for a, z in spans]
    hashes = [xxhash.xxh64_intdigest(w) >> 2 for w in words]
    borders, closes = {len(words)}, {len(words)}
    for i, (a, _) in enumerate(spans):
        before = text[spans[i - 1][0]:spans[i - 1][1]] if i else ""
        if i == 0 or "\n" in text[spans[i - 1][1]:a]:
            borders.add(i)
            closes.add(i)
        elif text[a].isupper() or re.search("[.!?][\"')\\]}»”’]?$", before):
            borders.add(i)
    for i in range(len(words) - window + 1):
        borders.add(max(range(i, i + window), key=lambda j: (-hashes[j], j)))
    pairs = set()
    for b in borders:
        pairs.add((b, min((e for e in borders if e >= b + size), default=None)))
    for e in closes:
        pairs.add((max((b for b in borders if b <= e - size), default=None), e))
    return [(a, z, tuple(words[a:z])) for a, z in sorted(p for p in pairs if None not in p)], spans


def plain(docs, least=25):
    """The same rule on one machine: the first of each paragraph stays."""
    cut_of = {text: plain_paragraphs(text) for text in {t for _, t in docs}}
    first = {}
    for doc_id, text in docs:
        if doc_id is not None:
            for a, _, key in cut_of[text][0]:
                first[key] = min(first.get(key, (doc_id, a)), (doc_id, a))
    out = []
    for doc_id, text in docs:
        found, spans = cut_of[text]
        covered = [False] * len(spans)
        for a, z, key in found:
            if doc_id is not None and first[key] != (doc_id, a):
                covered[a:z] = [True] * (z - a)
        cut, a = [], None
        for i in range(len(spans) + 1):
            if i < len(spans) and covered[i] and a is None:
                a = i
            elif a is not None and not (i < len(spans) and covered[i]):
                if i - a >= least:
                    cut.append((spans[a][0], spans[i - 1][1]))
                a = None
        out.append((doc_id, without(text or "", cut), cut))
    return sorted(out, key=str)


def collected(df, n="n_removed"):
    return sorted(((r.doc_id, r.kept_text, list(zip(r.removed_starts, r.removed_ends))) for r in df.collect()), key=str)


def sentences(rng, n):
    words = ["w%d" % i for i in range(2000)]
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(5, 14))).capitalize() + "." for _ in range(n))


def test_planted_passages_go_but_once(spark):
    rng = random.Random(11)
    hot, rare = sentences(rng, 8), "A single unit of " + " ".join(f"x{i}" for i in range(60))
    docs = [(i, sentences(rng, 6)[:-1] + " and so " + hot + " then " + sentences(rng, 5)) for i in range(30)]
    docs += [(50 + i, sentences(rng, 9) + "\n" + (rare if i < 3 else "")) for i in range(20)]
    docs += [(90, hot + "\n" + sentences(rng, 3) + "\n" + hot), (None, hot), (91, None), (92, ""), (93, "short"), (0, docs[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, kept_text int")
    got = drop_repeated_passages(df)
    assert got.columns == ["doc_id", "text", "kept_text", "kept_text_1", "n_removed", "removed_starts", "removed_ends"]
    got = collected(got.drop("kept_text").withColumnRenamed("kept_text_1", "kept_text"))
    assert got == plain(docs)
    kept = {i: t for i, t, _ in got}
    lost = {i for i, _, cut in got if cut}
    assert lost == {*range(1, 30), 51, 52, 90}
    assert all(hot not in kept[i] and len(kept[i].split()) > 60 for i in range(1, 30)) and hot in kept[0] and hot in kept[None]
    assert kept[90].strip() == docs[50][1].split("\n")[1]
    assert all(without(dict(docs)[i], cut) == t for i, t, cut in got if i and cut)
    assert drop_repeated_passages(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = collected(op7_substring_dedup(spark, sf_dir))
    assert got == plain(docs)
    assert any(cut for _, _, cut in got)


def test_passages_without_marks_cut_at_any_word_go(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(3000)]
    docs = []
    for i in range(40):
        passage = [rng.choice(words) + "," * (i % 2) for _ in range(50 + i)]
        for _ in range(2):
            host = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
            at = rng.randrange(len(host))
            docs.append((len(docs), " ".join(host[:at] + passage + host[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = collected(drop_repeated_passages(df))
    assert got == plain(docs)
    lost = {i: len(dict(docs)[i].split()) - len(t.split()) for i, t, _ in got}
    assert all(lost[2 * i] == 0 and 30 + i <= lost[2 * i + 1] <= 50 + i for i in range(40))
