import random
import re

import numpy as np
import pyarrow as pa

from basketry.llm import chunks, registry


def repeated_docs(texts, n=50):
    first, out = {}, set()
    for k in sorted(texts):
        t = texts[k] or ""
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        mine = [t[at[i][0]:at[i + n - 1][1]] for i in range(len(at) - n + 1)]
        out |= {k} if any(p in first for p in mine) else set()
        for p in mine:
            first.setdefault(p, k)
    return out


def test_finds_all_and_only_repeats(spark, tables):
    docs = registry.table(spark, tables, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    spans = registry.QUERIES["op10_substring_dedup"](spark, tables)
    rows = spans.collect()
    for r in rows:
        passage = texts[r.doc_id].encode()[r.start:r.start + r.length].decode()
        assert passage in texts[r.source] and r.source < r.doc_id and len(passage.split()) == r.n_words >= 50
    assert {r.doc_id for r in rows} == repeated_docs(texts)
    left = {r.doc_id: r.text for r in chunks.without_repeats(docs, spans).collect()}
    for k, t in texts.items():
        want = t.encode()
        covered = np.ones(len(want), bool)
        for r in rows:
            if r.doc_id == k:
                covered[r.start:r.start + r.length] = False
        assert left[k].encode() == np.frombuffer(want, np.uint8)[covered].tobytes()


def test_defined_cases(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    p, q, twice = say(60), say(45), say(70)
    texts = [say(20) + " " + p + " " + say(9), p, "x" + p, None, "", "é" * 4000, "é" * 4000, say(5) + " " + q, q + " " + say(5), twice + " " + twice, "y\n" + p + "\nz", say(30000)]
    got = chunks.repeats(docs(texts)).collect()
    assert {(r.doc_id, r.source) for r in got} == {(1, 0), (2, 0), (10, 0)}
    assert {r.doc_id: r.n_words for r in got} == {1: 60, 2: 59, 10: 60}
    assert chunks.repeats(docs([])).count() == 0
    assert chunks.repeats(docs([p, p, p], [4, 4, None])).count() == 0
    names = chunks.without_repeats(docs(texts), chunks.repeats(docs(texts)))
    assert names.columns == docs(texts).columns and {r.doc_id: r.text for r in names.collect()}[1] == ""


def test_cuts_resist_shifts():
    rng = np.random.default_rng(0)
    text = "".join(chr(c) for c in rng.integers(97, 123, 20000))
    a = chunks.chunks_of(pa.array([text]))
    b = chunks.chunks_of(pa.array(["inserted" + text[:9000] + "more" + text[9000:], text]))
    own = set(a[4].tolist())
    assert len(own & set(b[4][b[0] == 0].tolist())) > 0.99 * len(own)
    assert b[4][b[0] == 1].tolist() == a[4].tolist()
    assert (a[2][:-1] == a[1][1:]).all() and a[2][-1] == 20000


def repeated_words(texts, n=50):
    """Per document the words that lie in a run of n that an earlier one holds."""
    first, out = {}, {}
    for k, t in enumerate(texts):
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        runs = [t[at[i][0]:at[i + n - 1][1]] for i in range(len(at) - n + 1)]
        mine = {w for i, p in enumerate(runs) if first.get(p, k) < k for w in range(i, i + n)}
        if mine:
            out[k] = mine
        for p in runs:
            first.setdefault(p, k)
    return out


def reported_words(texts, rows):
    out = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.source < r.doc_id and raw[r.start:r.start + r.length] in texts[r.source].encode() and r.n_words >= 50
        begin = len(raw[:r.start].split())
        out.setdefault(r.doc_id, set()).update(range(begin, begin + r.n_words))
    return out


def test_periodic_passages(docs):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(5, 9))) for _ in range(n))
    texts = []
    for period in range(1, 6):
        for _ in range(4):
            unit = " ".join("".join(rng.choice("andtheo") for _ in range(rng.randrange(1, 5))) for _ in range(period)).split()
            run = lambda n: " ".join((unit * n)[:n])
            texts += [say(9) + " " + run(60) + " " + say(9), say(7) + " " + run(83) + " " + say(30), run(50), say(30) + " " + run(49)]
    texts += ["and " * 30000, "and " * 40000 + "end"]
    want = repeated_words(texts)
    assert len(want) >= 40
    assert reported_words(texts, chunks.repeats(docs(texts)).collect()) == want


def test_passages_known_in_pieces(docs):
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    passage = say(120)
    edited = [f"edit{k}" if k % 35 == 17 else w for k, w in enumerate(passage)]
    common = [" ".join(say(20)) for _ in range(6)]
    orders = [[0, 3, 1, 4, 2, 5], [5, 2, 4, 1, 3, 0], [0, 1, 2, 4, 3, 5], [3, 0, 1, 2, 5, 4]]
    texts = [" ".join(edited), " ".join(say(9) + passage), " ".join(passage + say(9)), *("\n".join(common[k] for k in o) for o in orders)]
    want = repeated_words(texts)
    assert sorted(want) == [2, 6]
    assert reported_words(texts, chunks.repeats(docs(texts)).collect()) == want
