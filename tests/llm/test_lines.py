import hashlib
import random
from collections import defaultdict

import numpy as np

from basketry.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(texts, min_docs=3):
    held = defaultdict(set)
    for k, t in texts.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(k)
    out = {}
    for k, t in texts.items():
        rows = (t or "").split("\n")
        kept = [x for x in rows if not (len(key(x)) >= 20 and len(held[key(x)]) >= min_docs and k != max(held[key(x)]))]
        out[k] = (len(rows), len(rows) - len(kept), "\n".join(kept))
    return out


def random_texts(seed, n=40):
    rng = random.Random(seed)
    pool = [f"line number {k} that is long enough" for k in range(12)] + ["short", "", "  LINE number 3 that is long enough\t", "é" * 20, "é" * 19]
    return {k: "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) or None for k in range(n)}


def frame(docs, texts):
    return docs(list(texts.values()), list(texts))


def result(store, df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in store.clean(df).collect()}


def test_equals_brute_force_and_is_reversible(spark, docs, tmp_path):
    texts = random_texts(1)
    store = lines.LineStore(spark, f"file://{tmp_path}/s")
    store.insert(frame(docs, texts))
    assert result(store, frame(docs, texts)) == brute(texts)
    more = {k + 100: t for k, t in random_texts(2, 20).items()}
    store.insert(frame(docs, more))
    both = texts | more
    assert result(store, frame(docs, both)) == brute(both)
    gone = [k for k in both if k % 3 == 0 or k > 105]
    store.delete(spark.createDataFrame([(k,) for k in gone], "doc_id bigint"))
    rest = {k: t for k, t in both.items() if k not in gone}
    assert result(store, frame(docs, rest)) == brute(rest)


def test_rounds_of_filters(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    monkeypatch.setattr(lines, "SENT_BYTES", 40)
    texts = random_texts(3)
    store = lines.LineStore(spark, f"file://{tmp_path}/s")
    store.insert(frame(docs, texts))
    assert store.shards > 2 and result(store, frame(docs, texts)) == brute(texts)


def test_defined_cases(spark, docs, tmp_path):
    store = lines.LineStore(spark, f"file://{tmp_path}/s")
    store.insert(docs([]))
    assert store.clean(docs([])).count() == 0
    long = "a line of enough letters to count"
    df = docs([long, long, long, None, "", long + "\n" + long], [1, 1, 2, 3, None, 9])
    store = lines.LineStore(spark, f"file://{tmp_path}/t")
    store.insert(df)
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text) for r in store.clean(df).collect())
    assert got == [(0, 1, 0, ""), (1, 1, 1, ""), (1, 1, 1, ""), (2, 1, 1, ""), (3, 1, 0, ""), (9, 2, 0, long + "\n" + long)]
    assert set(store.clean(df).columns) >= {"_text", "row", "key", "class_id"}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    f = lines.CuckooFilter.of(keys)
    assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01
    assert (lines.CuckooFilter.from_bytes(f.to_bytes()).table == f.table).all()
    assert hashlib.md5(b"").digest_size == 16


def test_filters_grow_with_the_store(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 20_000)
    store = lines.LineStore(spark, f"file://{tmp_path}/s")
    store.insert(docs([]))
    texts = {}
    for turn, n in enumerate((30_000, 30_000, 40_000)):
        new = {}
        for k in range(0, n, 100):
            text = "\n".join(f"repeated line number {j} of turn {turn}" for j in range(k, k + 100))
            new |= {100_000 * turn + k + c: text for c in range(3)}
        store.insert(frame(docs, new))
        texts |= new
        assert result(store, frame(docs, texts)) == brute(texts)
    assert store.shards > 1
    gone = [k for k in texts if k % 700 == 0]
    store.delete(spark.createDataFrame([(k,) for k in gone], "doc_id bigint"))
    rest = {k: t for k, t in texts.items() if k not in gone}
    assert result(store, frame(docs, rest)) == brute(rest)


def test_full_shard_is_built_anew(spark, docs, tmp_path):
    store = lines.LineStore(spark, f"file://{tmp_path}/s")
    texts = {}
    for turn, n in enumerate((1, 40, 400)):
        new = {10 * turn + k: "\n".join(f"repeated line number {j} of turn {turn}" for j in range(n)) for k in range(3)}
        store.insert(frame(docs, new))
        texts |= new
    assert store.shards == 1 and result(store, frame(docs, texts)) == brute(texts)
