import heapq
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from basketry.llm import tokens

PATH = P.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap, total = sorted(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    return total


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, 300)
    assert (tokens.code_lengths(counts) * counts).sum() == huffman_cost(counts.tolist())
    steep = np.array([int(1.6 ** min(k, 80)) for k in range(120)])
    bits = tokens.code_lengths(steep, 9)
    assert bits.max() <= 9 and (2.0 ** -bits).sum() <= 1


def test_blocks_of_every_size():
    rng = np.random.default_rng(1)
    counts = (1e5 / (1 + np.arange(400)) ** 1.3).astype(int) + 1
    book = tokens.Codebook(np.arange(400) * 7, tokens.code_lengths(counts))
    for n in (0, 1, 255, 256, 257, 512, 5000):
        ids = (rng.choice(400, n, p=counts / counts.sum()) * 7).astype(np.uint32)
        assert (book.decode(*book.encode(ids), n) == ids).all()


def test_files(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 50)
    texts = ["", None, "hello world. it's", "a  b\n\n", "x" * 3000, "same text", "same text", "é漢字 words, and more words"] * 3
    ids = [7 * k % 24 for k in range(24)]
    folder = f"file://{tmp_path}/t"
    got = tokens.round_trip(docs(texts, ids), PATH, 0, folder).orderBy("doc_id").collect()
    library, at = Tokenizer.from_file(PATH), 0
    for r, (k, t) in zip(got, sorted(zip(ids, texts))):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert [np.frombuffer(r.ids, "<u4").tolist()[-1] for r in tokens.read(spark, folder).collect()] == [0] * 24
    assert tokens.round_trip(docs([]), PATH, 0, f"file://{tmp_path}/e").count() == 0


def test_repeated_and_null_ids(docs, tmp_path):
    got = tokens.round_trip(docs(["a b", "c", "c", None], [3, 3, None, 1]), PATH, 0, f"file://{tmp_path}/t").collect()
    assert sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == 2 + 2 + 1 + 3 and len({r.start for r in got}) == 4


def odd_texts(n):
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "᠎", " ", "　", "​", "\0", "a", "Ab", "é", "×", "ª", "漢字", "“", "…", "it's", "'ll", "23", "²",
             ".", ",", "!!", "<|endoftext|>", "😀", "ing", "x" * 210]
    rng = np.random.default_rng(2)
    return ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 14))) for _ in range(n)]


def test_cuts_at_odd_white_space_and_signs():
    library, memory = Tokenizer.from_file(PATH), tokens._memory(PATH)
    texts = [None, "", *odd_texts(4000), "", None]
    ids, ends = tokens.ids_of(memory, pa.array(texts, pa.string()), np.array([7], "<u4").tobytes())
    for text, a, b in zip(texts, [0, *ends[:-1]], ends):
        assert ids[a:b].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 7], text


def test_pieces_are_looked_up_once_a_slice_and_encoded_once():
    given, looked_up = [], []
    of_library = tokens._memory(PATH).encode

    class Counting(tokens.Memory):
        def get(self, piece):
            looked_up.append(piece)
            return super().get(piece)

    memory = Counting(lambda texts: given.extend(texts) or of_library(texts))
    texts = pa.array([" ".join(f"word{'abcde'[(k + j) % 5]}" for j in range(50)) + ".  End\tof é, text\n" for k in range(200)])
    first, again = (tokens.ids_of(memory, texts)[0] for _ in range(2))
    assert (first == again).all() and len(first) > 200 * 50
    assert len(given) == len(set(given)) < 30 and len(looked_up) < 60


def test_a_full_memory_keeps_what_is_at_hand():
    of_library = tokens._memory(PATH).encode
    memory, library = tokens.Memory(of_library, 20), Tokenizer.from_file(PATH)
    for k in range(30):
        text = f"{' '.join(f'word{chr(97 + (k + j) % 26)}' for j in range(8))} {'long' * 60}"
        assert tokens.ids_of(memory, pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(memory) <= 40 and max(map(len, memory)) <= tokens.LONG_PIECE


def test_packed_ids_hold_no_empty_planes():
    rng = np.random.default_rng(3)
    for top in (1, 250, 1 << 16, 1 << 20, 1 << 32):
        for n in (0, 1, 3000):
            ids = rng.integers(0, top, n).astype(np.uint32)
            blob = tokens.pack(ids)
            assert (tokens.unpack(blob) == ids).all() and len(tokens.unpack(blob)) == n
            assert len(blob) < 60 + n * (((top - 1).bit_length() + 7) // 8)
