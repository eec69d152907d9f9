"""Token operators against the libraries they stand for."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vocatio.llm import bpe, packing, tokencounts
from vocatio.llm.common import Remembered, table
from vocatio.llm.queries import tokenizer


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = "ab 'stre<|endoftext|>\n\t.!5é漢½İΣ́\x1f ▁ \x85"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_word_bpe_equals_the_library():
    path = P.path("word_bpe_49k.json")
    own, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    for text in [*random_texts(500), "a" * 1000, "ab" * 2000, "'LL we'Re ǅ ϴ ẞ"]:
        ids = library.encode(text, add_special_tokens=False).ids
        packed, shown = own.encode(text)
        assert list(struct.unpack(f"<{len(ids)}I", packed)) == ids
        assert shown == library.decode(ids, skip_special_tokens=False) == own.decode(packed)


def test_long_words_merge_like_short_ones():
    own = bpe.WordBpe(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(50):
        word = "".join(rng.choice("abcdeinrst") for _ in range(150)).encode()
        parts = [own.inner[b] for b in word[:-1]] + [own.last[word[-1]]]
        assert own.merge(word) == own.merge_long(parts)


def test_encode_texts(docs_of, odd_pairs):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    expected = []
    for i, text in odd_pairs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    docs = docs_of(odd_pairs)
    assert Counter(map(tuple, bpe.encode_texts(docs, path, digest=True).collect())) == Counter(expected)
    whole = bpe.encode_texts(docs, path).filter("doc_id = 5").first()
    assert whole.ids == library.encode(odd_pairs[5][1], add_special_tokens=False).ids and whole.n_tokens == len(whole.ids)
    assert bpe.encode_texts(docs.limit(0), path).count() == 0


def test_piece_counts_equal_the_library(docs_of, odd_pairs):
    path = P.path("piece_bpe_32k.model")
    counter, library = tokencounts.PieceCounter(path), SentencePieceProcessor(model_file=path)
    for text in random_texts(500):
        assert counter.count(text) == len(library.encode(text)), text
    assert all(len(library.encode("\n" + p)) == 3 for p in random.Random(1).sample(sorted(counter.whole), 300))
    docs = docs_of(odd_pairs)
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in odd_pairs]
    assert Counter(map(tuple, tokencounts.count_tokens(docs, path).collect())) == Counter(expected)
    assert tokencounts.count_tokens(docs.limit(0), path).count() == 0


def test_byte_bpe_equals_the_library():
    path = P.path("byte_bpe_50k.json")
    own, library = packing.ByteBpe(path), Tokenizer.from_file(path)
    for text in random_texts(500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == struct.pack(f"<{len(ids)}I", *ids), text


@pytest.mark.parametrize("n, expected", [(1, [1]), (1024, [1024]), (2050, [1024, 1024, 2]), (7, [4, 2, 1])])
def test_pieces(n, expected):
    assert packing.pieces(n, 1024) == expected


@pytest.mark.parametrize("longest", [1024, 8, 1])
def test_packing(docs_of, odd_pairs, longest):
    path = P.path("byte_bpe_50k.json")
    library, docs = Tokenizer.from_file(path), docs_of(odd_pairs)
    rows = packing.pack(docs, path, longest=longest, with_ids=True).collect()
    expected = Counter()
    for i, text in odd_pairs:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 0], 0
        for n in packing.pieces(len(ids), longest):
            expected[i, at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n])), len(ids), tuple(ids[at : at + n])] += 1
            at += n
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in rows) == expected
    # Sequences are numbered without gaps, each holds one piece, equal lengths stand together.
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= longest for n in lengths)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_does_not_depend_on_partitions(spark, sf):
    docs, path = table(spark, sf, "documents"), P.path("byte_bpe_50k.json")
    one, many = (Counter(map(tuple, packing.pack(d, path).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


def test_remembered():
    calls = defaultdict(int)

    def slow(x):
        calls[x] += 1
        return x * 2

    memory = Remembered(slow, limit=3)
    assert [memory[x] for x in (1, 2, 3, 4, 1, 1, 5, 6, 1)] == [2, 4, 6, 8, 2, 2, 10, 12, 2]
    assert len(memory) + len(memory.older) <= 6 and calls[1] == 1


def test_digests_are_of_decoded_ids(docs_of, monkeypatch):
    docs = docs_of([(1, "some words, and more.")])
    monkeypatch.setattr(bpe, "arrow_map", lambda df, function, schema: function)
    monkeypatch.setattr(bpe.WordBpe, "decode", lambda self, ids: f"{len(ids)} bytes")
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "some words, and more."}])
    (out,) = bpe.encode_texts(docs, tokenizer("word_bpe_49k.json"), digest=True)(iter([batch]))
    row = out.to_pylist()[0]
    assert row["decoded_sha256"] == hashlib.sha256(f"{4 * row['n_tokens']} bytes".encode()).hexdigest()
