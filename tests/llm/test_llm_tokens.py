import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import SF, documents, frame
from tokenizers import Tokenizer

from millrace.llm.queries import QUERIES
from millrace.llm.sentencepiece_lattice import Model, decode_documents, encode_documents, units_of
from millrace.llm.token_files import read_token_files, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a  b ", "\n\t x", "日本語 ﬁ é½", "<|endoftext|> don't 'S ë ̈x", "a b▁c", "1234 5　", "x" * 5000, "<s> </s> <0x41>"]


def expected(docs):
    own = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for doc_id, text in docs:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_against_the_library(spark):
    assert [tuple(r) for r in QUERIES["op7_token_files"](spark, SF).orderBy("doc_id").collect()] == expected(documents(spark))


def test_odd_texts_and_rows_in_files(spark, where):
    folder = where("tokens")
    write_token_files(frame(spark, ODD), folder, WORDS, 2)
    assert [tuple(r) for r in read_token_files(spark, folder).orderBy("doc_id").collect()] == expected(list(enumerate(ODD)))
    write_token_files(frame(spark, ["b", "a", "a"], [5, None, 5]).selectExpr("*", "1 AS shard"), where("again"), WORDS, 2)
    got = read_token_files(spark, where("again")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (5, 2, 2), (5, 4, 2)]
    assert write_token_files(frame(spark, []), where("none"), WORDS, 2)["shards"] == []
    assert read_token_files(spark, where("none")).collect() == []


def test_ids_against_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = QUERIES["op9_sentencepiece"](spark, SF).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [sp.encode(t or "") for _, t in documents(spark)]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_lattice_follows_the_merges(seed):
    rng = random.Random(seed)
    sp, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), Model(PIECES)
    texts = ["".join(rng.choice("aeinst  éñ日̈\n.'ABhr") for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        assert [i for u in own.encode(units_of(t)) for i in u] == sp.encode(t), t


def test_odd_texts_round_trip(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tokens = encode_documents(frame(spark, ODD).selectExpr("*", "1 AS ids"), PIECES)
    got = tokens.orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [sp.encode(t or "") for t in ODD]
    texts = decode_documents(tokens, PIECES).orderBy("doc_id").collect()
    assert [r.text for r in texts] == [(t or "").replace("▁", " ") for t in ODD]
    assert encode_documents(frame(spark, []), PIECES).collect() == []


def test_a_small_lexicon_forgets_and_still_gives_the_same_ids():
    from millrace.llm import kernels as K
    from millrace.llm.lexicon import Lexicon

    import pyarrow as pa

    rng = random.Random(2)
    for most in (0, 2000, 20_000, 1 << 26):
        own = Lexicon(lambda ws: [[int(w[1:]), len(w)] for w in ws], most)
        for _ in range(30):
            numbers = [[int(rng.paretovariate(0.5)) % 3000 for _ in range(rng.randrange(60))] for _ in range(9)]
            texts = next(K.slices(pa.array([" ".join(f"w{i}" for i in row) for row in numbers])))
            w = K.Words(texts)
            flat, offsets = own.ids(texts.data, w.start, w.end, w.offsets)
            got = [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
            assert got == [[x for i in row for x in (i, len(str(i)) + 1)] for row in numbers]
        assert 20 * len(own) <= max(most, 20 * 600)


def test_rows_without_id_fill_several_shards(spark, where):
    texts = [f"text {i} of many" for i in range(3000)]
    docs = frame(spark, texts, [None if i % 3 == 0 else i for i in range(3000)])
    manifest = write_token_files(docs, where("null_ids"), WORDS, 2, shard_bytes=10_000)
    sizes = sorted(s["n_docs"] for s in manifest["shards"])
    assert len(sizes) > 3 and sizes[-1] < 3 * sizes[len(sizes) // 2]
    got = read_token_files(spark, where("null_ids")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 1000 + [i for i in range(3000) if i % 3]


def test_parts_of_mixed_words_against_the_library():
    import pyarrow as pa

    from millrace.llm import kernels as K
    from millrace.llm.token_files import lexicon

    rng = random.Random(7)
    own, (encoder, words) = Tokenizer.from_file(WORDS), lexicon(WORDS)
    alphabet = list("aaeinrst  \t.,-!#&%(<|>'s'tAZ019éÉñßŐɏɐ²½«×÷ªİıſ日̈\x01\x1c\x7f") + ["<|endoftext|>", "'re", "don't"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in K.slices(pa.array(texts)):
        flat, offsets = words.ids(*encoder.spans(t))
        for i in range(t.n):
            assert flat[offsets[i] : offsets[i + 1]].tolist() == own.encode(texts[t.first + i], add_special_tokens=False).ids, repr(texts[t.first + i])
