import hashlib
import random

import public_tokenizers
import pytest
from helpers import DOCUMENTS, corpus, stored_tables
from tokenizers import Tokenizer

from paperloom.llm import bpe as D

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "it's I'll they've WORLD 123 <|endoftext|> x<|startoftext|>y <|endoftext| ΣΑΣ Σ İstanbul ǅ é \x1c\x1d\x85\xa0  z ​ ﬁ Å 😀", "don'T 'S", "aaaa" * 50, "ab" * 3000 + " c", "\x00\x01", "中文字 ²½Ⅷ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéÇçßöäΣσςİıſ \t\n'\"<|>.,!?0123456789²½Ⅷ中文字дΩ😀‍\xa0　\x1c\xad"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)]
    encoder = D.Encoder(D.Bpe(PATH))
    ids, bounds = encoder.encode(texts)
    decoded = D.Decoder(encoder.bpe.tokens).decode(ids, bounds).to_pylist()
    for k, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, text
        assert decoded[k] == library.decode(want, skip_special_tokens=False)


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(D, "REMEMBERED", 20)
    encoder = D.Encoder(D.Bpe(PATH))
    for k in range(6):
        ids, _ = encoder.encode([f"word{k} other{x}" for x in range(30)])
        assert ids.tolist() == [i for x in range(30) for i in library.encode(f"word{k} other{x}", add_special_tokens=False).ids]
        assert len(encoder.known) < 80


def test_query_against_the_library(spark, tmp_path, library):
    rows = [*corpus(4, 20), *[(900 + k, t, None, None, 0) for k, t in enumerate(ODD)], (None, "x", None, None, 0)]
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS))
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, D.op6_bpe(spark, d).collect()), key=str) == sorted(want, key=str)
    assert D.bpe_encode(spark.createDataFrame([], DOCUMENTS), PATH).count() == 0
