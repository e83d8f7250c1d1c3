import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerspark.llm.bpe import Codec, encode_decode
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_tree_concatenation_is_exact(library):
    codec, rng = Codec(PATH, long=8, fragment=5), random.Random(1)
    for i in range(1500):
        text = "".join(rng.choice(("thaninreer-éÉ1 😀", "aabthe", "ééΣIİ \x1c")[i % 3]) for _ in range(rng.randint(0, 150))) + "<|endoftext|>abcabcabc" * (i % 7 == 0)
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_very_long_word(library):
    text = "thanin" * 20_000
    assert Codec(PATH).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_tables(spark, library):
    docs = awkward(spark)
    got = sorted(map(tuple, encode_decode(docs, PATH).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_decode(empty(spark), PATH).count() == 0
    real = encode_decode(docs.where("doc_id = 3"), PATH, real=True).first()
    assert real["ids"] == library.encode("word", add_special_tokens=False).ids
