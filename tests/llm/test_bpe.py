import base64
import random

import public_tokenizers
import tiktoken

from tokentide.llm import bpe
from tokentide.llm.queries import vocabulary


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary()[0].splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_match_the_library(docs, corpus):
    other = library()
    texts = {i: t or "" for i, t, _ in corpus}
    for r in bpe.encoded(docs, *vocabulary()).collect():
        assert r.ids == other.encode_ordinary(texts[r.doc_id])
        assert r.decoded == texts[r.doc_id]
    assert all(r.round_trip for r in bpe.digests(docs, *vocabulary()).collect())


def test_random_strings():
    other, own = library(), bpe.codec(*vocabulary())
    rng = random.Random(3)
    for alphabet in ("abetionsr  \n\t'stdREÉßøñ世界🙂012!?#$...", [chr(c) for c in range(32, 0x3000)], "aA  \n"):
        for _ in range(800):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            ids = own.encode(text)
            assert ids == other.encode_ordinary(text)
            assert own.decode(ids) == "".join(own.decode_stream(ids)) == text


def test_transducer_table_may_be_dropped(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    monkeypatch.setattr(bpe, "MOST_WORDS", 5)
    other, own = library(), bpe.Codec(*vocabulary())
    text = "thandeation of therewith anthonestic " * 30 + "x" * 500
    assert own.encode(text) == other.encode_ordinary(text)


def test_words_of_letters_are_kept_once():
    other, own = library(), bpe.Codec(*vocabulary())
    text = "x zqvthering Xqzzy don't zqv's naïveté abc1 " + "zq" * 50 + " end"
    assert own.encode(text) == other.encode_ordinary(text)
    assert "zqvthering" in own.words and " zqvthering" not in own.ids


def test_decoder_takes_any_cut_of_any_bytes():
    rng = random.Random(4)
    for _ in range(2000):
        data = bytes(rng.choices([*range(256), 0xE4, 0xB8, 0x96, 0xF0, 0x9F], k=20))
        machine, at, out = bpe.Utf8(), 0, ""
        while at < len(data):
            to = at + rng.randint(1, 4)
            out, at = out + machine.feed(data[at:to]), to
        assert out + machine.close() == data.decode("utf-8", "replace")


def test_edge_tables(no_docs, null_rows):
    assert bpe.digests(no_docs, *vocabulary()).collect() == []
    assert {r.n_tokens for r in bpe.digests(null_rows, *vocabulary()).where("doc_id = 5").collect()} == {0}
