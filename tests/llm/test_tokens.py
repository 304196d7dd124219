"""Token ids against the library: every stable letter, strings over all planes, long words."""

import random
import zlib

import numpy as np
import pytest

from lakefolio.llm import bpe, packing, words
from lakefolio.llm.common import table

DATA = "/root/testdata/sf0.01"
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def raw(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_stable_letters_are_the_library_s(library):
    cutter = words.Cutter(PATH)
    stable = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and not cutter.odd.search(chr(i)) and not chr(i).isspace()]
    assert len(stable) > 30_000
    for c in stable:
        assert library.normalizer.normalize_str(c) == c.lower()
        some = f"a{c}.{c}1".lower()
        assert [some[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(some)] == cutter.split.findall(some)


def test_strings_over_all_planes(library):
    rng = random.Random(1)

    def letter():
        kind = rng.random()
        if kind < 0.4:
            return chr(rng.randrange(32, 127))
        if kind < 0.6:
            return chr(rng.randrange(0x80, 0x600))
        if kind < 0.75:
            return rng.choice(" \n\t' 　\x1ċ̖Σς")
        return chr(rng.choice([rng.randrange(0x600, 0xD800), rng.randrange(0xE000, 0x110000)]))

    texts = ["İ̖", "\U00016eb1", *("".join(letter() for _ in range(rng.randrange(1, 14))) for _ in range(50_000))]
    own, encoder = bpe._encoder(PATH)
    for text, a, b in zip(texts, encoder.texts(texts), packing._library_encoder(PATH).texts(texts)):
        assert a == b == raw(library, text), text
        assert own.decode(a) == library.decode(np.frombuffer(a, "<u4").tolist(), skip_special_tokens=False)


def test_long_words(library):
    own = bpe.Bpe(PATH)
    rng = random.Random(2)
    for word in ("ab" * 5000, "".join(rng.choice("aetinsor") for _ in range(20_000)), "é" * 3000):
        assert own._one(word.encode()) == raw(library, word)


def test_pieces_have_the_library_s_ids(spark, library):
    docs = table(spark, DATA, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {(r.doc_id, r.piece): r for r in packing.pieces(docs, PATH).collect()}
    n = 0
    for doc, text in texts.items():
        ids = raw(library, text or "") + bytes(4)
        for piece, low in enumerate(range(0, len(ids), 4 * 2048)):
            part, r = ids[low : low + 4 * 2048], got[doc, piece]
            assert (r.start, r.length, r.ids_crc32) == (low // 4, len(part) // 4, zlib.crc32(part))
            n += 1
    assert n == len(got)


def test_few_kept_words_give_the_same_ids(library):
    texts = [f"alpha beta{n % 7} gamma, {'x' * (n % 5)} 中文 <|endoftext|> w{n}" for n in range(300)] + ["", None, "alpha"]
    for kept in (0, 3, 1000):
        encoder = packing._library_encoder(PATH, kept)
        for low in range(0, len(texts), 50):
            some = texts[low : low + 50]
            assert list(encoder.texts(some)) == [raw(library, t or "") for t in some]
        assert len(encoder.words) <= kept + 1 and len(encoder.parts) <= max(kept, len(encoder.cutter.special))
