import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crosstally.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello world", "  two  spaces  ", "tabs\t\tand\n\nlines \n x", "it's we'll they've I'd 'S", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "été déjà Ünïcödé",
         "日本語のテキスト 12345 ٣٤٥ Ⅷ½", "😀😃 👨‍👩‍👧", "x\u00a0y\u3000z\u2028w\x85v\x1cu\x0bt", "a" * 3000, "word " * 4000, "!!!???...---" * 50, "\x00\x01\x7f", "thntblere of%%% then!! | edtioner", "é́ ̈ क्षि"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(open(PATH, encoding="utf-8").read())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return ids, back, (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_equals_the_library(library, own, monkeypatch):
    rng = random.Random(8)
    letters = "abcdefgh ABC  \n\t.,'!#12é日ß\u00a0\u200b😀"
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(300)] + ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1F700)])) for _ in range(60)) for _ in range(40)]
    for segment in (1 << 18, 5):
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        for t in texts:
            ids, back, digests = want(library, t)
            assert own.encode(t) == ids, repr(t)
            assert own.decode(ids) == back
            assert own.digests(t) == digests


def test_patterns_split_alike(own):
    """Every character of the narrower alphabets, alone and between letters, digits, marks and white space."""
    latin = [chr(c) for c in range(0x250)]
    texts = ["".join(latin)] + [f"{a}{c}{b}" for c in latin for a in ("", " ", "a", "1", ".", "\n") for b in ("", " ", "é", "²", "!", "\u00a0")]
    for text in texts:
        assert own.latin_pieces(text) == own.any_pieces(text), repr(text)
        if text.isascii():
            assert own.ascii_pieces(text) == own.any_pieces(text), repr(text)
    assert own.beyond_latin("\u0250") and not own.beyond_latin("".join(latin))


def test_ids_that_are_no_utf8_and_no_words(library, own):
    rng = random.Random(1)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_of_pieces_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for _ in range(2):
        own.encode(" ".join(f"piece{i}" for i in range(1000)))
    assert len(own.known) <= 51 and len(own.older) <= 51


def test_frames(spark, docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (3, TEXTS[3])]
    frame = docs(rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.with_digests(frame, PATH).collect())
    assert got == sorted((i if i is not None else -1, *want(library, t)[2]) for i, t in rows)
    back = bpe.with_text(bpe.with_ids(frame, PATH), PATH, into="again").select("text", "ids", "again").collect()
    assert all((r.text or "") == r.again and r.ids == want(library, r.text)[0] for r in back)
    assert bpe.with_digests(docs([]), PATH).count() == 0
