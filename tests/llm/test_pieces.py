import random

import numpy as np
import pytest
import sentencepiece

from larkspur.llm import pieces

TEXTS = ["", " ", "a", "  a b ", "Hello world, hello World!", "a\n\nb\t c", "日本語のテキスト and 中文", "ﬁ①Ａ　x", "x" * 500, "ab" * 3000, "▁x ▁", "é́ é", "🍁 café 🍁🍁", "a\x00b", "<s> </s> <0x41> <unk>", "ACHACHZU!! CHHEIT!!", "= = =" * 50, " " * 100, "0123456789" * 30, "https://example.com/a?b=c&d=%20" * 3]


@pytest.fixture(scope="module")
def both():
    return pieces.Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def encoded(v, texts):
    ids, n = pieces.Encoder(v).encode(texts)
    return [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])]


def test_equals_the_library(both):
    v, library = both
    assert encoded(v, TEXTS) == library.encode(TEXTS)


def test_equals_the_library_on_random_texts(both):
    v, library = both
    rng = random.Random(2)
    alphabet = "aeionrtsthhe  ..,\néü▁" + "中あ🍁"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [" ".join(rng.choice(v.pieces[300:]).replace(pieces.BLANK, " ") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += ["".join(rng.choice(v.pieces[300:]) for _ in range(rng.randint(1, 60))).replace(" ", "") for _ in range(200)]
    assert encoded(v, texts) == library.encode(texts)


def test_decodes_as_the_library(both):
    v, library = both
    for t in TEXTS:
        ids = library.encode(t)
        assert pieces.decode(v, ids) == library.decode(ids)


def test_forgets_and_goes_on(both, monkeypatch):
    v, library = both
    monkeypatch.setattr(pieces, "REMEMBER", 3)
    own = pieces.Encoder(v)
    for t in TEXTS:
        assert own.encode([t])[0].tolist() == library.encode(t)


def test_columns(spark, both):
    v, library = both
    rows = [(1, "a b", "en", 5), (None, None, "x", 6), (3, "", None, 7), (1, "a b", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens long")
    got = pieces.encode_texts(docs, v, keep=("doc_id", "lang"))
    assert sorted(str(r["token_ids"]) for r in got.collect()) == sorted(str(library.encode(r[1] or "")) for r in rows)
    assert sorted(r["text"] for r in pieces.decode_ids(got, v).collect()) == ["", "", "a b", "a b"]
    assert pieces.encode_texts(docs.limit(0), v).collect() == []
