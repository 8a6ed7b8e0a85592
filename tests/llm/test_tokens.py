import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelwise.llm import tokens
from panelwise.llm.queries import op6_tokens
from panelwise.llm.tokens import _DOUBTFUL, BLOCK, Encoder, TokenFile, new_folder, pack, read_tokens, to_file, unpack, vocabulary_bits, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 10_001).astype(np.uint32)
    data = pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8)
    assert (unpack(data, len(ids), width) == ids).all()


@pytest.mark.parametrize("width", [13, 16])
def test_random_access(width):
    draw = np.random.default_rng(0)
    ids = [draw.integers(0, 1 << width, n).astype(np.uint32) for n in (1, 5, 3 * BLOCK, 0, BLOCK, 77)]
    file = TokenFile(to_file([9, None, 3, -4, 5, 6], ids, width))
    flat = np.concatenate(ids)
    assert [(d, s, x.tolist()) for d, s, x in file.documents()] == [
        (d, sum(map(len, ids[:i])), ids[i].tolist()) for i, d in enumerate([9, None, 3, -4, 5, 6])
    ]
    for a, b in ((0, 1), (BLOCK - 1, BLOCK + 1), (7, len(flat)), (5, 5)):
        assert (file.ids(a, b) == flat[a:b]).all()


PARTS = {
    "blank": [" ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2003", "\x0b", "\x1c", "\u0085"],
    "word": ["a", "Word", "naïve", "Ünïcode", "ſtraße", "ﬁ", "ß", "ж", "漢字", "ª", "ǅ", "א"],
    "short": ["don't", "we'll", "I'd", "it's", "'S", "''s", "they've", "'re", "x's", "'", "’s"],
    "number": ["12", "3.14", "²", "½", "٣", "0", "007", "Ⅷ"],
    "sign": ["!?", "...", "–", "“q”", "…", "€", "\U0001f600", "e\u0301", "\u200d", "<", "<|endoftext|>", "<|endoftext", "¿", "«", "$%&*", "_", "\x00", "\x7f"],
}


@pytest.mark.parametrize("kinds", [tuple(PARTS), ("blank", "word"), ("short", "word", "sign"), ("number", "sign", "blank")])
def test_pre_tokens_encode_like_the_whole(kinds):
    draw, whole, encoder = random.Random(7), Tokenizer.from_file(PATH), Encoder(PATH)
    parts = [p for k in kinds for p in PARTS[k]]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(8_000)]
    plain = [p for p in parts if not _DOUBTFUL.search(p)]
    texts += ["".join(draw.choices(plain, k=draw.randint(0, 14))) for _ in range(8_000)]
    texts += [" ".join(draw.choices(plain, k=draw.randint(0, 9))) + draw.choice(["", ".", " ", "\n"]) for _ in range(8_000)]
    want = whole.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in encoder.encode(texts)] == [w.ids for w in want]
    assert encoder.splits and sum(encoder.pre_tokens(t) is not None for t in texts) > 8_000


def test_pre_tokens_are_those_of_the_library(small):
    """Every split of the table's texts that is made here is the library's."""
    whole, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    letters = encoder.letters
    for r in small.collect():
        pieces = encoder.pre_tokens(r.text or "")
        if pieces is not None:
            assert [p.encode().decode("latin-1").translate(letters) for p in pieces] == [p for p, _ in whole.pre_tokenizer.pre_tokenize_str(r.text or "")]


def test_other_tokenizers_encode_whole_texts(monkeypatch):
    encoder = Encoder(PATH)
    monkeypatch.setattr(encoder, "splits", False)
    texts = ["Some text, it's plain.", "", " \n"]
    assert [x.tolist() for x in encoder.encode(texts)] == [w.ids for w in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert not encoder.known


def expected(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_tokenizer(spark, small):
    got = sorted(tuple(r) for r in op6_tokens(spark, SMALL).collect())
    assert got == expected(sorted((r.doc_id, r.text) for r in small.collect()))


def test_odd_documents(spark, odd, none):
    folder = new_folder(spark)
    files = write_tokens(odd, folder, PATH, partitions=3)
    got = sorted((tuple(r) for r in read_tokens(spark, folder, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id}
    want = {doc: (n, crc) for doc, _, n, crc in expected(texts.items())}
    assert all((n, crc) == want[doc] for doc, _, n, crc in got if doc)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert read_tokens(spark, folder, write_tokens(none, new_folder(spark), PATH)).count() == 0
    assert vocabulary_bits(PATH) == 16


def test_texts_of_a_batch_become_objects_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """The files are the same whatever number of rows is taken from a batch at once."""
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i} " * (i % 5)) for i in range(60)], "doc_id long, text string")
    found = []
    for rows in (1, 7, 1024):
        monkeypatch.setattr(tokens, "ROWS", rows)
        folder = str(tmp_path / str(rows))
        files = write_tokens(docs, folder, PATH, partitions=2)
        found.append(sorted(map(tuple, read_tokens(spark, folder, files).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 60
