import random

import pytest

from lectern.llm import pieces, token_counts

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

COUNTS, PIECES = (pieces.tokenizer_file(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts():
    rng = random.Random(3)
    signs = "ab eéßñ▁  \n\t0123日本語😀́‍the ing　²½ª\x1c\x85​<>|'s"
    out = ["", " ", "  ", "a", "a ", "  a  b   c    d     e", "\n\n x", "<|endoftext|>a <|endoftext|>", "日本語 テスト",
           "it's we'll 'S", "<0x0A><s></s><unk>", "word" * 5000, " " * 5000 + "x", "x" * 100_000, "%$#" * 200]
    out += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    return out


def table(documents):
    rows = list(enumerate(texts()))
    return [*rows, (None, "null id"), (9000, None), (1, "again"), (1, "again")]


def test_token_counts_equal_the_library(documents):
    rows = table(documents)
    tokenizer = tokenizers.Tokenizer.from_file(COUNTS)
    got = token_counts.token_counts(documents(rows, "n_tokens"), COUNTS, limit=20).collect()
    want = []
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 20))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_proven_tokens_cost_one_each():
    tokenizer = tokenizers.Tokenizer.from_file(COUNTS)
    whole = token_counts.proven(COUNTS)
    assert len(whole) > 40_000
    assert all(len(tokenizer.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::50])


def test_ids_and_text_equal_the_library(documents):
    rows = table(documents)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = pieces.encode_pieces(documents(rows, "ids", "decoded"), PIECES).collect()
    want = [(i, model.encode(t or ""), model.decode(model.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_every_piece_encodes_as_the_library_does():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoder = pieces.Encoder(pieces.Vocabulary(PIECES))
    given = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.get_piece_size())]
    ids, offsets, decoded = encoder.encode(given)
    want = model.encode(given)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert decoded == [model.decode(w) for w in want]


def test_decoding_bytes_that_form_no_character():
    v = pieces.Vocabulary(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte = [int(v.byte_ids[b]) for b in (0xE6, 0x97, 0xA5, 0xFF, 0x41, 0xE6, 0x97)]
    for ids in ([], byte, [*model.encode("a b"), *byte[:3], 1, 2, *model.encode("c")]):
        assert pieces.decode(v, ids) == model.decode(ids)


def test_empty_tables(documents):
    assert token_counts.token_counts(documents([]), COUNTS).count() == 0
    assert pieces.encode_pieces(documents([]), PIECES).count() == 0
