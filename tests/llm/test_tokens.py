"""Piece encoding and packing against the libraries they must equal."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from strongbox.llm.packing import WORD, TextIds, best_fit, cut_pieces, pack_documents
from strongbox.llm.pieces import Encoder, encode_pieces
from strongbox.llm.queries import QUERIES
from strongbox.llm.words import Known
from tokenizers import Tokenizer

MODEL, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "a \n b\n", "\n\n", "it's 15.2, x... y ,z", "é́ ² ².", "日本。 ▁▁ a▁", "\x00 a", "<|endoftext|> x", "a\tb\u00a0 c", "don't.", "x" * 5000, "_.a ,", "\r\n x"]


@pytest.fixture(scope="module")
def libraries():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL), Tokenizer.from_file(BYTES)


def test_pieces_of_whole_table(spark, sf, libraries):
    texts = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    got = {r["doc_id"]: r for r in QUERIES["op3_sentencepiece"](spark, sf).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = libraries[0].encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(libraries[0].decode(ids).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n.,_a'sé▁日1²!\t#thequick", max_size=60))
def test_any_text_as_the_libraries_do(text):
    tokenizer, encoder = TextIds(BYTES), Encoder(MODEL)
    assert np.frombuffer(tokenizer.of([text])[0], "<u4").tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids(text).tolist() == encoder.pieces.library.encode(text)
    encoder.check()


def test_agendas_of_many_chunks_are_worked_off_together(libraries):
    encoder, alone = Encoder(MODEL), []
    one = encoder.pieces.merged
    encoder.pieces.merged = lambda chunk: alone.append(chunk) or one(chunk)
    try:
        words = ["the", "a", "Überraschung", "aaaaaa", "x" * 32, "ciónlaqué", "e" * 31 + "s", *(f"{a}{b}ing" for a in "abcdefgh" for b in ("tion", "quick", "zz", "é"))]
        text = " ".join(words) + ". It, too\n\nand  so   on  "
        for given in (text, text + " 日本語𐍈 x", "y" * 33, "\n.\n,"):
            assert encoder.ids(given).tolist() == libraries[0].encode(given)
        # By themselves go only long chunks and those with characters that are no piece.
        assert all(len(c) > 32 or "𐍈" in c or c == "\n" for c in alone), alone
        wrong = encoder.pieces.many_ids
        encoder.pieces.many_ids = lambda chunks: [ids[:-4] if c.startswith("▁wrong") else ids for c, ids in zip(chunks, wrong(chunks), strict=True)]
        with pytest.raises(ValueError, match="differ"):
            encoder.ids("this is wrong ,though")
    finally:
        del encoder.pieces.merged
        encoder.pieces.__dict__.pop("many_ids", None)


def test_odd_texts_nulls_and_repeated_rows(spark, libraries):
    given = [(i, t) for i, t in enumerate(ODD)] + [(0, None), (0, None), (None, "a b")]
    frame = docs(spark, *[(i, t, "x", "y", 1, "clash") for i, t in given], more=", ids string")
    got = sorted(rows(encode_pieces(frame, MODEL), "doc_id", "n_tokens", "ids", "decoded"), key=str)
    want = []
    for i, t in given:
        ids = libraries[0].encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), ids, libraries[0].decode(ids)))
    assert got == sorted(want, key=str)


def test_new_words_are_not_encoded_one_by_one(libraries):
    letters = [chr(c) for c in range(0x250) if WORD.fullmatch(chr(c))]
    text = " ".join(["".join(letters), *(f"new{a}word{b}" for a in letters[:40] for b in ("ly", "é", "s7", "!?"))])
    ids, encoded, asked = TextIds(BYTES), [], []
    by_library = ids._encoded
    ids._encoded = lambda chunks: asked.extend(chunks) or by_library(chunks)
    for _ in range(3):
        encoded.append(ids.of([text, "Σ ǅ 日本 × a÷b", text[:1000]])[0])
    assert len(libraries[1].pre_tokenizer.pre_tokenize_str("".join(letters))) == 1
    assert [np.frombuffer(e, "<u4").tolist() for e in encoded] == [libraries[1].encode(text, add_special_tokens=False).ids] * 3
    assert len(asked) <= 2


def test_chunks_that_come_again_are_kept():
    known = Known({"": b"-"})
    assert [known[c] for c in ("a", "b", "a")] == [1, 2, 1] and known.new == ["a", "b"]
    known.values[1:], known.new = [b"A", b"B"], []
    known.turn()
    assert known.values[known["b"]] == b"B" and known.new == [] and known.values[known["c"]] is None and known.new == ["c"]
    known.turn()
    assert known.values[known["a"]] is None


def check_packing(pieces, texts, tokenizer, capacity=1024):
    of = defaultdict(list)
    for r in pieces:
        of[r["doc_id"]].append(r)
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(of[doc_id], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == cut_pieces(len(ids), capacity)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing_of_whole_table(spark, sf, libraries):
    texts = rows(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    pieces = QUERIES["op9_best_fit_packing"](spark, sf).collect()
    used = check_packing(pieces, texts, libraries[1])
    assert used == plain_best_fit([r["length"] for r in pieces], 1024)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_runs_place_as_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    placed = sorted(best_fit(counts, 20))
    used = defaultdict(int)
    for i, (length, first, each, sequence, offset) in enumerate(placed):
        end = placed[i + 1][1] if i + 1 < len(placed) and placed[i + 1][0] == length else counts[length]
        for rank in range(first, end):
            used[sequence + (rank - first) // each] += length
    assert sum(used.values()) == sum(lengths) and all(v <= 20 for v in used.values())
    assert len(used) == plain_best_fit(lengths, 20)


def test_packing_odd_texts_and_repeated_rows(spark, libraries):
    given = [(i, t) for i, t in enumerate(ODD)] + [(100, None)]
    check_packing(pack_documents(docs(spark, *given), BYTES).collect(), given, libraries[1])
    twice = pack_documents(docs(spark, (1, "a b"), (1, "a b"), (None, "c")), BYTES).collect()
    assert sorted((r["sequence_id"], r["offset"]) for r in twice) == [(0, 0), (0, 2), (0, 5)] or len({(r["sequence_id"], r["offset"]) for r in twice}) == 3
    assert pack_documents(docs(spark), BYTES).collect() == []


def test_no_documents(spark):
    assert encode_pieces(docs(spark), MODEL, digests=True).collect() == []
