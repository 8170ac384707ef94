"""BPE, token files and chat formatting against the tokenizers library, exact round trips and plain Python."""

import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelens.llm import bpe, chat, token_files

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return token_files.library(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(PATH)


PIECES = [
    "the", "in", "an", "er", "thing", "'s", "'re", "  ", "\n", "é", "É", "Σ", "ΑΣ", "İ", "ß", "你好", "<|endoftext|>", "<|startoftext|", "!", "...", "1", "½",
    "\x1c", "\x85", "\xa0", "​", "😀", "ﬁ", "Ω", "K", "́", "\x00", "'LL", "don't", "ſ",
]


def test_encoding_and_decoding_equal_the_library(library, merges):
    encoder, pick = bpe.Encoder(merges), random.Random(7)
    for _ in range(1500):
        text = "".join(pick.choice(PIECES) for _ in range(pick.randrange(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert bpe.TokenDecoder(merges).feed(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_long_words_stream_with_bounded_memory(library, merges):
    pick = random.Random(3)
    for letters in ("ab", "ein", "thn", "lo", "etaoinshrdlu", "!.", "haha"):
        word = "".join(pick.choice(letters) for _ in range(4000))
        machine, ids, most = bpe.Transducer(merges), [], 0
        for piece in (word[i : i + 37] for i in range(0, len(word), 37)):
            ids += machine.feed(merges.base[b] for b in piece.encode())
            most = max(most, len(machine.held))
        ids += machine.finish()
        assert ids == library.encode(word, add_special_tokens=False).ids
        assert most <= 2 * machine.window


def test_lookahead_is_that_of_the_merges(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"model": {"vocab": {"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, "merges": [["b", "c"], ["a", "b"]]}}')
    small = bpe.MergeList(str(path))
    assert (small.lookahead, small.longest) == (2, 2)  # to merge a and b, the c that b may prefer must be known
    assert small.merge([0, 1, 2]) == [0, 3] and small.merge([0, 1, 0, 1]) == [4, 4]


def test_bytes_come_out_as_whole_characters(merges):
    decoder = bpe.ByteDecoder(merges)
    ids = bpe.Encoder(merges).encode("naïve 你好 <|endoftext|> 😀!")
    assert "".join([*map(decoder.feed, ids), decoder.finish()]) == "naïve 你好 <|endoftext|>😀! "


def test_round_trip_of_awkward_rows(awkward, nothing, library):
    found = sorted(map(tuple, bpe.round_trip(awkward).collect()), key=str)
    expected = []
    for row in awkward.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        expected.append((row.doc_id, len(ids), *sha))
    assert found == sorted(expected, key=str)
    assert bpe.round_trip(nothing).count() == 0
    encoded = bpe.encode(awkward)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert texts[0] == texts[1] == "" and texts[5] == "x</w>"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 50), max_size=300), st.booleans())
def test_elias_fano_select(values, dense):
    values = sorted(v % 500 if dense else v for v in values)
    made = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert [made.select(i) for i in range(len(values))] == values


def test_token_files_hold_all_documents_in_order(spark, awkward, nothing, library, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 200)
    manifest = token_files.write_files(awkward)
    found = sorted(map(tuple, token_files.read_files(spark, manifest).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for row in sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, token_files.END_ID]
        expected.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    assert token_files.read_files(spark, token_files.write_files(nothing)).count() == 0


def test_chat_log_is_folded(spark):
    events = [
        (1, 1, 10, "open", "user", None), (1, 2, 10, "delta", None, "Hi"), (1, 3, 10, "delta", None, " there"),
        (1, 4, 11, "open", "assistant", None), (1, 5, 11, "delta", None, "Bad"), (1, 6, 11, "regenerate", None, None), (1, 7, 11, "delta", None, "Good"),
        (1, 9, 10, "edit", None, "Hello"), (1, 10, 12, "open", "user", None), (1, 11, 12, "delta", None, "gone"), (1, 12, 12, "delete", None, None),
        (2, 1, 20, "open", None, None),
    ]
    found = chat.fold(spark.createDataFrame(events, chat.EVENTS)).collect()
    assert sorted(map(tuple, found)) == [(1, 1, "user", "Hello"), (1, 4, "assistant", "Good"), (2, 1, "", "")]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "\\", "[\\INST]", "<<SYS>>x<</SYS>>", "", None, "a\nb", "<s", "é</s>\n"]
    rows = [(None if i == 9 else i // 2, i % 2, "assistant" if i % 2 else ["user", None, "a\\n\nb", "<s>", "user"][i // 2], t) for i, t in enumerate(texts)]
    rows += [rows[0]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text as message", "1 as seq", "role as kind")
    rendered = chat.render(chat.fold(chat.as_events(frame)))
    for r in rendered.collect():
        inside = r.formatted[len(chat.BEGIN) : -len(chat.END)]
        assert not any(x in inside for x in ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"))
    found = {r.conv_id: r for r in chat.digests(rendered).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        learned = "".join(t for _, role, t in turns if role == "assistant")
        own = found[conv]
        assert (own.n_turns, own.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest())
        assert (own.loss_chars, own.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digests(chat.render(chat.fold(chat.as_events(frame.limit(0))))).count() == 0
