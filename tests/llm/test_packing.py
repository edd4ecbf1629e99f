import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tracewright.llm.packing import match_and_fit, pack_documents
from tracewright.llm.token_output import best_fit_decreasing, packed_rows, position_type, segments, write_packed
from tracewright.llm.tokens import DEFAULT_TOKENIZER, Known, drops_spaces, encoder, keeps_letters

lengths_ = st.lists(st.integers(1, 64), max_size=120)


@given(lengths_)
@settings(max_examples=150, deadline=None)
def test_matching_fills_without_gaps(lengths):
    sequence, offset = match_and_fit(lengths, 64)
    held = defaultdict(list)
    for n, s, o in zip(lengths, sequence, offset, strict=True):
        held[s].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
        assert sum(3 * n > 64 for _, n in parts) <= 2
    assert sorted(held) == list(range(len(held)))


@given(lengths_)
@settings(max_examples=150, deadline=None)
def test_segment_tree_packs_as_a_plain_search_does(lengths):
    free, plain = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [f for f in free if f >= lengths[i]]
        at = free.index(min(fits)) if fits else len(free)
        free[at:] = free[at:] or [64]
        free[at] -= lengths[i]
        plain.append(at)
    packed = best_fit_decreasing(lengths, 64)
    assert sorted(i for p in packed for i in p) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in p) <= 64 for p in packed)
    assert len(packed) == len(free)


def test_matching_is_close_to_the_bound():
    draw = random.Random(5)
    lengths = [draw.choice([draw.randint(1, 100), draw.randint(100, 1400)]) for _ in range(4096)]
    used = len({*match_and_fit(lengths, 2048)[0]})
    assert used <= 1.01 * -(-sum(lengths) // 2048) + 1


@pytest.fixture(scope="module")
def rows(odd_rows):
    return odd_rows + [(100 + i, prose(i, 20 + 31 * i)) for i in range(40)]


def plain_ids(text):
    found = encoder(DEFAULT_TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*found, 0], dtype="<u4")


def test_ids_equal_the_tokenizers_own(rows):
    for _, text in rows:
        assert encoder(DEFAULT_TOKENIZER).ids(text or "") == plain_ids(text)[:-1].tobytes()
    for text in ("J\u030c A.B,C 3,4.5 it's I'M", "Σ ΑΣ x\x01y \x01", "<|endoftext|> a", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|StartOfText|>,", "a <|EndOfText|> b", "x<|endoftext|>y", "%%,. d.,e ?!, x,\u0301 É,é."):
        assert encoder(DEFAULT_TOKENIZER).ids(text) == plain_ids(text)[:-1].tobytes()


def test_which_tokenizers_go_word_by_word():
    import public_tokenizers

    assert encoder(DEFAULT_TOKENIZER).by_word and not encoder("byte_bpe_50k.json").by_word
    definition = json.load(open(public_tokenizers.path(DEFAULT_TOKENIZER)))
    assert drops_spaces(definition)
    definition["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r" ?\p{L}+|\s+"
    assert not drops_spaces(definition)
    definition["pre_tokenizer"] = None
    assert not drops_spaces(definition)


def test_random_texts_with_added_tokens():
    draw = random.Random(12)
    letters = "aAbZ09 .,'\t\n\x1c\x85\xa0\u0301é日ßİ<|>"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 20)))
        text += draw.choice(["", "<|EndOfText|>", "<|startoftext|>", "<|endoftext"]) + text[:3]
        assert encoder(DEFAULT_TOKENIZER).ids(text) == plain_ids(text)[:-1].tobytes()


def test_letters_and_punctuation_after_them_go_past_the_tokenizers_other_steps(monkeypatch):
    chosen = encoder(DEFAULT_TOKENIZER)
    assert chosen.direct and not encoder("byte_bpe_50k.json").direct
    draw = random.Random(3)
    words = ["".join(draw.choice("abcxyzABCéßñÖŉǅ") for _ in range(draw.randint(1, 12))) for _ in range(2000)]
    marks = ["", ",", "%%%", "?!,", "'", "...", ")", "_", "<", "\\"]
    seen = []
    whole = chosen.whole
    monkeypatch.setattr(chosen, "whole", lambda texts: seen.extend(texts) or whole(texts))
    text = " ".join(w + draw.choice(marks) for w in words)
    assert chosen.ids(text) == plain_ids(text)[:-1].tobytes()
    assert set(seen) <= set(marks)
    text = " ".join(w + draw.choice(["'s", "'", "\u0301,", "\u0338", "1,", "日.", "İ.", ",a", "’,"]) for w in words)
    assert chosen.ids(text) == plain_ids(text)[:-1].tobytes()


def test_forgotten_words_are_learned_again():
    asked = []
    known = Known(lambda w: asked.append(w) or w.upper(), {})
    assert [known[w] for w in (b"a", b"b", b"a")] == [b"A", b"B", b"A"]
    later = Known(known.learn, known)
    assert later[b"a"] == b"A" and len(later) == 1 and asked == [b"a", b"b"]
    last = Known(known.learn, later)  # b was not met meanwhile
    assert (last[b"a"], last[b"b"], asked) == (b"A", b"B", [b"a", b"b", b"b"])


def test_letters_are_kept_by_some_pre_tokenizers_only():
    import public_tokenizers

    definition = json.load(open(public_tokenizers.path(DEFAULT_TOKENIZER)))
    assert keeps_letters(definition)
    first = definition["pre_tokenizer"]["pretokenizers"][0]
    for pattern in (r"[\p{L}]{1,40}|[\p{N}]|[^\s\p{L}\p{N}]+", r"[\p{L}]+,?|[\p{N}]|[^\s\p{L}\p{N}]+", r"[\p{L}_]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
        first["pattern"]["Regex"] = pattern
        assert drops_spaces(definition) and not keeps_letters(definition)


def check(found, rows, capacity):
    whole = defaultdict(list)
    for doc_id, text in rows:
        whole[doc_id].append(plain_ids(text))
    pieces = {(i, p): ids[p * capacity : (p + 1) * capacity] for i, each in whole.items() for ids in each for p in range(-(-len(ids) // capacity))}
    assert len(found) == sum(-(-len(ids) // capacity) for each in whole.values() for ids in each)
    at = defaultdict(list)
    for r in found:
        at[r.sequence_id].append((r.offset, r.length))
        if len({x.tobytes() for x in whole[r.doc_id]}) == 1:
            assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(pieces[r.doc_id, r.piece]), zlib.crc32(pieces[r.doc_id, r.piece].tobytes()))
    for parts in at.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity


def test_documents_are_packed_whole(make_docs, rows):
    check(pack_documents(make_docs(rows), capacity=256).collect(), rows, 256)
    assert pack_documents(make_docs(rows).limit(0)).count() == 0


def test_binary_table_round_trips(make_docs, rows, tmp_path):
    packed = write_packed(make_docs(rows), f"file://{tmp_path}/packed", capacity=256)
    check(segments(packed).collect(), rows, 256)
    for r in packed.collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, position_type(256))
        assert len(ids) == len(positions) == 256 and not ids[r.cu_seqlens[-1] :].any()
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert (positions[a:b] == np.arange(b - a)).all()
    assert packed.select("sequence").distinct().count() == packed.count()
    assert packed_rows(make_docs(rows).limit(0)).count() == 0
