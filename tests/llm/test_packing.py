import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultlens.llm import packing

from .helpers import frame, rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_tree_equals_plain_first_fit_decreasing(lengths):
    at, offset = packing.first_fit_decreasing(np.array(lengths, np.int64), 20)
    room, expected = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), None)
        if b is None:
            b = len(room)
            room.append(20)
        expected[i] = (b, 20 - room[b])
        room[b] -= lengths[i]
    assert [(int(a), int(o)) for a, o in zip(at, offset, strict=True)] == [expected[i] for i in range(len(lengths))]


@pytest.mark.parametrize("text", ["", "a b", "<|endoftext|> x", " \n\n  \t x" * 50, "é" * 3000, "w" * 5000, "don't 12345 £%… 𝒳", " " * 300 + "x", "   y"])
def test_the_fast_twin_gives_the_tokenizers_ids(text):
    e = packing.encoder(*packing.public())
    assert e(text).tolist() == e.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a b<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|>\n b", "<|endoftext", "<|ENDOFTEXT|>", "a b"])
def test_ids_are_those_of_the_tokenizer_as_it_is(text):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(packing.public()[0])
    ids = packing.encoder(*packing.public())(text).tolist()
    assert ids == plain.encode(text, add_special_tokens=False).ids
    assert ids.count(plain.token_to_id("<|endoftext|>")) == text.count("<|endoftext|>")


def test_round_trip(spark):
    data = rows()
    out = packing.pack(frame(spark), length=256, group_docs=16).collect()
    e = packing.encoder(*packing.public())
    ids = defaultdict(list)
    for i, t, *_ in data:
        ids[i].append([*e(t or "").tolist(), 1])
    for i, mine in ids.items():
        own = sorted(r for r in ((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out if r["doc_id"] == i))
        expected = sorted((lo, len(x[lo : lo + 256]), zlib.crc32(np.array(x[lo : lo + 256], "<u4").tobytes()), len(x)) for x in mine for lo in range(0, len(x), 256))
        assert own == expected
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r["length"] for r in out)
    assert len(bins) * 256 < total * 1.1
    assert packing.pack(frame(spark, [])).collect() == []
