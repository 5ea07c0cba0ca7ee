import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import packing
from passagework.llm.common import tokenizer_path

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(NAME))


@pytest.fixture(scope="module")
def encoder():
    return packing.ChunkEncoder(tokenizer_path(NAME))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab Etn.,'’ \n\t\x1c\x85　 ÉéΣσİ́½²漢😀_"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_same_as_library(library, encoder, text):
    packed = encoder.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_plans_hold_everything(histogram):
    planned = packing.plan(histogram, 64)
    there = {}
    for pattern, n in planned.items():
        assert sum(pattern) <= 64 and n > 0
        for x in pattern:
            there[x] = there.get(x, 0) + n
    assert there == histogram
    tokens = sum(k * n for k, n in histogram.items())
    assert sum(planned.values()) <= 2 * -(-tokens // 64) + 1


def test_exact_fill_is_found():
    assert sum(packing.plan({1000: 500, 600: 500, 448: 500}).values()) == 500
    assert sum(packing.plan({1024: 7}).values()) == 4
    assert sum(packing.plan({2048: 3, 1: 2048}).values()) == 4


def test_operator(odd, none, library):
    rows = packing.pack(odd).collect()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(library.encode(r["text"] or "", add_special_tokens=False).ids + [0])
    want = sorted((d if d is not None else -1, k, 2048 * k, len(ids[2048 * k : 2048 * (k + 1)]), zlib.crc32(struct.pack(f"<{len(ids[2048 * k : 2048 * (k + 1)])}I", *ids[2048 * k : 2048 * (k + 1)]))) for d, all_ids in texts.items() for ids in all_ids for k in range(-(-len(ids) // 2048)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack(none).count() == 0
