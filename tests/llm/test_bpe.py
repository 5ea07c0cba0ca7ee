import random
import struct
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import bpe
from passagework.llm.common import tokenizer_path

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(NAME))


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_gadgets_by_hand():
    """a b ab aba over the merges (a, b), (ab, a): what BPE does left to right, and nothing else, is accepted."""
    machine = bpe.BpeAutomaton({0: b"a", 1: b"b", 2: b"ab", 3: b"aba"}, [(0, 1, 2), (2, 0, 3)], {0, 1})
    assert machine.encode_word(b"ababa") == [2, 3]
    assert machine.encode_word(b"aab") == [0, 2]
    assert machine.step(machine.step(0, 0), 1) == bpe.DEAD
    same = bpe.BpeAutomaton({0: b"a", 1: b"aa"}, [(0, 0, 1)], {0})
    assert same.encode_word(b"aaaaa") == [1, 1, 0]
    with pytest.raises(ValueError):
        same.encode_word(b"ab")


def naive(word, merges):
    """Textbook BPE: the earliest merge first, from the left, until none applies."""
    out = list(word)
    while True:
        pairs = [(merges.index((a, b)), k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)) if (a, b) in merges]
        if not pairs:
            return out
        first = min(pairs)[0]
        k = 0
        while k < len(out) - 1:
            if (out[k], out[k + 1]) == merges[first]:
                out[k : k + 2] = [out[k] + out[k + 1]]
            k += 1


def test_merges_that_never_apply():
    """With (a, b), (b, c), (a, bc) the pair (a, bc) never stands in a text, as ab is made first."""
    machine = bpe.BpeAutomaton({0: b"a", 1: b"b", 2: b"c", 3: b"ab", 4: b"bc", 5: b"abc"}, [(0, 1, 3), (1, 2, 4), (0, 4, 5)], {0, 1, 2})
    assert machine.encode_word(b"abc") == [3, 2] and machine.encode_word(b"bcabc") == [4, 3, 2]
    twice = bpe.BpeAutomaton({0: b"a", 1: b"aa", 2: b"aaa"}, [(0, 0, 1), (0, 1, 2), (1, 0, 2)], {0})
    assert twice.encode_word(b"aaaa") == [1, 1] and twice.encode_word(b"aaa") == [2]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_any_merge_list(data):
    """Lists in any order, with merges that never apply, against textbook BPE."""
    tokens, merges = [b"a", b"b", b"c"], []
    for _ in range(data.draw(st.integers(1, 7))):
        u, v = data.draw(st.sampled_from(tokens)), data.draw(st.sampled_from(tokens))
        if (u, v) not in merges:
            merges.append((u, v))  # perhaps another way to a token that there is
            tokens += [u + v] if u + v not in tokens else []
    place = {t: i for i, t in enumerate(tokens)}
    machine = bpe.BpeAutomaton({i: t for t, i in place.items()}, [(place[u], place[v], place[u + v]) for u, v in merges], {0, 1, 2})
    word = data.draw(st.text("abc", min_size=1, max_size=14)).encode()
    assert [tokens[i] for i in machine.encode_word(word)] == naive([bytes([b]) for b in word], merges)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab etn.,'’ \n\t\x1c\x85　 é́1½²漢😀"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_same_as_library(library, text):
    own = bpe.load(NAME)
    assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == text


def test_words_and_specials(library):
    own = bpe.load(NAME)
    for text in ("it's  the end.\n\nI'll <|endoftext|>go <|endoftext|", "<|endoftext|><|endoftext|>", " . , x. y", "a" * 3000 + " " * 3000):
        assert ids(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_operator(odd, none, library):
    rows = bpe.decode(bpe.encode(odd)).collect()
    texts = [r["text"] for r in odd.collect()]
    assert sorted(r["text"] for r in rows) == sorted(t or "" for t in texts)
    assert sorted(ids(r["ids"]) for r in rows) == sorted(library.encode(t or "", add_special_tokens=False).ids for t in texts)
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_remembered_bytes():
    """However long the distinct pieces are, what a worker remembers is bounded in bytes, and the ids stay the same."""
    own, draw = bpe.ByteLevelBpe(tokenizer_path(NAME)), random.Random(1)
    words = ["".join(draw.choices("abcdefgh", k=5000)) for _ in range(100)]
    texts = [f"x {w} 1{w}  {w}." for w in words]
    first = [own.encode(t) for t in texts]
    memos = [m for own_memo in (own.pack, own.chunk_ids, own.after_space) for m in (own_memo, own_memo.old)]
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for m in memos for k, v in m.items()) < 1 << 20
    assert [own.encode(t) for t in texts] == first and all(own.decode(i) == t for i, t in zip(first, texts, strict=True))


def test_memo_turns_over():
    """Short strings too: older ones go when the room is full, and come back right."""
    memo = bpe.IdsMemo(lambda k: k.encode() * 3, 100_000)
    for _ in range(2):
        for i in range(5000):
            assert memo[f"w{i}"] == f"w{i}".encode() * 3
            assert memo.held <= 50_000
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for m in (memo, memo.old) for k, v in m.items()) <= 100_000


def test_one_worker_a_task(spark, tmp_path, odd, none, library):
    """The query encodes and decodes in one Python worker; the rows are those of ``decode`` after ``encode``."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = bpe.op1_bpe(spark, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    key = lambda r: (r["doc_id"] or -1, r["text"])
    assert sorted(bpe.round_trip(odd).collect(), key=key) == sorted(bpe.decode(bpe.encode(odd)).collect(), key=key)
    assert bpe.round_trip(none).count() == 0
