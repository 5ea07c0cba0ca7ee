from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import quality


def brute(words, least):
    seen = Counter(tuple(words[i : i + least]) for i in range(len(words) - least + 1))
    covered = {k for i in range(len(words) - least + 1) if seen[tuple(words[i : i + least])] > 1 for k in range(i, i + least)}
    longest = 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            longest = max(longest, n)
    return len(covered), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=5), st.integers(1, 9))
def test_brute_force(texts, least):
    assert quality.repeats(texts, least) == [brute(t, least) for t in texts]


def test_rules():
    distinct = " ".join(f"w{i}" for i in range(40))
    line = " ".join(f"v{i}" for i in range(9))
    (n, chars, symbols, lines, covered, longest, failed, kept), short, null, twice = quality.measure([f"{distinct}\n{line} # <b>\n\n{line}\n{line}", "too short", None, f"{distinct} {distinct}"])
    assert (n, lines, longest, failed, symbols) == (69, 1, 9, True, 3) and covered == 27 and not kept
    assert short[6] and not short[7] and null == (0, 0, 0, 0, 0, 0, True, False)
    assert twice[4] == 80 and not twice[7]
    assert quality.measure([distinct])[0][7]


def test_each_limit_acts():
    """Texts that pass the base rules and that one limit of the method alone rejects."""
    own = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    part = own("p", 9)
    many = " ".join([f"{part} {own('x' + str(k), 29)}" for k in range(4)])  # 36 of 152 words covered by 9 at once
    covered = f"{part} {own('a', 24)} {part} {own('b', 24)} {part} {own('c', 15)}"  # 27 of 90
    once = f"{own('l', 31)} {own('y', 15)} {own('l', 31)}"  # the base rule rejects it too
    rows = quality.measure([many, covered, once])
    assert [(r[6], r[7]) for r in rows] == [(False, True), (False, False), (True, False)]
    assert 100 * rows[1][4] > 25 * rows[1][0] and rows[1][5] < quality.LONG_WORDS


def test_operator(odd, none):
    got = quality.repetition_rules(odd).collect()
    assert len(got) == odd.count() and all(r["kept"] is not None for r in got)
    long = next(r for r in got if r["doc_id"] == 6)
    assert (long["n_words"], long["n_repeat_words"], long["longest_repeat"], long["kept"]) == (3000, 3000, 2999, False)
    assert quality.keep_good(odd).columns == odd.columns and quality.repetition_rules(none).count() == 0
