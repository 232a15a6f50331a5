import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm.pieces import Vocabulary, cuts, decode, encode, transfer

VOCAB = Vocabulary.load()
SCHEMA = "doc_id long, text string, key long, chunk string"


def brute(text):
    """Best path over the whole text at once, trying every substring as a piece; of equal scores the longest last piece."""
    if not text:
        return []
    s = " " + text
    best, back = [0] + [None] * len(s), [0] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - VOCAB.longest), j):
            p = s[i:j]
            add = VOCAB.scores.get(p, VOCAB.byte_score * len(p.encode()) if len(p) == 1 else None)
            if add is not None and best[i] is not None and (best[j] is None or best[i] + add > best[j]):
                best[j], back[j] = best[i] + add, i
    out, j = [], len(s)
    while j:
        p = s[back[j] : j]
        out = ([VOCAB.ids[p]] if p in VOCAB.ids else [VOCAB.byte_ids[b] for b in p.encode()]) + out
        j = back[j]
    return out


TEXT = st.text(alphabet="ab the\n▁éß漢<s>0x41-=/", max_size=80) | st.text(max_size=40)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_equals_the_best_path_and_round_trips(text):
    ids = np.frombuffer(VOCAB.plain([" " + text if text else ""])[0], np.int32)
    assert ids.tolist() == brute(text)
    assert VOCAB.decode(ids) == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aabch the\n=", min_size=150, max_size=400))
def test_matrices_compose(text):
    s = " " + text
    at = cuts(s, 40, 3, VOCAB.longest)
    k = VOCAB.longest
    one = transfer(VOCAB, s, len(s), False)
    two = None
    for a, b in zip(at, at[1:], strict=False):
        m = transfer(VOCAB, s[a : b + k], b - a, False)
        two = m if two is None else np.maximum((two[:, :, None] + m[None]).max(1), -(1 << 60))
    assert two[0, 0] == one[0, 0]


def test_giants_equal_whole_texts(spark):
    rnd = np.random.default_rng(1)
    rows = ["".join(rnd.choice(list("aabcdehst  \n=é漢"), n)) for n in (900, 3000, 501)] + ["".join(rnd.choice(list("aabcdehst="), n)) for n in (700, 2500)]
    rows += ["=" * 1300, "a" * 999, " " * 800, "word " * 300, "\n" * 600, None, "", "short", "short", "▁ x <s>"]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(rows)], SCHEMA)
    got = decode(encode(df, chunk=120, seek=9, fan=3)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == rows[r.doc_id] and r.decoded == r.text and r.key == 5
        assert r.tokens == (None if r.text is None else brute(r.text))


def test_empty_table_and_other_sizes(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert decode(encode(df)).count() == 0
    t = "the quick brown fox " * 5000
    one = spark.createDataFrame([(1, t, 1, "")], SCHEMA)
    a, b = (encode(one, chunk=c).first().tokens for c in (1000, 1 << 20))
    assert a == b and len(a) < len(t)
    with pytest.raises(Exception):  # noqa: B017  no such model
        Vocabulary.load("/nowhere.model")


def test_many_segments_at_once_equal_one_at_a_time():
    rnd = np.random.default_rng(3)
    new = sorted({"".join(rnd.choice(list(" abcdehilnorst=é漢\u0001"), rnd.integers(1, 64))) for _ in range(3000)} | {"a", " ", "漢", "\n"}, key=len)
    fresh = Vocabulary.load()
    fresh.segments(new)
    for s in new[::7]:
        _, back = VOCAB.best(s)
        assert np.frombuffer(fresh.memo[s], np.int32).tolist() == VOCAB.cut(s, back, len(s))[0]


def test_a_giant_without_blanks_at_the_real_chunk_size(spark):
    rnd = np.random.default_rng(5)
    text = "".join(rnd.choice(list("abcdefghijklmnop=漢"), 200_000))
    one = spark.createDataFrame([(1, text, 1, "")], SCHEMA)
    got = decode(encode(one)).first()
    _, back = VOCAB.best(" " + text)
    assert got.decoded == text and got.tokens == VOCAB.cut(" " + text, back, len(text) + 1)[0]


def test_a_column_named_as_a_new_one_is_replaced(spark):
    df = spark.createDataFrame([("a b", 1, "x"), (None, 2, "y"), ("é" * 300, 3, "z")], "text string, tokens int, _ids string")
    got = encode(df, chunk=100, seek=9, verify="same").collect()
    assert [(r.text, r._ids, r.same, r.tokens is None) for r in sorted(got, key=lambda r: r._ids)] == [("a b", "x", True, False), (None, "y", True, True), ("é" * 300, "z", True, False)]
