import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from padlake.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS = bpe.transducer(PATH)
THEIRS = Tokenizer.from_file(PATH)


def same(text):
    ids = np.frombuffer(OURS.encode(text), np.int32).tolist()
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert OURS.decode(ids) == THEIRS.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "the", " guarantee", "ing", "'s", "  ", "\n\n ", "1234", "é", "日本", "🙂", "!!", "\x1c", "\x85", "​", "  "]), max_size=12))
def test_joints(parts):
    same("".join(parts))


def test_long_pieces_are_streamed():
    rng = np.random.default_rng(0)
    for alphabet in ("ab", "guaranteeing", "aeinrst"):
        text = "".join(rng.choice(list(alphabet), 9000))
        same(text)
        same(text[:2000] * 3 + " " * 3000 + "." * 2500)
    same("guaranteeing" * 1200)


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 64)
    same("one two  three\n\n four \t five.. " * 40 + "x" * 300 + " tail")


def _words(n, seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdeeeeinorstththe'éßñ日🙂0123 \n.,!")
    return ["".join(rng.choice(letters, k)) for k in rng.integers(1, 20, n)]


def test_pieces_side_by_side_are_as_one_by_one():
    pieces = [w.encode() for w in [*_words(3000, 1), "a", "é", "aaaa" * 16, "🙂" * 64, "guaranteeing", " the"]]
    assert OURS.merged_together(pieces) == [np.array(OURS.merged([OURS.base[b] for b in p]), np.int32).tobytes() for p in pieces]


def test_new_words_are_not_merged_one_by_one(monkeypatch):
    calls, t = [], bpe.Transducer(PATH)
    monkeypatch.setattr(t, "merged", lambda ids: calls.append(ids))
    text = " ".join(f"{w}" for w in _words(2000, 2))
    got = np.frombuffer(t.encode(text), np.int32).tolist()
    assert got == THEIRS.encode(text, add_special_tokens=False).ids and not calls


def test_texts_together_are_as_alone_whatever_is_remembered(monkeypatch):
    """Texts with added tokens, long pieces and none, dealt over several lookups, with a memory that overflows."""
    monkeypatch.setattr(bpe, "REMEMBERED", 600)
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    t, words = bpe.Transducer(PATH), _words(4000, 3)
    texts = [" ".join(words[k : k + 40 + k % 7]) + ("<|endoftext|>" + words[k]) * (k % 3) + "x" * (k % 200) for k in range(0, 4000, 40)]
    texts += ["", "a", *texts[:20]]
    got = t.encode_all(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [THEIRS.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(t.before) <= 300 and len(t) <= 300 + 500


def test_ids_of_nothing_are_an_error():
    for ids in ([-1], [5, len(OURS.widths)], [1 << 40]):
        with pytest.raises(IndexError):
            OURS.decode(ids)
    assert OURS.decode([]) == ""


def test_lookahead_is_a_bound():
    merges = [("a", "b"), ("b", "c"), ("ab", "c")]
    assert bpe.sufficient_lookahead(merges) >= 2
    assert OURS.lookahead < 1000


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "hello hello", "z"), (3, "hello hello", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert [r.token_ids for r in got] == [[], [], THEIRS.encode("hello hello").ids] + [THEIRS.encode("hello hello").ids]
    assert [r.decoded for r in got] == ["", "", "hello hello", "hello hello"]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("a text", 1, 2, 3)], "text string, __both long, token_ids long, `a.b` long")
    r = bpe.round_trip(df, PATH).first()
    assert r.decoded == "a text" and r["__both"] == 1 and r["a.b"] == 3 and len(r.token_ids) == 2
