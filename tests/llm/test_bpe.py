import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from blockatlas.llm import bpe

from .frames import HOSTILE, docs

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder_for(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocab.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab e\n'sé中0", max_size=120))
def test_as_the_library(encoder, library, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60))
def test_pieces_as_plain_merging(encoder, data):
    got = bpe.PrefixTable(encoder.vocab, data).tokens()
    assert got == bpe.plain_merge(data, encoder.vocab.ranks)


def test_long_pieces(encoder, library):
    for text in ("a" * 5000, " " * 3000 + "x", "é" * 2000):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_appends_and_edits_are_exact(encoder):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abcdeinrst") for _ in range(400))
    t = bpe.PrefixTable(encoder.vocab, data[:100])
    t.append(data[100:])
    assert t.last == bpe.PrefixTable(encoder.vocab, data).last
    work = []
    for _ in range(40):
        a = rng.randrange(len(t.data))
        b, new = min(len(t.data), a + rng.randrange(6)), bytes(rng.choice(b"aeinst") for _ in range(rng.randrange(6)))
        want = t.data[:a] + new + t.data[b:]
        work.append(t.edit(a, b, new))
        assert t.data == want and t.last == bpe.PrefixTable(encoder.vocab, want).last
    assert sum(work) / len(work) < 150  # not the whole tail


def test_edited_text(encoder):
    t = bpe.EncodedText(encoder, "one two three four " * 50)
    assert t.edit(100, 103, "Four hundred") < 10 and t.append("end!") < 5
    assert t.all_ids() == encoder.encode(t.text)


def test_hostile_rows(spark, library):
    rows = HOSTILE + [(10, "<|endoftext|> x", "s")]
    got = bpe.encode_documents(docs(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r, (i, text, _) in zip(got, rows):
        ids = library.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids, bytes(r.decoded)) == (i, len(ids), ids, (text or "").encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, rows).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_on_every_document(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op7_byte_bpe(spark, sf_dir).collect():
        assert r.n_tokens == len(library.encode_ordinary(texts[r.doc_id]))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab e\n'sé中0 \tl", max_size=60), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), st.text(alphabet="ab \n'sé0l", max_size=5)), max_size=6))
def test_edits_anywhere_split_as_from_the_start(encoder, text, edits):
    t = bpe.EncodedText(encoder, text)
    for at, n, new in edits:
        at = min(at, len(t.text))
        t.edit(at, min(len(t.text), at + n), new)
        assert t.pieces == encoder.pieces(t.text) and t.starts == [m.start() for m in encoder.matches(t.text)]
    assert t.all_ids() == encoder.encode(t.text)


def test_tasks_forget_their_pieces(encoder):
    encoder.joined("some words of a task")
    assert encoder._known and encoder._held
    encoder.forget()
    assert not encoder._known and not encoder.vocab.follows and not encoder._held


def test_work_per_byte_does_not_grow_with_the_place(encoder):
    """each byte of a piece looks at the few tokens that end there, not at every start before it."""
    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"aeinorst") for _ in range(60)) for _ in range(100)]
    lines = 0

    def count(frame, event, _):
        nonlocal lines
        if frame.f_code is not bpe.PrefixTable._extend.__code__:
            return None
        lines += event == "line"
        return count

    for piece in pieces:
        bpe.PrefixTable(encoder.vocab, piece)  # what pairs and steps cost the first time is not counted
    was = sys.gettrace()
    sys.settrace(count)
    try:
        for piece in pieces:
            bpe.PrefixTable(encoder.vocab, piece)
    finally:
        sys.settrace(was)
    assert lines / sum(map(len, pieces)) < 30


@pytest.mark.parametrize("kept", [0, 1000])
def test_automaton_names_every_token_that_ends_at_a_byte(encoder, monkeypatch, kept):
    monkeypatch.setattr(bpe, "CACHE_STEPS", kept)  # steps that find no room are found anew
    vocab = bpe.Vocabulary(encoder.vocab.ranks)
    own = len(vocab.steps)
    rng = random.Random(4)
    words = [t for t in vocab.ranks if len(t) > 3]
    for _ in range(60):
        data = b"".join(rng.choice(words)[: rng.randrange(1, 12)] for _ in range(8))
        table = bpe.PrefixTable(vocab, data)
        assert table.tokens() == bpe.plain_merge(data, vocab.ranks)
        for end in range(1, len(data) + 1):
            found, token = [], vocab.ending[table.states[end]]
            while token >= 0:
                found.append(token)
                token = vocab.shorter[token]
            ends = [data[start:end] for start in range(max(0, end - vocab.longest), end)]
            assert found == [vocab.ranks[t] for t in ends if t in vocab.ranks and vocab.made(t)]
    assert len(vocab.steps) <= own + kept


def test_a_token_that_merging_never_makes_is_only_a_whole_piece():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abcd": 70_000, b"bc": 400}  # sparse ids; "abcd" has no halves
    encoder = bpe.Encoder(ranks, r"\w+|\W")
    assert encoder.joined("abcd abcde bcab") == "70000,32,300,99,100,101,32,400,300"
    assert encoder.decode_joined("70000,32,300") == b"abcd ab" and encoder.decode_joined("") == b""


def test_a_byte_missing_from_the_vocabulary():
    with pytest.raises(ValueError, match="missing"):
        bpe.PrefixTable(bpe.Vocabulary({b"a": 0, b"b": 1, b"ab": 2}), b"abxab")


def test_edits_keep_the_states(encoder):
    rng = random.Random(5)
    t = bpe.PrefixTable(encoder.vocab, bytes(rng.choice(b"abcdeinrst") for _ in range(300)))
    for _ in range(40):
        a = rng.randrange(len(t.data))
        t.edit(a, min(len(t.data), a + rng.randrange(6)), bytes(rng.choice(b"aeinst") for _ in range(rng.randrange(6))))
        assert t.states == bpe.PrefixTable(encoder.vocab, t.data).states
