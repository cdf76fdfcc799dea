"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end a valid encoding of that
prefix, so the whole encoding is a chain of those last tokens. ``last[i]`` depends on the bytes
before ``i`` alone: appending bytes only appends entries, cutting a piece only drops entries, and
after an edit the entries agree with the old ones again (shifted) a token's length behind it.

A token may follow another when merging their joint bytes would never join across the seam. That
is decided by replaying how the right edge of the one and the left edge of the other were formed,
in rank order, and asking at each step whether the edge tokens would have merged first.

The tokens that end at a byte are found by an automaton over all tokens (Aho and Corasick): its
state names the longest of them, and each token names the next shorter one that ends it.

Defined results
* null text encodes as the empty text: no ids, empty decoded bytes;
* a piece that is itself in the vocabulary is that one token, as the reference library has it;
* special tokens are ordinary text; long texts and long pieces are encoded whole;
* only id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .arrow import batch_of, give_back, pieces

CACHE_BYTES = 96 << 20  # of pieces that a task has encoded, with what Python needs for each
CACHE_PAIRS = 400_000
CACHE_STEPS = 100_000
PIECE_COST = 220
BATCH_BYTES = 1 << 20
LONG_PIECE = 64
#: How far beyond a match the pattern may look, apart from a run of white space that follows it.
LOOK = 8


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def plain_merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Textbook BPE: join the leftmost pair of lowest rank (under ``below``) until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """Ranks with, for each token, how its two edges come about."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: halves[t]: the two tokens whose merge is t; None for single bytes and tokens that merging never makes.
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        for token, rank in ranks.items():
            parts = plain_merge(token, ranks, rank) if len(token) > 1 else []
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        self._right: dict[bytes, list[tuple[int, bytes]]] = {}
        self._left: dict[bytes, list[tuple[int, bytes]]] = {}
        #: pair of ids -> whether the second may follow the first; emptied when full.
        self.follows: dict[int, bool] = {}
        self._made: dict[bytes, bool] = {}
        self.size = {r: len(t) for t, r in ranks.items()}
        #: decimal id -> the token's bytes
        self.named = {str(r): t for t, r in ranks.items()}
        self._grow()

    def _grow(self) -> None:
        """The automaton of the tokens that merging makes: only those are ever the last of a prefix.

        A state stands for the longest end of the bytes so far that begins a token.
        """
        #: state and byte -> next state: the tokens' own steps, and as many others as are kept.
        self.steps: dict[int, int] = {}
        #: state -> the longest token that ends there (-1: none); token -> the longest other token that ends it.
        self.ending, self.shorter = [-1], {}
        level = [(0, t, r) for t, r in self.ranks.items() if self.made(t)]
        self._fall, self._most_steps, at = [0], 0, 0
        while level:  # all states of one length, then those of the next: what a state falls back to is known before it
            deeper = []
            for state, token, rank in level:
                key = state << 8 | token[at]
                after = self.steps.get(key)
                if after is None:
                    fall = self.step(self._fall[state], token[at]) if state else 0
                    after = self.steps[key] = len(self.ending)
                    self._fall.append(fall)
                    self.ending.append(self.ending[fall])
                if at + 1 < len(token):
                    deeper.append((after, token, rank))
                else:
                    self.shorter[rank] = self.ending[self._fall[after]]
                    self.ending[after] = rank
            level, at = deeper, at + 1
        self._most_steps = len(self.steps) + CACHE_STEPS

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte; kept as long as there is room."""
        fallen = state
        while (after := self.steps.get(fallen << 8 | byte)) is None and fallen:
            fallen = self._fall[fallen]
        after = after or 0
        if len(self.steps) < self._most_steps:
            self.steps[state << 8 | byte] = after
        return after

    def made(self, token: bytes) -> bool:
        """Whether merging the token's bytes gives that token."""
        found = self._made.get(token)
        if found is None:
            halves = self.halves[token]
            found = len(token) == 1 or (halves is not None and self.made(halves[0]) and self.made(halves[1]))
            self._made[token] = found
        return found

    def _edge(self, token: bytes, side: int) -> list[tuple[int, bytes]]:
        """The tokens at one edge as merging proceeds: (rank at which it forms, token), first the single byte."""
        known = self._left if side == 0 else self._right
        found = known.get(token)
        if found is None:
            halves = self.halves[token]
            found = [(-1, token)] if halves is None else [*self._edge(halves[side], side), (self.ranks[token], token)]
            known[token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens ``a`` and ``b``, both made by merging, gives [a, b]."""
        pair = a << 32 | b
        found = self.follows.get(pair)
        if found is None:
            if len(self.follows) > CACHE_PAIRS:
                self.follows.clear()
            found = self.follows[pair] = self._seam(self._edge(self.bytes_of[a], 1), self._edge(self.bytes_of[b], 0))
        return found

    def _seam(self, left: list[tuple[int, bytes]], right: list[tuple[int, bytes]]) -> bool:
        i = j = 0
        never = len(self.ranks) + (1 << 32)
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else never
            next_right = right[j + 1][0] if j + 1 < len(right) else never
            across = self.ranks.get(left[i][1] + right[j][1], never)
            # Of equal ranks the leftmost goes first: the left token's own merge, then the seam, then the right one's.
            if across < next_left and across <= next_right:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            if next_right <= next_left:
                j += 1


class PrefixTable:
    """The bytes of one piece and, for each of their prefixes, the id of its last token (-1 for the empty one) and the automaton's state."""

    def __init__(self, vocab: Vocabulary, piece: bytes = b""):
        self.vocab, self.data, self.last, self.states = vocab, b"", [-1], [0]
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self._extend(start + 1, len(self.data) + 1)

    def _extend(self, first: int, stop: int) -> None:
        """Entries ``first`` to ``stop``: of the tokens that end there exactly one may follow what stands before it."""
        data, last, states, vocab = self.data, self.last, self.states, self.vocab
        step, follows, ending, shorter, size = vocab.steps.get, vocab.follows.get, vocab.ending, vocab.shorter, vocab.size
        state = states[first - 1]
        for end in range(first, stop):
            byte = data[end - 1]
            after = step(state << 8 | byte)
            state = vocab.step(state, byte) if after is None else after
            token = ending[state]
            while token >= 0:
                start = end - size[token]
                if not start:
                    break
                ok = follows(last[start] << 32 | token)
                if ok or (ok is None and vocab.fits(last[start], token)):
                    break
                token = shorter[token]
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(token)
            states.append(state)

    def cut(self, length: int) -> None:
        self.data = self.data[:length]
        del self.last[length + 1 :], self.states[length + 1 :]

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes ``start:stop``; returns how many entries had to be found anew."""
        tail, old, old_states = self.data[stop:], self.last[stop + 1 :], self.states[stop + 1 :]
        self.cut(start)
        self.append(new)
        work, agree, shift, longest = len(new), 0, len(self.data), self.vocab.longest
        self.data += tail
        for k in range(len(tail)):
            self._extend(shift + k + 1, shift + k + 2)
            token = self.last[-1]
            work += 1
            agree = agree + 1 if token == old[k] and len(self.vocab.bytes_of[token]) <= k + 1 else 0
            if agree >= longest:  # each later entry reads only entries that agree
                self.last.extend(old[k + 1 :])
                self.states.extend(old_states[k + 1 :])
                break
        return work

    def ids(self) -> list[int]:
        out, at, last, size = [], len(self.data), self.last, self.vocab.size
        while at:
            token = last[at]
            out.append(token)
            at -= size[token]
        return out[::-1]

    def tokens(self) -> list[bytes]:
        return [self.vocab.bytes_of[t] for t in self.ids()]


class Encoder:
    """Texts to ids and back; each match of the pattern is encoded on its own."""

    def __init__(self, ranks: dict[bytes, int] | Vocabulary, pattern: str):
        self.vocab = ranks if isinstance(ranks, Vocabulary) else Vocabulary(ranks)
        self.matches = regex.compile(pattern).finditer
        self.pieces = regex.compile(pattern).findall
        #: piece -> ids joined by commas; emptied when full and at the end of a task.
        self._known: dict[str, str] = {}
        self._held = 0

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.vocab.ranks
        if piece in ranks:
            return [ranks[piece]]
        return PrefixTable(self.vocab, piece).ids()

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode new pieces in byte order, so that each takes over the entries of the prefix it shares with the one before."""
        known, ranks = self._known, self.vocab.ranks
        if self._held >= CACHE_BYTES:
            known.clear()
            self._held = 0
        table = PrefixTable(self.vocab)
        for piece in sorted(pieces):  # code points sort as their bytes do
            data = piece.encode("utf-8", "surrogatepass")
            rank = ranks.get(data)
            self._held += 2 * len(data) + PIECE_COST
            if rank is not None:
                known[piece] = str(rank)
                continue
            same, before, most = 0, table.data, min(len(table.data), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            table.cut(same)
            table.append(data[same:])
            known[piece] = ids = ",".join(map(str, table.ids()))
            self._held += len(ids)

    def forget(self) -> None:
        """Empty what encoding has gathered; the vocabulary's own tables stay."""
        self._known.clear()
        self.vocab.follows.clear()
        self._held = 0

    def joined_batch(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas; long pieces are encoded where they stand."""
        lists = [self.pieces(t) for t in texts]
        self.learn({p for p in set().union(*lists).difference(self._known) if len(p) <= LONG_PIECE})
        known = self._known
        out = []
        for found in lists:
            try:
                out.append(",".join(map(known.__getitem__, found)))
            except KeyError:  # a long piece, or one that emptying the cache took away
                out.append(",".join(known.get(p) or ",".join(map(str, self.encode_piece(p.encode("utf-8", "surrogatepass")))) for p in found))
        return out

    def joined(self, text: str) -> str:
        return self.joined_batch([text])[0]

    def encode(self, text: str) -> list[int]:
        joined = self.joined(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.bytes_of.__getitem__, ids))

    def decode_joined(self, joined: str) -> bytes:
        """The bytes of decimal ids joined by commas."""
        return b"".join(map(self.vocab.named.__getitem__, joined.split(","))) if joined else b""


class EncodedText:
    """A text kept encoded while it is appended to or edited: only text near the edit is split and encoded again.

    Splitting starts at the last piece that the edit cannot have changed: one that ends more than
    ``LOOK`` characters, beyond any white space behind it, before the edit. It stops where a piece
    begins at which the old text had one, since patterns do not look back.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, text
        found = [(m.start(), m[0]) for m in encoder.matches(text)]
        self.starts, self.pieces = [a for a, _ in found], [p for _, p in found]
        self.ids = [encoder.encode_piece(p.encode("utf-8", "surrogatepass")) for p in self.pieces]

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters ``start:stop``; returns the number of pieces encoded again."""
        at = max(0, start - LOOK)
        while at and self.text[at - 1].isspace():
            at -= 1
        first = max(0, bisect.bisect_left(self.starts, at) - 1)  # pieces before it end at or before ``at``
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        begin = self.starts[first] if first < len(self.starts) else 0
        starts, pieces, last = [], [], len(self.starts)
        for m in self.encoder.matches(self.text, begin):
            old = m.start() - shift
            if old >= stop:
                k = bisect.bisect_left(self.starts, old)
                if k < len(self.starts) and self.starts[k] == old:
                    last = k
                    break
            starts.append(m.start())
            pieces.append(m[0])
        self.ids[first:last] = [self.encoder.encode_piece(p.encode("utf-8", "surrogatepass")) for p in pieces]
        self.pieces[first:last] = pieces
        self.starts[first:] = starts + [a + shift for a in self.starts[last:]]
        return len(pieces)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def all_ids(self) -> list[int]:
        return [i for ids in self.ids for i in ids]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder_for(path: str, pattern: str) -> Encoder:
    """The process's encoder for a vocabulary file; executors read the file that their own installation has."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int) and decoded (binary)."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
        ddl += ", ids array<int>, decoded binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary, pattern)
        try:
            for batch in pieces(batches, 1, BATCH_BYTES):
                rows, size = [], 0
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, joined in zip(batch.column(0).to_pylist(), encoder.joined_batch(texts), strict=True):
                    decoded = encoder.decode_joined(joined)
                    row = [doc_id, joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    if with_ids:
                        row += [list(map(int, joined.split(","))) if joined else [], decoded]
                        size += len(decoded)
                    rows.append(row)
                    if size > 16 << 20:
                        yield batch_of(schema, list(zip(*rows, strict=True)))
                        rows, size = [], 0
                if rows:
                    yield batch_of(schema, list(zip(*rows, strict=True)))
        finally:
            encoder.forget()  # a reused worker keeps the vocabulary only
            give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tables import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
