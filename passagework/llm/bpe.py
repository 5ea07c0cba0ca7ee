"""BPE as a deterministic automaton over tokens.

``BpeAutomaton`` compiles a merge list by the merge-gadget construction: it
begins with one state that loops on every byte token.  The gadget of a merge
``(u, v) -> w`` makes one new state, a copy of the state behind ``u`` without
its arc ``v``, redirects the arcs ``u`` to it, and gives an arc ``w`` to every
state that has an arc ``u``.  A merge whose arc ``v`` is not there behind ``u``
never applies and gets no gadget.  After all merges the automaton accepts exactly
the token sequences that BPE produces, one for each byte string.

The construction keeps ``state behind u`` the same for all sources, so the
automaton is held as one target state per token, the token and time of each
state's gadget, and per token the arcs that its gadgets removed, with their
times.  Whether a state has an arc is looked up in a transition table that is
filled from those on first use.

Encoding follows arcs through a word, the longest first, and steps back where no
arc goes on; as one accepted sequence ends at each position, a position that led
nowhere is never tried again.  Decoding emits the arc labels.
"""

from __future__ import annotations

import json
import re
import struct
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, id_and_text, tokenizer_path

#: Fixed value: the public byte-level pre-tokenizer pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the code points with Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
DEAD = -1
#: Bounds of a worker's memory: arcs in the transition table (some 80 bytes each), bytes of remembered ids.
ARCS, AFTER_SPACE, PIECE, CHUNK = 500_000, 96 << 20, 16 << 20, 8 << 20
#: Rows whose ids and texts a worker holds at once.
SLICE = 64
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)


class BpeAutomaton:
    """See the module's text.  ``labels``: bytes of each token id; ``merges``: (left id, right id, made id) in order; ``atoms``: ids that no merge makes."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], atoms: set[int]):
        size = max(labels) + 1
        self.labels = [labels.get(i, b"") for i in range(size)]
        self.left, self.right = [DEAD] * size, [DEAD] * size
        self.made_at = [len(merges)] * size  # when the token became part of a longer one is kept by the longer one
        self.behind = [0] * size  # target state of a token's arcs
        self.owner, self.when = [DEAD], [DEAD]  # of each state, the token and the time of its gadget; state 0: the initial one
        self.gone: dict[int, dict[int, int]] = {}  # per token u, the arcs v that gadgets removed behind it, with their times

        def applies(u: int, v: int) -> bool:
            """Whether the state behind ``u`` has the arc ``v``; if not, the two are never neighbours and the merge never applies."""
            if any(x not in atoms and self.left[x] == DEAD for x in (u, v)):
                return False  # a token that no text has
            before = len(merges)
            while v != DEAD:
                when = self.removal(u, v, len(merges))
                if when is not None and when <= before:
                    return False
                before, v = self.made_at[v], self.left[v]
            return True

        for at, (u, v, w) in enumerate(merges):
            if not applies(u, v):
                continue
            if self.left[w] != DEAD or w in atoms:
                raise ValueError(f"token {w} is made twice; the automaton needs one way to make each token")
            self.left[w], self.right[w], self.made_at[w] = u, v, at
            self.gone.setdefault(u, {})[v] = at
            self.behind[w] = self.behind[v]
            self.owner.append(u)
            self.when.append(at)
            self.behind[u] = len(self.owner) - 1
        self.ids = {b: i for i, b in enumerate(self.labels) if b and (i in atoms or self.left[i] != DEAD)}
        self.reach: dict[bytes, int] = {}  # length of the longest token with these first four bytes; without them: three at most
        for b in self.ids:
            if len(b) > 3:
                self.reach[b[:4]] = max(len(b), self.reach.get(b[:4], 3))
        self.table: dict[int, int] = {}

    def removal(self, token: int, part: int, before: int) -> int | None:
        """When, earlier than ``before``, the arc ``part`` went from the state behind ``token``; the state began as that behind its right half."""
        while True:
            arcs = self.gone.get(token)
            when = arcs.get(part) if arcs else None
            if when is not None and when < before:
                return when
            if self.left[token] == DEAD:
                return None
            before, token = min(before, self.made_at[token]), self.right[token]

    def step(self, state: int, token: int) -> int:
        """Target of the arc, or DEAD: the arc is gone if a removal came before a longer arc could be copied from it."""
        key = state << 32 | token
        to = self.table.get(key)
        if to is None:
            to, owner, before, bound = self.behind[token], self.owner[state], self.when[state] + 1, None
            part = token if state else DEAD  # the initial state lost no arc
            while part != DEAD:
                at = self.removal(owner, part, before)
                if at is not None and (bound is None or at <= bound):
                    to = DEAD
                    break
                bound, part = self.made_at[part], self.left[part]
            if len(self.table) >= ARCS:
                self.table.clear()
            self.table[key] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        get, reach, table, n = self.ids.get, self.reach.get, self.table, len(word)
        token = get(word)
        if token is not None:
            return [token]  # the initial state lost no arc
        out, path, state, at, end, dead = [], [0], 0, 0, n, None
        while True:
            # the longest token from here on that has an arc and whose end is not known to lead nowhere
            limit = at + reach(word[at : at + 4], 3)
            if end > limit:
                end = limit
            while end > at:
                token = get(word[at:end])
                if token is not None and (dead is None or end not in dead):
                    to = table.get(state << 32 | token)
                    if to is None:
                        to = self.step(state, token)
                    if to >= 0:
                        break
                end -= 1
            if end > at:
                out.append(token)
                if end == n:
                    return out
                path.append(to)
                state, at, end = to, end, n
            else:
                if not out:
                    raise ValueError("the vocabulary has no token for a byte")
                dead = dead or set()
                dead.add(at)  # one accepted sequence ends at each position, so no other one leads here either
                path.pop()
                state = path[-1]
                end = at - 1
                at -= len(self.labels[out.pop()])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class IdsMemo(Memo):
    """A Memo from strings to packed ids that is bounded in bytes, however long the strings are; the longest are not kept."""

    def __init__(self, compute, room: int):
        super().__init__(compute)
        self.half, self.held = room // 2, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        size = sys.getsizeof(key) + sys.getsizeof(value) + 100  # with its place in the dict
        if size <= self.half >> 12:
            if self.held + size > self.half:
                self.old, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += size
        return value


class ByteLevelBpe:
    """A byte-level BPE file of the tokenizers library: added tokens, pre-split, automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or spec["normalizer"] or kind.get("add_prefix_space"):
            raise ValueError("not a byte-level BPE file without normalizer")
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: raw(s) for s, i in vocab.items() if s not in self.added} | {i: s.encode() for s, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = BpeAutomaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], {vocab[c] for c in alphabet if c in vocab})
        for s in self.added:
            self.automaton.ids.pop(s.encode(), None)
        self.pieces = regex.compile(PIECES)
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.other = re.compile(f"(?![ \\n])[{WHITE}]")
        self.pack = IdsMemo(self.piece, PIECE)
        self.chunk_ids = IdsMemo(self.chunk, CHUNK)
        self.after_space = IdsMemo(self.part, AFTER_SPACE)

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers.

        A text is first cut where white space begins or ends, which are always
        borders of pieces; the ids of such a chunk are remembered.
        """
        if self.specials and any(s in text for s in self.added):
            return b"".join(packed([self.added[part]]) if k % 2 else self.encode_plain(part) for k, part in enumerate(self.specials.split(text)))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if self.is_odd(text):
            return b"".join(map(self.chunk_ids.__getitem__, self.chunks.findall(text)))
        # single spaces and line ends between visible characters: each begins a chunk
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.chunk_ids[first] + b"".join(map(self.after_space.__getitem__, rest))

    def is_odd(self, text: str) -> bool:
        """Whether white space is anything but single spaces and line ends between visible characters."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] == " " or text[-1:] == " ":
            return True
        return any(c in text for c in "\t\v\f\r") if text.isascii() else self.other.search(text) is not None

    def part(self, part: str) -> bytes:
        """What follows a single space, with it, or a line end and what follows it."""
        stop = part[-1:] if part[-1:] in (".", ",") else ""
        word = part[: len(part) - len(stop)]
        if word.isalpha():  # a piece of its own, and so is the stop before white space
            return self.after_space[word] + self.pack[stop] if stop else self.piece(f" {word}")
        return self.chunk(part if part[:1] == "\n" else f" {part}")

    def piece(self, piece: str) -> bytes:
        return packed(self.automaton.encode_word(piece.encode()))

    def chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pack.__getitem__, self.pieces.findall(chunk)))

    def decode(self, packed: bytes) -> str:
        return self.automaton.decode(np.frombuffer(packed, "<u4").tolist()).decode("utf-8", "replace")


_loaded: dict[str, ByteLevelBpe] = {}


def load(name: str) -> ByteLevelBpe:
    """The compiled tokenizer, once per process."""
    if name not in _loaded:
        _loaded[name] = ByteLevelBpe(tokenizer_path(name))
    return _loaded[name]


def slices(batches):
    """Parts of the batches with few rows, so that what is made of them is not held for a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def encode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: each text's ids, packed as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; rows with a null id and repeated rows are
    encoded like any other; an empty table gives an empty table.  No shuffle.
    """

    def run(batches):
        bpe = load(vocabulary)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(t or "") for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text: the text that packed ids stand for.  Null ids give the empty text."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bpe.decode(t or b"") for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("binary").alias("ids")).mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(df: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, text: what ``decode`` gives for ``encode``, in one pass, so that a task has one Python worker and one automaton."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in slices(batches):
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "text"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")


def op1_bpe(spark, sf_dir) -> DataFrame:
    out = round_trip(documents(spark, sf_dir))
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
