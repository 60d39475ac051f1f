"""Byte-level BPE encoding and decoding by a rank file.

The rank file (base64 token and rank a line) and the pattern that splits texts before the merges are parameters;
the driver reads the file and its text travels with the job.  Every match of the pattern is encoded by itself, in
time linear in its length:

* Tokens, their bytes mapped to Latin-1 characters, form one Aho-Corasick automaton, which gives the longest token at
  a position.
* From left to right the longest token is taken that is compatible with the token before it; if none is, that token
  gives way to its longest proper prefix among the tokens.  An end from which the rest could not be encoded is never
  tried again, so each position fails at most once.
* Two adjacent tokens are compatible if merging their bytes by rank would give exactly these two: their merges are
  undone from the highest rank down, and no token that merging would prefer may lie across the border.  The verdicts
  are memoised by pair.

A token sequence whose neighbours are all compatible is the one that the merges give, so the ids are those of merging
step by step.  The ids of pieces are remembered up to a bound, and so are those of the units between single spaces:
the pattern must begin a match at every space between two non-spaces, as all patterns of this family do.  A piece that is itself a token gets its id, also when merges alone would not reach that token.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from struct import pack
from types import ModuleType

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = 300_000         # pieces, units and pairs of tokens that a worker remembers; the others are worked out anew
LONGEST_KEPT = 64      # characters of a piece or unit that is remembered
NOT_SINGLE = re.compile(r" \s|\s ").search
TOGETHER = 1 << 18     # bytes of texts, or ids, that a worker handles at a time (one row at least)


def read_ranks(text: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in text.splitlines() if line.strip())}


class Codec:
    """Encodes by one vocabulary.  Single bytes must have the lowest ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = KEEP) -> None:
        self.pieces_of = regex.compile(pattern).findall
        self.keep = keep
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        if sorted(ranks[bytes([b])] for b in range(256)) != sorted(ranks.values())[:256]:
            raise ValueError("the single bytes do not have the lowest ranks")
        self.length = [len(t) if t is not None else 0 for t in self.tokens]
        self.widest = max(self.length)
        self.pairs: dict[int, int] = {}                    # left * size + right -> the token they merge to
        self.compatible: dict[int, bool] = {}
        self.split = [(i, i) for i in range(self.size)]    # the merge that makes a token; itself if there is none
        self.prefix = self._prefixes(lambda rank: True)
        merged = self._find_splits()
        self.prefix = self._prefixes(merged.__contains__)
        self.automaton = ahocorasick.Automaton()
        for rank in merged:
            self.automaton.add_word(self.tokens[rank].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}                  # ids of pieces
        self.units: dict[str, bytes] = {}                  # and of stretches between spaces, with the space before

    def _prefixes(self, usable: Callable[[int], bool]) -> list[int]:
        """The longest proper prefix of each token that is a usable token, or -1."""
        out = [-1] * self.size
        for token, rank in self.ranks.items():
            for n in range(len(token) - 1, 0, -1):
                shorter = self.ranks.get(token[:n])
                if shorter is not None and usable(shorter):
                    out[rank] = shorter
                    break
        return out

    def _find_splits(self) -> set[int]:
        """Record the last merge of every token; the tokens that merges can make."""
        made = set()
        for rank, token in enumerate(self.tokens):
            if token is None:
                continue
            if len(token) == 1:
                made.add(rank)
            left = self.prefix[rank]
            while left >= 0:
                right = self.ranks.get(token[self.length[left]:])
                if right is not None and left < rank and right < rank and left in made and right in made and self._judge(left, right):
                    self.pairs[left * self.size + right] = rank
                    self.split[rank] = (left, right)
                    made.add(rank)
                    break
                left = self.prefix[left]
        return made

    def _judge(self, left: int, right: int) -> bool:
        limit = self.size                                  # the rank of the merge undone last: only lower ones came before it
        while True:
            if self.pairs.get(left * self.size + right, limit) < limit:
                return False
            open_left, open_right = self.split[left][1] != left, self.split[right][0] != right
            if open_left and (left > right or not open_right):
                limit, left = left, self.split[left][1]
            elif open_right:                               # a merge of equal rank further left came earlier
                limit, right = right + 1, self.split[right][0]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = left * self.size + right
        verdict = self.compatible.get(key)
        if verdict is None:
            if len(self.compatible) >= self.keep:
                self.compatible.clear()
            verdict = self.compatible[key] = self._judge(left, right)
        return verdict

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, n, longest_from = piece.decode("latin-1"), len(piece), self.automaton.iter_long
        lengths, size, verdicts, widest = self.length, self.size, self.compatible, self.widest
        dead: set[int] = set()                             # ends from which the rest cannot be encoded
        token = next(longest_from(text[:widest]))[1]
        out, at = [token], lengths[token]
        while at < n:
            token = next(longest_from(text[at:at + widest]))[1]    # every byte is a token, so one starts here
            last = out[-1]
            while True:
                fits = verdicts.get(last * size + token)
                if fits is None:
                    fits = self._fits(last, token)
                end = at + lengths[token]
                if fits and end not in dead:
                    out.append(token)
                    at = end
                    break
                token = self.prefix[token]
                while token < 0:                           # nothing fits here: the token before gives way
                    dead.add(at)
                    token = out.pop()
                    at -= lengths[token]
                    token = self.prefix[token]
                if not out:
                    out, at = [token], lengths[token]
                    break
                last = out[-1]
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if NOT_SINGLE(text):
            return self._pieces(text)
        first, *units = text.split(" ")
        known = self.units
        new = set(units).difference(known)
        before = len(known)
        for unit in new:
            known[unit] = self._pieces(" " + unit)
        out = self._pieces(first) + b"".join(map(known.__getitem__, units))
        forget(known, new, max(before, self.keep))
        return out

    def _pieces(self, text: str) -> bytes:
        pieces = self.pieces_of(text)
        known = self.known
        new = [p for p in pieces if p not in known] if len(pieces) < 20 else set(pieces).difference(known)
        before = len(known)
        for piece in new:
            ids = self.encode_piece(piece.encode())
            known[piece] = pack(f"<{len(ids)}I", *ids)
        out = b"".join(map(known.__getitem__, pieces))
        forget(known, new, max(before, self.keep))
        return out


def forget(known: dict[str, bytes], new: Iterable[str], most: int) -> None:
    """Keep ``most`` entries at most, and none that is long."""
    for key in new:
        if len(key) > LONGEST_KEPT:
            known.pop(key, None)
    while len(known) > most:               # the last ones go
        known.popitem()


class Decoder:
    """The bytes of ids; a small table, without what encoding needs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the place where those of each id end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("ids that the vocabulary does not have")
        many = self.lengths[ids]
        ends = np.cumsum(many)
        places = np.arange(int(many.sum())) + np.repeat(self.starts[ids] - ends + many, many)
        return self.bytes[places], ends


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from and to, in order, of TOGETHER in size or one row."""
    ends = np.cumsum(sizes)
    at, before = 0, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield at, to
        at, before = to, int(ends[to - 1])


def per_worker(key: str, build: Callable[[], object]) -> object:
    kept = sys.modules.setdefault("_ledgershield_worker", ModuleType("_ledgershield_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def encode_column(path: str, pattern: str) -> Callable[[Column], Column]:
    """A text column's ids as array<int>; null texts have no ids."""
    ranks = Path(path).read_text(encoding="ascii")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = per_worker(f"codec of {path}, {pattern}", lambda: Codec(read_ranks(ranks), pattern))
        for batch in batches:
            for at, to in slices(np.asarray(pc.binary_length(batch).fill_null(0))):
                parts = [own.encode(t) if t else b"" for t in batch.slice(at, to - at).to_pylist()]
                ends = np.cumsum([0, *map(len, parts)]) // 4
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<int>").asNondeterministic()


def decode_column(path: str) -> Callable[[Column], Column]:
    """The bytes of a column of ids (array<int>); a null array has no bytes, a null or unknown id is an error."""
    ranks = Path(path).read_text(encoding="ascii")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = per_worker(f"decoder of {path}", lambda: Decoder(read_ranks(ranks)))
        for batch in batches:
            counts = np.asarray(pc.list_value_length(batch).fill_null(0))
            for at, to in slices(counts):
                ids = batch.slice(at, to - at).flatten()
                if ids.null_count:
                    raise ValueError("null ids")
                data, places = own.decode(np.asarray(ids))
                ends = np.concatenate(([0], places))[np.concatenate(([0], np.cumsum(counts[at:to])))]
                yield pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary").asNondeterministic()


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row.

    Null and empty texts have no ids; repeated rows and null ids stay as they are; extra columns are ignored; an empty
    table gives an empty result.  Very long texts are encoded whole."""
    return docs.select(F.col(id_col), encode_column(path, pattern)(F.col(text_col)).alias("ids"))


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their ids as ``out_col``."""
    return rows.withColumn(out_col, decode_column(path)(F.col(ids_col)))
