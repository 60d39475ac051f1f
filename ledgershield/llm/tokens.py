"""Token ids by a byte-level BPE vocabulary file of the ``tokenizers`` library.

The vocabulary's path is a parameter; the driver reads the file and its text travels with the job, so
executors need no copy of it.  Byte-level BPE of this family never merges across the pieces that its
pattern splits a text into, and a space before a non-space always starts a piece.  So the ids of a text
whose spaces are single are those of its space-separated units, each with the space before it, in order.
``Encoder`` keeps the ids of the first units it meets (``keep`` of them) in one array and asks the library for the
others.  The units of many texts are told apart by Arrow's dictionary encoding, so each distinct one is looked up once,
and the ids of all are gathered at once.  Texts with runs of spaces, or with a character on whose class two Unicode
versions might differ, go to the library whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import chain
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Texts that go to the library whole: those with the stand-ins used below, white space other than single
# spaces and newlines, characters of doubtful class, or a comma or full stop not right after a word
# character but before a space or newline.
WHOLE = re.compile(r"[\x01-\x04\t\x0b-\x0d\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
LOOSE = re.compile(r"[,.][ \n](?<![^\W_]..)", re.DOTALL)
COMMA, STOP, LINE, FIRST = "\x01", "\x02", "\x03", "\x04"   # "," or "." or ".\n" right after a word; a word right after LINE
TAILED = re.compile(r"([^\W\d_]+)([^\w\s]+)")
CACHE = 1_500_000
TOGETHER, WORDS = 1 << 21, 256   # characters of texts whose units are looked up together, words strung together


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, vocabulary: str, keep: int = CACHE) -> None:
        self.keep = keep
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True      # their strings in a text are ordinary text
        self.number: dict[str, int] = {}                 # by unit, without the space before it; by space and tail
        self.ids = np.zeros(1 << 12, "<u4")              # of the units, in order of their numbers
        self.ends = np.zeros(1 << 10, np.int64)          # in ``ids``, after a leading zero
        self._add([COMMA, STOP, LINE], *self._encoded([",", ".", ".\n"]))
        self.marks = len(self.number)

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        marked = [self._marked(t) for t in texts]
        lists = pc.split_pattern(pa.array([m for m in marked if m is not None], pa.large_string()), " ")
        units = lists.flatten().dictionary_encode()
        numbers = self._numbers(units.dictionary.to_pylist())
        ids, ends = self._gathered(numbers[units.indices.to_numpy()])
        cuts = iter(ends[lists.offsets.to_numpy()].tolist())
        while len(self.number) > max(self.keep, self.marks):     # full: the units learned last go
            self.number.popitem()
        at = next(cuts)
        for text, m in zip(texts, marked):
            if m is None:
                yield _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                to = next(cuts)
                yield ids[at:to].tobytes()
                at = to

    @staticmethod
    def _marked(text: str) -> str | None:
        """The text with a space between its units; None if it has to go to the library whole."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or WHOLE.search(text) or LOOSE.search(text):
            return None
        return FIRST + text.replace(", ", f" {COMMA} ").replace(". ", f" {STOP} ").replace(".\n", f" {LINE} {FIRST}")

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units of these numbers, one after the other, and their ends after a leading zero."""
        lengths = self.ends[numbers + 1] - self.ends[numbers]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        place = np.repeat(self.ends[numbers] - ends[:-1], lengths)
        place += np.arange(len(place))
        return self.ids[place], ends

    def _numbers(self, units: list[str]) -> np.ndarray:
        numbers = [self.number.get(u, -1) for u in units]
        new = [k for k, n in enumerate(numbers) if n < 0]
        if new:
            self._learn([units[k] for k in new])
            for k in new:
                numbers[k] = self.number[units[k]]
        return np.array(numbers, np.int64)

    def _add(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Units not kept yet, with their ids one after the other."""
        n = len(self.number)
        start, to = int(self.ends[n]), int(self.ends[n]) + len(ids)
        if to > len(self.ids):
            self.ids = np.concatenate((self.ids[:start], np.zeros(to + to // 4 - start, "<u4")))
        if n + len(units) >= len(self.ends):
            self.ends = np.concatenate((self.ends[:n + 1], np.zeros((n + len(units)) * 5 // 4 - n, np.int64)))
        self.ids[start:to] = ids
        self.ends[n + 1:n + 1 + len(units)] = start + np.cumsum(lengths)
        self.number.update(zip(units, range(n, n + len(units))))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.array([len(f) for f in found], np.int64)

    def _learn(self, units: list[str]) -> None:
        words: list[str] = []
        others: list[str] = []
        for u in units:
            (words if u.isalpha() else others).append(u)
        tailed = [m for m in map(TAILED.fullmatch, others) if m and m[1].isalpha()]
        words += {m[1] for m in tailed}.difference(self.number, words)
        for at in range(0, len(words), WORDS):           # short strings are the library's fastest
            self._learn_words(words[at:at + WORDS])
        tails = [t for t in {m[2] for m in tailed} if f" {t}" not in self.number]
        if tails:
            self._add([f" {t}" for t in tails], *self._encoded(tails))
        if tailed:
            both = [self.number[x] for m in tailed for x in (m[1], f" {m[2]}")]
            ids, ends = self._gathered(np.array(both, np.int64))
            self._add([m[0] for m in tailed], ids, np.diff(ends[::2]))
        rest = [u for u in others if u not in self.number]
        if rest:
            self._add(rest, *self._encoded([u[1:] if u[:1] == FIRST else f" {u}" for u in rest]))

    def _learn_words(self, words: list[str]) -> None:
        """Words with a leading space split apart again when strung together, so one call encodes them all."""
        e = self.tokenizer.encode(" " + " ".join(words), add_special_tokens=False)
        starts = np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1))
        if len(starts) != len(words):
            raise ValueError("the vocabulary does not split a text at its spaces")
        self._add(words, np.array(e.ids, "<u4"), np.diff(starts, append=len(e.ids)))


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def encoder(path: str, keep: int = CACHE) -> Callable[[], Encoder]:
    """Gives the ``Encoder`` for the vocabulary at ``path``, one per Python worker."""
    vocabulary = Path(path).read_text(encoding="utf-8")
    key = f"encoder of {path}, {keep}"

    def build() -> Encoder:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one thread per task; Spark runs the tasks
        kept = sys.modules.setdefault("_ledgershield_worker", ModuleType("_ledgershield_worker")).__dict__
        if key not in kept:
            kept[key] = Encoder(vocabulary, keep)
        return kept[key]
    return build
