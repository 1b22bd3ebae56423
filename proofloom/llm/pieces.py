"""SentencePiece encoding and decoding with merge-type vocabularies.

A text becomes symbols, one for each character, blanks written as U+2581 with
one more in front. All adjacent pairs that form a vocabulary piece stand on an
agenda; the pair of the highest score (the leftmost among equals) is merged
and its new neighbours join the agenda, until it is empty. Symbols outside the
vocabulary become the byte pieces of their UTF-8 form.

No piece of a merge vocabulary needs to reach over two characters that stand
side by side in no piece, so a text is cut there first: merges never cross
such a cut, and the segments, which repeat a lot, are remembered within a task;
only some short ones stay in the worker for the next task.
Every segment met for the first time is also encoded by the sentencepiece
library, in one call per Arrow batch; a difference stops the job.

Null and empty texts have no ids. The model file is read on the driver and
travels to the tasks as a broadcast, so executors need no file of their own.
"""

from __future__ import annotations

import heapq
import pickle
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import slices

BLANK = "▁"
#: Segments a task remembers, twice: when the memory is full it becomes the old one, and what is met again moves on.
REMEMBERED = 150_000
#: Segments of so many characters at most, short ones being the most frequent, stay in a worker between tasks, up to this number.
LASTING, MOST_LASTING = 6, 50_000
#: Score of a pair that is no piece.
NEVER = float("-inf")
#: Longer segments keep their agenda in a heap.
SHORT = 48


class Vocabulary:
    """Pieces, scores and byte pieces of one model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(size) if sp.is_byte(i)}
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.unusual = self.silent | {self.unknown}
        special = self.silent | set(self.byte_of) | {self.unknown}
        self.ids = {self.names[i]: i for i in range(size) if i not in special}
        self.scores = {name: sp.get_score(i) for name, i in self.ids.items()}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        self.joined = {a + b for name in self.ids for a, b in zip(name, name[1:], strict=False)}
        self.blanks_only = all(BLANK not in name.lstrip(BLANK) for name in self.ids)
        #: Ids of the segments met so far, as bytes of 32-bit numbers.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.silent
                         else " ⁇ ".encode() if i == self.unknown
                         else name.replace(BLANK, " ").encode() for i, name in enumerate(self.names)]
        self.cut = re.compile(self._segment_pattern())

    def _segment_pattern(self) -> str:
        """Runs of word characters and of others, each with the blanks before it, if no piece reaches further."""
        if not self.blanks_only or any("\n" in pair for pair in self.joined):
            return "(?s).+"
        pairs = [p for p in self.joined if BLANK not in p]
        other = {c for p in pairs for c in p if not re.match(r"\w", c)}
        while more := {c for p in pairs for c in p if c not in other and not other.isdisjoint(p)}:
            other |= more
        odd = re.escape("".join(c for c in other if re.match(r"\w", c)))
        return rf"{BLANK}*[^\W{odd}]+|{BLANK}*[\W{odd}]+?(?=[^\W{odd}]|{BLANK}|\n|$)|\n+"

    def merge(self, text: str) -> list[str]:
        return self._merge_short(list(text)) if len(text) <= SHORT else self._merge_long(text)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda is the list of the adjacent pairs' scores."""
        score, none = self.scores.get, NEVER
        agenda = [score(a + b, none) for a, b in pairwise(symbols)]
        while agenda and (best := max(agenda)) > none:
            i = agenda.index(best)
            symbols[i] = joined = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + joined, none)
            if i < len(agenda):
                agenda[i] = score(joined + symbols[i + 1], none)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """The agenda is a heap; an entry is stale once one of its symbols has grown."""
        symbols: list[str] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(symbols):
                found = self.scores.get(symbols[left] + symbols[right])
                if found is not None:
                    heapq.heappush(agenda, (-found, left, right, len(symbols[left]) + len(symbols[right])))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def ids_of(self, segment: str) -> bytes:
        out: list[int] = []
        for symbol in self.merge(segment):
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def check(self, segments: list[str]) -> None:
        """Compare new segments with the library. Inner ones are put behind a line end."""
        lead = self.library.encode("\n")
        inner = [not s.startswith(BLANK) for s in segments]
        got = self.library.encode(["\n" + s if i else s[1:].replace(BLANK, " ") for s, i in zip(segments, inner, strict=True)],
                                  num_threads=1)
        for segment, ids, i in zip(segments, got, inner, strict=True):
            if len(segment) > 1 and array("i", ids[len(lead):] if i else ids).tobytes() != self.known[segment]:
                raise ValueError(f"the library encodes {segment!r} differently")

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(BLANK + text.replace(" ", BLANK))

    def encode(self, texts: list[str | None]) -> tuple[bytes, list[int]]:
        """Ids of all texts in a row, as bytes of 32-bit numbers, and the end of each text."""
        parts = [self.segments(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        fresh = set(chain.from_iterable(parts)).difference(self.known)
        new = []
        for s in fresh:
            ids = self.old.get(s)
            if ids is None:
                new.append(s)
                ids = self.ids_of(s)
            self.known[s] = ids
        if new and self.blanks_only:
            self.check(new)
        flat = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        return b"".join(flat), list(accumulate((len(f) // 4 for f in flat), initial=0))

    def forget(self) -> None:
        """Give the memory of a task back, but for some short segments; these are written anew, so that they hold no page of the others."""
        lasting = pickle.dumps(dict(islice(((s, ids) for s, ids in self.known.items() if len(s) <= LASTING), MOST_LASTING)))
        self.known = self.old = {}
        self.known, self.old = pickle.loads(lasting), {}

    def decode(self, ids: list[int]) -> str:
        """Text of ids; a byte that belongs to no valid character becomes U+FFFD."""
        try:
            if not self.unusual.isdisjoint(ids):
                raise ValueError
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        except ValueError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and self.names[first].startswith(BLANK) else text

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in chain(ids, (None,)):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        del run[:n]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    del run[0]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    held = sys.__dict__.setdefault("_proofloom_vocabularies", {})
    key = hash(model)
    if key not in held:
        held.clear()
        held[key] = Vocabulary(model)
    return held[key]


#: Characters of texts that are worked on together.
TOGETHER = 300_000


def _slices(batch: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in batch:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _id_array(found: bytes, ends: list[int]) -> pa.Array:
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _texts(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([vocabulary.decode(flat[a:b].tolist()) for a, b in pairwise(ends)], pa.string())


def _broadcast(spark: SparkSession, model_path: str):
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column, model_path: str) -> Column:
    """array<int>: the ids of a text, without begin or end ids. Null and empty texts: no ids."""
    model = _broadcast(spark, model_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(model.value)
        for batch in batches:
            for texts in _slices(batch):
                yield _id_array(*vocabulary.encode(texts))
        vocabulary.forget()

    return ids(text)


def decode(spark: SparkSession, ids: Column, model_path: str) -> Column:
    """string: the text of an array of ids. Null: empty."""
    model = _broadcast(spark, model_path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(model.value)
        for batch in slices(batches):
            yield _texts(vocabulary, batch)

    return text(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(spark: SparkSession, text: Column, model_path: str) -> Column:
    """struct<ids, decoded>: the ids of a text and the text of these ids, in one worker."""
    model = _broadcast(spark, model_path)

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(model.value)
        for batch in batches:
            for texts in _slices(batch):
                ids = _id_array(*vocabulary.encode(texts))
                yield pa.StructArray.from_arrays([ids, _texts(vocabulary, ids)], ["ids", "decoded"])
        vocabulary.forget()

    return both(text)
