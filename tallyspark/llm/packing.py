"""Hierarchical multi-length packing of documents into training sequences, one pass, no shuffle.

Each task packs the documents of its own input split, some million tokens at a time: whole sequences are cut from long
documents; what is left of each is routed to the shortest context tier that holds it; tiers are packed from the longest
window down, each window's gap filled with the best fit from shorter tiers and at last with a piece cut to the gap. So
every window is full; what is left over moves to the next batch, and at the end of the split is laid out in windows of
powers of two."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Remembered, by_slices, small_batches, table

TOKENIZER = "word_bpe_49k.json"
TIERS = (256, 512, 1024, 2048)
END = 1
#: Token ids that a task gathers before it packs them.
BATCH_TOKENS = 2_000_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _gather(flat: np.ndarray, lengths: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs numbered `take`, joined, and where each ends; flat holds runs of those lengths in turn."""
    own = lengths[take]
    stops = np.cumsum(own)
    at = np.repeat((np.cumsum(lengths) - lengths)[take] - (stops - own), own)
    at += np.arange(len(at))
    return flat[at], stops


class WordIds:
    """Token ids, little-endian unsigned 32-bit, of strings without ASCII white space.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its strings in turn.
    Letters and the marks before and after them are tokenized apart, so a string's ids are those of its parts. New parts go
    together to the BPE model itself, strings that can't be parted to the tokenizer; both are remembered, up to a bound,
    when the older half goes."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a part
        self.ends[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.wholes = Remembered(lambda word: np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes(), most)
        self.forget()

    def forget(self) -> None:
        """Give the memory of words, and what Arrow holds in reserve, back to the system."""
        self.wholes.clear()
        self.parts = pa.array([], pa.binary())
        self.flat, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64)  # a length of -1: the tokenizer must see the whole string
        pa.default_memory_pool().release_unused()

    def _chars(self, part: bytes) -> str | None:
        """Letters, or marks, in the model's characters; None if they aren't tokenized apart."""
        if part.isalpha():  # ASCII letters
            return part.decode()
        text = part.decode()
        if not text.strip(_MARKS):
            return None if "<|" in text else text
        return text.lower().encode().decode("latin-1").translate(self.byte_chars) if _LETTERS.fullmatch(text) else None

    def _learn(self, new: pa.Array) -> None:
        chars = [*map(self._chars, new.to_pylist())]
        lengths = np.fromiter((0 if x == "" else 1 if x else -1 for x in chars), np.int64, len(chars))
        ids = np.array(self.model.encode_batch_fast([" ".join(filter(None, chars))])[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != (lengths > 0).sum():
            raise ValueError("the tokenizer's model does not end every word by its suffix")
        lengths[lengths > 0] = np.diff(stops, prepend=0)
        self.parts, self.flat, self.lengths = pa.concat_arrays([self.parts, new]), np.concatenate([self.flat, ids]), np.concatenate([self.lengths, lengths])

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different strings, joined, and each one's number of ids."""
        if len(self.parts) > self.most:
            gone = len(self.parts) // 2
            self.flat, self.lengths, self.parts = self.flat[np.maximum(self.lengths[:gone], 0).sum() :], self.lengths[gone:], self.parts[gone:]
        words, n = words.cast(pa.string()), len(words)
        lower = pc.ascii_lower(words)
        left = pc.ascii_ltrim(lower, _MARKS)
        begins = np.frombuffer(lower.buffers()[1], np.int32, n + 1, 4 * lower.offset)
        cuts = np.empty(3 * n + 1, np.int32)  # of each string: the marks before, the letters, the marks after
        cuts[::3] = begins
        cuts[1::3] = begins[1:] - pc.binary_length(left).to_numpy()
        cuts[2::3] = cuts[1::3] + pc.binary_length(pc.ascii_rtrim(left, _MARKS)).to_numpy()
        parts = pa.BinaryArray.from_buffers(pa.binary(), 3 * n, [None, pa.py_buffer(cuts), lower.buffers()[2]]).dictionary_encode()
        own, three = parts.dictionary, parts.indices.to_numpy().reshape(n, 3)
        found = pc.index_in(own, self.parts)
        new, at = found.is_null(), found.fill_null(0).to_numpy().astype(np.int64)
        if new.true_count:
            at[new.to_numpy(zero_copy_only=False)] = len(self.parts) + np.arange(new.true_count)
            self._learn(own.filter(new))
        alone = self.lengths[at] >= 0
        quoted = pc.match_substring(own, "'").to_numpy(zero_copy_only=False)  # before letters, they may be a token with these
        whole = np.flatnonzero(~alone[three].all(1) | quoted[three[:, 0]])
        others = [*map(self.wholes.__getitem__, words.take(pa.array(whole)).to_pylist())]
        runs, nothing = at[three], len(self.parts)
        runs[whole] = nothing
        runs[whole, 0] += 1 + np.arange(len(whole))
        lengths = np.concatenate([np.maximum(self.lengths, 0), [0], np.fromiter(map(len, others), np.int64, len(others)) // 4])
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(others), np.uint32)])
        return _gather(flat, lengths, runs.ravel())[0], lengths[runs].sum(1)


_IDS: dict[str, WordIds] = {}


def token_runs(texts: pa.Array, path: str, end: int = END) -> Iterator[bytes]:
    """Each document's ids and the end id, four bytes each. Only the strings that differ are looked up, once for all texts."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    if not len(texts):
        return
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten().dictionary_encode()
    flat, lengths = _IDS[path].of(words.dictionary)
    after = split.offsets.to_numpy()[1:]
    take = np.insert(words.indices.to_numpy(), after, len(lengths))
    ids, stops = _gather(np.append(flat, np.uint32(end)), np.append(lengths, 1), take)
    start = 0
    for stop in stops[after + np.arange(len(after))].tolist():
        yield ids[start:stop].tobytes()
        start = stop


def token_bytes(text: str | None, path: str, end: int = END) -> bytes:
    """One document's ids and the end id."""
    return next(token_runs(pa.array([text], pa.string()), path, end))


class Packer:
    """Packs documents into full windows; rows come out as (piece, tier, sequence, offset), a piece being
    (doc, start, length, crc, doc_tokens)."""

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.sequence, self.out = tiers, first_sequence, []
        self.pools: dict[int, list[tuple]] = {t: [] for t in tiers}
        self.held = 0

    def _route(self, start: int, length: int, n: int, doc, data: bytes) -> None:
        """A piece waits in the pool of the shortest tier that holds it. data: the whole document's ids."""
        insort(self.pools[next(t for t in self.tiers if t >= length)], (length, self.held, start, n, doc, data), key=lambda x: x[:2])
        self.held += 1

    def add(self, doc, data: bytes) -> None:
        n, most = len(data) // 4, self.tiers[-1]
        for start in range(0, n - most + 1, most):
            self._emit([(most, 0, start, n, doc, data)], most)
        if n % most:
            self._route(n - n % most, n % most, n, doc, data)

    def _emit(self, pieces: list[tuple], tier: int) -> None:
        offset = 0
        for length, _, start, n, doc, data in pieces:
            self.out.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, tier, self.sequence, offset))
            offset += length
        self.sequence += 1

    def _best(self, gap: int, below: int) -> tuple | None:
        """The longest waiting piece of at most gap ids, in tiers up to `below`."""
        for t in reversed([t for t in self.tiers if t <= below]):
            pool = self.pools[t]
            if (at := bisect_right(pool, gap, key=lambda x: x[0])) > 0:
                return pool.pop(at - 1)
        return None

    def _cut(self, gap: int, below: int) -> tuple | None:
        """gap ids from the start of the shortest longer piece; the rest of it waits in the tier of its length."""
        for t in [t for t in self.tiers if t <= below]:
            if self.pools[t]:
                length, order, start, n, doc, data = self.pools[t].pop(0)
                self._route(start + gap, length - gap, n, doc, data)
                return gap, order, start, n, doc, data
        return None

    def pack(self) -> None:
        """Fill windows of each tier, from the longest, while there is enough to fill one."""
        for tier in reversed(self.tiers):
            waiting = sum(x[0] for t in self.tiers if t <= tier for x in self.pools[t])
            while self.pools[tier] and waiting >= tier:
                pieces, gap = [self.pools[tier].pop()], 0
                gap = tier - pieces[0][0]
                while gap and (piece := self._best(gap, tier) or self._cut(gap, tier)):
                    pieces.append(piece)
                    gap -= piece[0]
                waiting -= tier
                self._emit(pieces, tier)

    def finish(self) -> None:
        """Lay out all that waits in windows of falling powers of two, cut where one ends: nothing is padded."""
        self.pack()
        rest = sum(x[0] for pool in self.pools.values() for x in pool)
        window = self.tiers[-1]
        while rest:
            while window > rest:
                window //= 2
            pieces, gap = [], window
            while gap:
                piece = self._best(gap, self.tiers[-1]) or self._cut(gap, self.tiers[-1])
                pieces.append(piece)
                gap -= piece[0]
            self._emit(pieces, window)
            rest -= window

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


class StepGroups:
    """Deals a split's windows to training steps. Each tier fills one group at a time, up to step_tokens; what is not full when
    the split ends is filled up across tiers, the longest windows first. All windows and step_tokens are multiples of the
    shorter ones, so every group but the last of a split has step_tokens exactly, if they are a multiple of the longest."""

    def __init__(self, first: int, tiers: tuple[int, ...], step_tokens: int):
        self.next, self.step = first, step_tokens
        self.open: dict[int, list[tuple[int, list[tuple]]]] = {t: [] for t in tiers}  # of each tier: (tokens, rows) by window
        self.held = dict.fromkeys(tiers, 0)
        self.short: list[tuple[int, list[tuple]]] = []

    def _close(self, windows: list[tuple[int, list[tuple]]]) -> list[tuple]:
        self.next += 1
        return [(*row, self.next - 1) for _, rows in windows for row in rows]

    def add(self, tier: int, rows: list[tuple]) -> list[tuple]:
        """Take a window's rows; the rows, with their group, of groups that are full now."""
        if tier not in self.open:
            self.short.append((tier, rows))
            return []
        done = []
        if self.held[tier] and self.held[tier] + tier > self.step:
            done, self.open[tier], self.held[tier] = self._close(self.open[tier]), [], 0
        self.open[tier].append((tier, rows))
        self.held[tier] += tier
        if self.held[tier] == self.step:
            done, self.open[tier], self.held[tier] = done + self._close(self.open[tier]), [], 0
        return done

    def finish(self) -> list[tuple]:
        left = sorted([w for windows in self.open.values() for w in windows] + self.short, key=lambda w: -w[0])
        out, group, held = [], [], 0
        for window in left:
            if held and held + window[0] > self.step:
                out, group, held = out + self._close(group), [], 0
            group.append(window)
            held += window[0]
        return out + (self._close(group) if group else [])


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _packed(batches, path: str, end: int, tiers: tuple[int, ...], step_tokens: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    packer, groups, gathered = Packer(first, tiers), StepGroups(first, tiers, step_tokens), 0

    def written(last: bool = False) -> Iterator[pa.RecordBatch]:
        windows: dict[int, list[tuple]] = {}
        for row in packer.rows():
            windows.setdefault(row[6], []).append(row)
        rows = [r for own in windows.values() for r in groups.add(own[0][5], own)] + (groups.finish() if last else [])
        cols = list(zip(*rows)) or [()] * 9
        order = ((0, id_type), *((k, pa.int64()) for k in (1, 2, 3, 4, 6, 7)), (5, pa.int32()), (8, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(cols[k], t) for k, t in order], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

    try:
        for batch in by_slices(batches, "text"):
            for id_, data in zip(batch.column("id").to_pylist(), token_runs(batch.column("text"), path, end)):
                packer.add(id_, data)
                gathered += len(data) // 4
            if gathered >= BATCH_TOKENS:
                packer.pack()
                gathered = 0
                yield from written()
    finally:  # workers live on, with other stages' tasks
        if path in _IDS:
            _IDS[path].forget()
    packer.finish()
    yield from written(last=True)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65_536) -> DataFrame:
    """A row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the window's length) and
    step_group (windows of one tier for one training step of about step_tokens).

    Step groups are filled over a whole split: every group but a split's last has step_tokens exactly, or, if these are no
    multiple of the longest tier, is within one window of them. Only groups that are not full mix tiers.

    tiers: ascending powers of two; the last is the longest window. Each id of each document, and its end id, lies in
    exactly one piece. Null and empty texts are the end id alone. Rows are packed one by one, repeated or not; other
    columns are ignored; an empty table gives an empty result. A split's rows go to its own windows, so a lost task is
    simply run again, and the padding is nil."""
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    return rows.mapInArrow(lambda b: _packed(b, path, end, tiers, step_tokens, arrow), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the pieces of all documents."""
    return pack_documents(table(spark, sf_dir, "documents"))
