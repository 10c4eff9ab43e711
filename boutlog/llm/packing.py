"""Packing into training windows by Karmarkar-Karp multiway differencing.

Tokenised documents are cut into full windows (they fill a sequence alone) and a rest; the rest is
cut into pieces of at most ``max_piece`` tokens. Pieces gather into groups of ``group`` pieces, and
each group is divided over k windows by differencing: every piece starts as a partition of k parts,
all but one empty; the two partitions with the largest spread are merged again and again, the
fullest part of one with the emptiest of the other, until one partition is left. Its parts are the
windows, nearly equal. If the fullest is over capacity, k rises and the group is divided anew.

Packing happens where the rows are read, a bounded group at a time: no shuffle, memory bounded by a
group. A sequence's id is made of the partition's number and a counter within it.

Null text is empty; an empty document is the end token alone. Repeated rows are packed as often as
they occur, an empty table gives no rows, other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from boutlog.llm.textkit import Block, texts

CAPACITY, MAX_PIECE, LEAST_PIECE, GROUP, END_ID = 2048, 512, 96, 4096, 1
TOKENIZER = "byte_bpe_50k.json"
_SLOTS = 20
_LATE = 1 << 14  # runs in the dictionary before they join the arrays
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
#: White space beyond ASCII, and controls that only some engines count as such; texts with it are encoded whole.
_ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xa4]|\xe3\x80\x80|\xef\xbb\xbf")


class Encoder:
    """Token ids of many texts at once, with a bounded memory of runs already encoded.

    A run is white space with the word after it. The tokenizer never joins what stands before a run's
    white space with it, so a text's ids are its runs' ids in order, and only new runs are encoded.
    Runs are told apart by 64-bit hashes, kept in order in arrays (12 bytes a run), and the latest in a dictionary. A text that spells a special token is encoded whole, as the tokenizer takes it.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([_ODD.pattern, *special]))
        # bytes of text behind each id: in the byte-level alphabet every character stands for one byte
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of runs in order, and each run's number
        self.late: dict[int, int] = {}  # the same of the latest runs
        self.ids = np.zeros(1 << 16, "<u4")  # ids of all runs
        self.key, self.value = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32)  # the last run seen in each slot, asked first
        self.at = np.zeros(1 << 16, np.int64)  # where those of each run begin (one more than runs)

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def __len__(self) -> int:
        """How many runs it knows."""
        return len(self.hashes) + len(self.late)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each run, -1 for new ones."""
        if len(self.late) > _LATE:
            hashes_, numbers = (np.concatenate([old, np.fromiter(new, old.dtype, len(self.late))]) for old, new in ((self.hashes, self.late), (self.numbers, self.late.values())))
            order = np.argsort(hashes_, kind="stable")
            self.hashes, self.numbers, self.late = hashes_[order], numbers[order], {}
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.numbers[at], out)
        left = np.flatnonzero(out < 0)
        out[left] = [self.late.get(h, -1) for h in hashes[left].tolist()]
        return out

    def _learn(self, hashes: list[int], runs: list[bytes]) -> None:
        inner = np.fromiter((r[0] in _SPACE and r[-1] not in _SPACE for r in runs), bool, len(runs))
        which = [*np.flatnonzero(inner).tolist(), *np.flatnonzero(~inner).tolist()]
        parts, lengths = [], []
        if inner.any():  # side by side they are encoded as each alone
            joined = [runs[i] for i in which[: int(inner.sum())]]
            ids = self.whole([b"".join(joined)])[0]
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))) + 1
            parts.append(ids)
            lengths.append(np.diff(cuts, prepend=0))
        alone = self.whole([runs[i] for i in which[int(inner.sum()) :]])
        parts += alone
        lengths.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        new, n = np.concatenate([np.zeros(0, "<u4"), *parts]), len(self)
        ends = self.at[n] + np.cumsum(np.concatenate(lengths))
        while len(self.ids) < self.at[n] + len(new):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.at) < n + len(which) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.at[n] : self.at[n] + len(new)] = new
        self.at[n + 1 : n + 1 + len(which)] = ends
        self.late.update(zip((hashes[i] for i in which), range(n, n + len(which))))

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.odd.search(b"\n".join(texts)):
            odd = [bool(self.odd.search(t)) for t in texts]
            plain = iter(self.batch([b"" if o else t for o, t in zip(odd, texts)]))
            return [self.whole([t])[0] if o else ids for o, t, ids in zip(odd, texts, plain)]
        if len(self) > self.most:
            self.forget()
        block = Block(texts, lower=False)
        _, ends, _ = block.words()
        cut = np.zeros(len(block.data) + 1, bool)
        cut[ends] = cut[block.begins] = cut[block.begins[1:] - 1] = True
        cuts = np.flatnonzero(cut)  # ends of words; begins and ends of texts
        left, right = cuts[:-1], cuts[1:]
        inside = np.ones(len(left), bool)
        inside[np.searchsorted(left, block.begins[1:] - 1)] = False  # the separators between texts
        left, right = left[inside], right[inside]
        hashes = block.spans(left, right)
        slots = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        which = self.value[slots]
        missed = np.flatnonzero(self.key[slots] != hashes)
        if len(missed):
            order = np.argsort(hashes[missed], kind="stable")
            ordered = hashes[missed][order]
            change = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first, listed = missed[order[change]], ordered[change]
            numbers = self.find(listed)
            new = np.flatnonzero(numbers < 0)
            if len(new):
                data, a, b, hashed = block.data.tobytes(), left[first[new]].tolist(), right[first[new]].tolist(), listed[new].tolist()
                self._learn(hashed, [data[x:y] for x, y in zip(a, b)])
                numbers[new] = [self.late[h] for h in hashed]
            found = np.empty(len(missed), np.int64)
            found[order] = numbers[np.cumsum(change) - 1]
            which[missed] = found
            self.key[slots[missed]], self.value[slots[missed]] = hashes[missed], found
        at, n = self.at[which], self.at[which + 1] - self.at[which] if len(which) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        ids = self.ids[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        edges = total[np.searchsorted(left, block.begins)]
        return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def rest_cuts(left: int, most: int, least: int = LEAST_PIECE) -> list[int]:
    """Lengths that a rest is cut into: large pieces, then halves, so that differencing has small ones to even out with."""
    out = []
    while left > 0:
        x = most if left >= 2 * most else left if left <= least else -(-left // 2)
        out.append(x)
        left -= x
    return out


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0..k-1) of each size by Karmarkar-Karp differencing over k parts."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    loads: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int]] = []
    # a node is one piece (0..n-1) or a merge (n..); its parts are kept with the fullest first, relative to the emptiest
    heap = [(-int(sizes[i]), int(i)) for i in order]
    heapq.heapify(heap)
    perms: dict[int, np.ndarray] = {}
    single = np.zeros(k, np.int64)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = loads.pop(a, None), loads.pop(b, None)
        if x is None:
            x = single.copy()
            x[0] = sizes[a]
        if y is None:  # the piece goes to the emptiest part
            y = single.copy()
            y[0] = sizes[b]
        total = x + y[::-1]
        turn = np.argsort(-total, kind="stable")
        total = total[turn]
        node = n + len(merges)
        merges.append((a, b))
        perms[node] = turn
        total -= total[-1]
        loads[node] = total
        heapq.heappush(heap, (-int(total[0]), node))
    parts = np.zeros(n, np.int64)
    where: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}  # node -> window of each of its parts
    for node in range(n + len(merges) - 1, n - 1, -1):
        at = where.pop(node)
        a, b = merges[node - n]
        back = np.empty(k, np.int64)
        back[perms[node]] = at
        where[a], where[b] = back, back[::-1]
    for i in range(n):
        parts[i] = where[i][0]
    return parts


def divide(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Parts of the sizes (each at most capacity) and their number: the first k that keeps within capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        parts = difference(sizes, k)
        most = int(np.bincount(parts, weights=sizes, minlength=k).max())
        if most <= capacity:
            return parts, k
        k += 1


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_piece: int = MAX_PIECE, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, on request)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 36
        encode = encoder(tokenizer).batch
        end = np.array([END_ID], "<u4").tobytes()
        full: list[tuple] = []
        rest: list[tuple] = []

        def rows(held: list[tuple], sequences: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
            columns = list(zip(*held))
            arrays = [pa.array(columns[0], batch.column(0).type)] + [pa.array(c, pa.int64()) for c in columns[1:5]] + [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def placed() -> pa.RecordBatch:
            nonlocal sequence, rest
            sizes = np.array([x[2] for x in rest], np.int64)
            parts, k = divide(sizes, capacity)
            turn = np.argsort(parts, kind="stable")
            ordered, loads = [rest[i] for i in turn], sizes[turn]
            before = np.cumsum(loads) - loads
            firsts = np.concatenate([[True], parts[turn][1:] != parts[turn][:-1]])
            offsets = before - np.maximum.accumulate(np.where(firsts, before, 0))
            out = rows(ordered, sequence + np.cumsum(firsts) - 1, offsets)
            sequence, rest = sequence + k, []
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, held in texts(batch.column(1)):
                for doc, found in zip(ids[at : at + len(held)], encode(held)):
                    data = found.tobytes() + end
                    total = len(data) // 4
                    for start in range(0, total - total % capacity, capacity):
                        piece = data[4 * start : 4 * (start + capacity)]
                        full.append((doc, start, capacity, zlib.crc32(piece), total, piece if with_ids else None))
                    start = total - total % capacity
                    for length in rest_cuts(total % capacity, max_piece):
                        piece = data[4 * start : 4 * (start + length)]
                        rest.append((doc, start, length, zlib.crc32(piece), total, piece if with_ids else None))
                        start += length
                        if len(rest) >= group:
                            yield placed()
                if full:
                    yield rows(full, np.arange(sequence, sequence + len(full)), np.zeros(len(full), np.int64))
                    sequence, full = sequence + len(full), []
        if rest:
            yield placed()

    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    source = docs.select(F.col(key), F.col(text).cast("string"))
    schema = f"`{key}` {source.schema[0].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return source.mapInArrow(run, schema)
