"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An alignment of a benchmark item of n characters with at most e edits leaves at least
n - q + 1 - q * e of its q-grams whole, and all of them lie within e diagonals of each other. The item's
q-grams that a text shares are counted in overlapping bands of 2 * e diagonals (a band begins every e
diagonals, so any alignment lies inside one), each place of the item once; bands that reach the bound become
regions, and a region is kept where a banded alignment of the item to any part of it needs at most e edits,
e = floor(max_rate * n). q is ``Q``, and for short items the largest that leaves one q-gram at the full budget.
Alignments of many regions advance side by side, and one ends as soon as all its cells are over the budget.

Documents are scanned where they are read, with no shuffle. The benchmark is the stated query set: it
is taken in blocks of at most ``block_bytes`` of text, each block broadcast for one scan of all rows.

Texts are compared by code points, A-Z lower-cased, each ASCII white space as a blank; an accented letter is one character
and one edit (bytes that are no UTF-8 count as one replacement character each). Null or empty
texts and null or empty items match nothing. Items under ``Q`` characters match exact and as whole words. Repeated rows and
repeated items are each reported; of equally good places of an item the first begin counts. Other columns are not looked
at; empty tables give no rows. A very long text is held whole in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutlog.llm.textkit import LOWER, SEPARATOR, Block, texts

Q, MAX_RATE, BLOCK_BYTES = 8, 0.10, 4 << 20
_FOLD = np.where(SEPARATOR, 32, LOWER).astype(np.uint32)[:128]
_FOLD[0] = 32
_BITS = 22
_UNIT = np.int64(1 << 40)
_NEVER = np.int64(1 << 61)
_ABREAST = 64  # alignments that advance side by side


class Characters(Block):
    """Texts side by side as they are compared: code points, apart by one that no item holds."""

    def __init__(self, held: list[bytes]):
        decoded = [x.decode("utf-8", "replace") for x in held]
        data = np.frombuffer(("\n".join(decoded) + "\n").encode("utf-32-le"), np.uint32)
        self.data = np.where(data < 128, _FOLD[data & 127], data)
        self.lengths = np.fromiter(map(len, decoded), np.int64, len(decoded))
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.data[self.begins[1:] - 1] = 10

    def text(self, i: int) -> np.ndarray:
        return self.data[self.begins[i] : self.begins[i] + self.lengths[i]]


def _places(whole: bytes, sought: bytes) -> Iterator[int]:
    """Where the code points of ``sought`` stand in ``whole``, both with four bytes each."""
    at = whole.find(sought)
    while at >= 0:
        if at % 4 == 0:
            yield at // 4
        at = whole.find(sought, at + 1)


class Index:
    """The q-grams of some items, with the edit budget and the bound of each item."""

    def __init__(self, ids: list, items: list[bytes], q: int, max_rate: float):
        self.q, self.ids = q, ids
        block = Characters(items)
        self.items = [block.text(i) for i in range(len(items))]
        self.n = n = block.lengths
        self.edits = (n * max_rate).astype(np.int64)
        self.bound = n - q + 1 - q * self.edits
        grams = n - q + 1
        item = np.repeat(np.arange(len(items)), grams)
        at = np.arange(len(item)) - np.repeat(np.cumsum(grams) - grams, grams)
        begins = block.begins[item] + at
        hashes = block.spans(begins, begins + q)
        order = np.argsort(hashes, kind="stable")
        self.grams, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.at = item[order], at[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, block: Characters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, item, least diagonal of every band (of 2 * e diagonals) that reaches its item's bound."""
        q = self.q
        none = np.zeros(0, np.int64)
        if len(block.data) < q:
            return none, none, none
        starts = np.arange(len(block.data) - q + 1)
        hashes = block.spans(starts, starts + q)
        hit = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.grams, hashes[hit]), len(self.grams) - 1)
        true = self.grams[which] == hashes[hit]
        hit, which = hit[true], which[true]
        if not len(hit):
            return none, none, none
        counts = self.first[which + 1] - self.first[which]
        posting = np.repeat(self.first[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        item, at = self.item[posting], self.at[posting]
        begin = np.repeat(hit, counts)
        text = np.searchsorted(block.begins, begin, "right") - 1
        # diagonals from -n on: shifted by the longest item so that they are positive
        longest = int(self.n.max())
        band = (begin - block.begins[text] - at + longest) // np.maximum(1, self.edits[item])
        width = int(block.lengths.max() + longest + 2) + 1
        key = (text * len(self.items) + item) * width + band
        key, at = np.concatenate([key, key - 1]), np.concatenate([at, at])
        for once in (False, True):  # all shared q-grams first, then each place of the item once
            order = np.lexsort((at, key)) if once else np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            if once:
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
                key, at = key[new], at[new]
            change = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            number = np.diff(np.append(change, len(key)))
            good = number >= self.bound[(key[change] // width) % len(self.items)]
            keep = np.repeat(good, number)
            key, at = key[keep], at[keep]
            if not len(key):
                return none, none, none
        key = np.unique(key)
        item = (key // width) % len(self.items)
        return key // width // len(self.items), item, (key % width) * np.maximum(1, self.edits[item]) - longest

    def align(self, block: Characters, text: np.ndarray, item: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Per region (sorted by descending length of the item) edits, begin and end of the item's best alignment to a part of the text.

        Edits over the budget are none: begin -1. A cell holds edits * _UNIT + begin, so that one minimum settles both; its
        column is a diagonal (place in the text less place in the item), from low - e to low + 3 * e.
        """
        n, e = self.n[item], self.edits[item]
        width = 4 * int(e.max()) + 1
        base = low - e  # the diagonal of column 0
        length = block.lengths[text]
        columns = np.arange(width)
        x = np.zeros((len(item), int(n.max())), np.int32)
        for r, i in enumerate(item.tolist()):
            x[r, : n[r]] = self.items[i]
        # strip[:, j - 1 + d] is the text's character before place base + j + d
        place = base[:, None] + np.arange(x.shape[1] + width)
        strip = block.data[np.clip(block.begins[text][:, None] + place, 0, len(block.data) - 1)].astype(np.int32)
        strip[(place < 0) | (place >= length[:, None])] = -1
        closed = columns > 4 * e[:, None]
        at = base[:, None] + columns
        row = np.where((at >= 0) & (at <= length[:, None]) & ~closed, at, _NEVER)
        out = np.full((len(item), 3), -1, np.int64)
        out[:, 0] = _NEVER // _UNIT
        slope = columns * _UNIT
        live = np.arange(len(item))
        for j in range(1, x.shape[1] + 1):
            now = live[: np.searchsorted(-n[live], -j, "right")]
            if len(now) < len(live) or j % 8 == 0:
                keep = row[: len(now)].min(1) < (e[now] + 1) * _UNIT
                live, row = now[keep], row[: len(now)][keep]
                if not len(live):
                    break
            part = strip[live, j - 1 : j - 1 + width]
            new = np.where(part >= 0, row + _UNIT * (part != x[live, j - 1][:, None]), _NEVER)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + _UNIT)
            at = base[live][:, None] + (columns + j)
            new[closed[live] | (at < 0) | (at > length[live][:, None])] = _NEVER
            slid = np.minimum.accumulate(new - slope, axis=1) + slope
            row = np.where(new >= _NEVER, np.where(closed[live] | (at < 0) | (at > length[live][:, None]), _NEVER, slid), slid)
            ended = n[live] == j
            if ended.any():
                last = row[ended]
                d = last.argmin(1)
                value = last[np.arange(len(d)), d]
                out[live[ended]] = np.stack([value // _UNIT, value % _UNIT, at[ended][np.arange(len(d)), d]], 1)
        out[out[:, 0] > e, 1] = -1
        return out

    def find(self, block: Characters) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, edits), the best place of each pair, the first of equals."""
        text, item, low = self.regions(block)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        hard = []
        for r, (t, i, d) in enumerate(zip(text.tolist(), item.tolist(), low.tolist())):
            e, begin = int(self.edits[i]), int(block.begins[t])
            first = begin + max(0, d - e)
            piece = block.data[first : max(first, min(begin + int(block.lengths[t]), begin + d + 3 * e + int(self.n[i])))].tobytes()
            at = next(_places(piece, self.items[i].tobytes()), -1)
            if at >= 0:
                at += first - begin
                best[t, i] = min(best.get((t, i), (1 << 60, 0, 0)), (0, at, at + int(self.n[i])))
            elif e and piece:
                hard.append(r)
        hard = np.array([r for r in hard if (int(text[r]), int(item[r])) not in best], np.int64)
        hard = hard[np.argsort(-self.n[item[hard]], kind="stable")]
        for a in range(0, len(hard), _ABREAST):
            some = hard[a : a + _ABREAST]
            for t, i, (edits, begin, end) in zip(text[some].tolist(), item[some].tolist(), self.align(block, text[some], item[some], low[some]).tolist()):
                if begin >= 0:
                    best[t, i] = min(best.get((t, i), (1 << 60, 0, 0)), (edits, begin, end))
        for (t, i), (edits, begin, end) in sorted(best.items()):
            yield t, i, begin, end, edits


class Words:
    """Items that are too short for q-grams: found exact, as whole words."""

    def __init__(self, ids: list, items: list[bytes]):
        block = Characters(items)
        self.ids, self.items = ids, [block.text(i) for i in range(len(items))]

    def find(self, block: Characters) -> Iterator[tuple[int, int, int, int, int]]:
        letter = np.isin(block.data, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)) | (block.data >= 128)
        whole = block.data.tobytes()
        for i, x in enumerate(self.items):
            done = -1
            for at in _places(whole, x.tobytes()):
                t = int(np.searchsorted(block.begins, at, "right")) - 1
                if t != done and not (at and letter[at - 1] and letter[at]) and not (letter[at + len(x)] and letter[at + len(x) - 1]):
                    done = t
                    begin = at - int(block.begins[t])
                    yield t, i, begin, begin + len(x), 0


def indexes(ids: list, items: list[bytes], q: int, max_rate: float) -> list[Index | Words]:
    """The items by the q they take; those under q characters apart."""
    groups: dict[int, list[int]] = {}
    for k, n in enumerate(Characters(items).lengths.tolist()):
        if n:
            groups.setdefault(0 if n < q else min(q, n // (int(n * max_rate) + 1)), []).append(k)
    chosen = lambda at: ([ids[k] for k in at], [items[k] for k in at])
    return [Index(*chosen(at), own, max_rate) if own else Words(*chosen(at)) for own, at in sorted(groups.items())]


def query_blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """The items with text, in blocks of bounded size, one at a time."""
    ids, items, size = [], [], 0
    for row in benchmark.select(key, F.col(text).cast("string")).where(F.length(text) > 0).toLocalIterator():
        x = row[1].encode()
        if items and size + len(x) > block_bytes:
            yield ids, items
            ids, items, size = [], [], 0
        ids.append(row[0])
        items.append(x)
        size += len(x)
    if items:
        yield ids, items


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = Q, max_rate: float = MAX_RATE) -> DataFrame:
    """key, item_id, begin, end (characters of the text), edits, item_length: the best place of each item in each text that holds it."""
    source = docs.select(F.col(key), F.col(text).cast("string"))
    kinds = source.schema[0].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, begin long, end long, edits long, item_length long"
    spark, out = docs.sparkSession, None
    for ids, items in query_blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast((ids, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            every = indexes(*shared.value, q, max_rate)
            kind = pa.array(shared.value[0]).type
            for batch in batches:
                for at, held in texts(batch.column(1)):
                    block = Characters(held)
                    for index in every:
                        if found := list(index.find(block)):
                            t, i, begin, end, edits = zip(*found)
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).slice(at, len(held)).take(pa.array(t)), pa.array([index.ids[j] for j in i], kind), *(pa.array(x, pa.int64()) for x in (begin, end, edits, [len(index.items[j]) for j in i]))],
                                names=[key, item_key, "begin", "end", "edits", "item_length"],
                            )

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
