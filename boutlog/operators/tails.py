"""Counts, means and deviations over the last matches of many contexts, in one ordered, streamed pass over the player's rows.

Each context used to be a window of lags of its own; here a task reads its rows once, players one after the other in the order of their
matches, and computes all contexts by array operations. What is held is a batch, and of the player at its end the rows that later ones
may still look back to: the last n of each context and key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

ROWS = 1 << 14


def known(context: object, kind: str, value: str | None) -> str:
    """The column of a measure over a context."""
    return "_k" + hashlib.md5(repr((context.condition, context.keys, context.n, kind, value)).encode()).hexdigest()[:12]


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _null(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


class _Chunk:
    """Rows of players, each player's in order; groups of equal keys are made once for all contexts."""

    def __init__(self, rows: pa.RecordBatch):
        self.rows, self.n, self.groups = rows, rows.num_rows, {}
        self.values: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.player = self.codes("player")

    def codes(self, name: str) -> np.ndarray:
        return _codes(self.rows.column(name))

    def grouped(self, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """The rows' order by group (in time within it), and each place's first place of its group."""
        if keys not in self.groups:
            group = self.player
            for k in keys:
                codes = self.codes(k)
                group = group * (codes.max(initial=0) + 1) + codes
            order = np.argsort(group, kind="stable")
            there = group[order]
            new = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
            self.groups[keys] = order, np.repeat(new, np.diff(np.r_[new, self.n]))
        return self.groups[keys]

    def value(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where null) and whether they are there."""
        if name not in self.values:
            column = self.rows.column(name)
            there = ~_null(column)
            self.values[name] = np.where(there, _floats(column), 0.0), there
        return self.values[name]

    def placed(self, flag: str | None, keys: tuple[str, ...]) -> tuple[np.ndarray, ...]:
        """order, whether the row there meets the condition, how many rows before it do, and how many before its group."""
        order, first = self.grouped(keys)
        met = np.ones(self.n, bool) if flag is None else self.rows.column(flag).to_numpy(zero_copy_only=False)[order]
        before = np.cumsum(met) - met
        return order, met, before, before[first]

    def measured(self, flag: str | None, keys: tuple[str, ...], n: int, measures: Sequence[tuple[str, str | None]]) -> list[pa.Array]:
        order, met, before, begin = self.placed(flag, keys)
        rows = order[met]
        at = [np.maximum(before - i, 0) for i in range(n, 0, -1)]
        inside = [before - i >= begin for i in range(n, 0, -1)]
        whole = np.minimum(before - begin, n)
        sums: dict = {}

        def summed(name: str) -> tuple[np.ndarray, np.ndarray, list]:
            if name not in sums:
                value, there = (x[rows] for x in self.value(name))
                if not len(rows):
                    sums[name] = np.zeros(self.n, np.int64), np.full(self.n, np.nan), []
                else:
                    have = [i & there[p.clip(max=len(rows) - 1)] for p, i in zip(at, inside)]
                    held = [value[p.clip(max=len(rows) - 1)] for p in at]
                    count = sum(h.astype(np.int64) for h in have)
                    total = np.zeros(self.n)
                    for x, h in zip(held, have):
                        total += np.where(h, x, 0.0)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        sums[name] = count, total / count, list(zip(held, have))
            return sums[name]

        out = []
        for kind, name in measures:
            if name is None:
                got, valid = whole, None
            else:
                count, mean, held = summed(name)
                if kind == "count":
                    got, valid = count, None
                elif kind == "mean":
                    got, valid = mean, count > 0
                else:
                    total = np.zeros(self.n)
                    for x, h in held:
                        total += np.where(h, (x - mean) * (x - mean), 0.0)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        got, valid = np.sqrt(total / count), count > 0
            back = np.empty(self.n, np.int64 if kind == "count" else float)
            back[order] = got
            if valid is None:
                out.append(pa.array(back))
            else:
                none = np.empty(self.n, bool)
                none[order] = ~valid
                out.append(pa.array(back, mask=none))
        return out

    def needed(self, flag: str | None, keys: tuple[str, ...], n: int) -> np.ndarray:
        """Rows of the last player that are among the last n of their group."""
        order, met, before, begin = self.placed(flag, keys)
        _, first = self.grouped(keys)
        after = np.cumsum(met)
        last = np.r_[first[1:] != first[:-1], True] if self.n else np.zeros(0, bool)
        ends = np.flatnonzero(last)
        total = np.repeat(after[ends], np.diff(np.r_[-1, ends]))
        out = np.zeros(self.n, bool)
        out[order] = met & (total - before <= n)
        return out & (self.player == self.player[-1])


def tails(view: DataFrame, wanted: Sequence[tuple[object, Sequence[tuple[str, str | None]]]]) -> DataFrame:
    """view with the known() columns of each context's measures; it must be dealt by player."""
    conditions = {c.condition: f"_f{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in wanted)) if c.condition != "true"}
    flagged = view.withColumns({f: F.coalesce(F.expr(c), F.lit(False)) for c, f in conditions.items()}).sortWithinPartitions("player", "tourney_date", "match_num")
    plans: dict[tuple, list[tuple[str, str | None]]] = {}
    for c, measures in wanted:
        held = plans.setdefault((conditions.get(c.condition), c.keys, c.n, c.condition), [])
        held += [m for m in measures if m not in held]
    made = []
    for (_, keys, n, condition), measures in plans.items():
        made += [(known(type(wanted[0][0])(condition, keys, n), kind, value), kind) for kind, value in measures]
    names = view.columns
    reads = list(dict.fromkeys(["player", *[k for c, _ in wanted for k in c.keys], *[v for _, ms in wanted for _, v in ms if v], *conditions.values()]))
    jobs = [(flag, keys, n, measures) for (flag, keys, n, _), measures in plans.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal carried
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            some = rows.select(reads)
            past = 0
            if carried is not None and carried.column("player")[0] == some.column("player")[0]:
                past = carried.num_rows
                some = pa.Table.from_batches([carried, some]).combine_chunks().to_batches()[0]
            chunk = _Chunk(some)
            found = [a.slice(past) for job in jobs for a in chunk.measured(*job)]
            kept = np.zeros(some.num_rows, bool)
            for flag, keys, n, _ in jobs:
                kept |= chunk.needed(flag, keys, n)
            carried = some.filter(pa.array(kept))
            if not carried.num_rows:
                carried = None
            return pa.RecordBatch.from_arrays([*[rows.column(x) for x in names], *found], [*names, *[x for x, _ in made]])

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= ROWS:
                yield done(held)
                held, n = [], 0
        if held:
            yield done(held)

    fields = [T.StructField(x, T.LongType() if kind == "count" else T.DoubleType()) for x, kind in made]
    return flagged.mapInArrow(run, T.StructType([*view.schema.fields, *fields]))
