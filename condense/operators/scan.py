"""Ordered folds as a parallel prefix scan: a hot key's rows are spread over all tasks.

A fold whose state is small has transition functions that can be written down: what a whole block of rows
does to any state.  So rows are dealt by ranges of key and order and cut into blocks; each block is
summarised as a function; a short scan goes through a key's functions, one row a block, and gives each
block the state that it begins with; blocks then run side by side.  Keys, orders and values stay in Arrow
arrays with their own types, so nulls and 64-bit numbers are exact.

A :class:`Machine` says what a summary is and how it is applied.
"""

from __future__ import annotations

import bisect
import pickle
from collections import OrderedDict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Rows of a block at most; Arrow batches are no longer than this by default.
BLOCK_ROWS = 10_000


class Machine:
    """A fold in order.  ``rows`` are Arrow tables of a block; states and summaries can be pickled.

    ``after(state, summary(rows))`` must be the state that running ``rows`` from ``state`` ends in.
    """

    #: Columns that are read, and (as DDL) those that :meth:`run` gives for each row.
    reads: list[str] = []
    gives: str = ""

    def start(self) -> Any:
        raise NotImplementedError

    def summary(self, rows: pa.Table) -> Any:
        raise NotImplementedError

    def after(self, state: Any, summary: Any) -> Any:
        raise NotImplementedError

    def run(self, state: Any, rows: pa.Table) -> list[pa.Array]:
        raise NotImplementedError

    def last(self, state: Any) -> tuple:
        """What :func:`last` reports of a key's final state."""
        raise NotImplementedError


def changes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; nulls equal nulls, and NaN equals NaN.  The first differs."""
    out = np.zeros(len(column), bool)
    out[:1] = True
    if len(column) < 2:
        return out
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(column.type):
        other = pc.and_(other, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
    out[1:] = pc.or_(other, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def blocks(rows: DataFrame, key: str, order: list[str], machine: Machine, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``block, key, rows, summary``: consecutive rows of one key in order; blocks are numbered in order."""
    by = list(dict.fromkeys([key, *order, *machine.reads]))
    held = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changes(batch.column(key))
            new[::block_rows] = True
            at = [*np.flatnonzero(new).tolist(), batch.num_rows]
            table = pa.Table.from_batches([batch])
            made = [pickle.dumps(machine.summary(table.slice(a, b - a)), 5) for a, b in zip(at[:-1], at[1:], strict=True)]
            structs = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            columns = [
                pa.array(range(number, number + len(made)), pa.int64()), batch.column(key).take(pa.array(at[:-1])),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), structs), pa.array(made, pa.binary()),
            ]
            number += len(made)
            yield pa.RecordBatch.from_arrays(columns, ["block", "key", "rows", "summary"])

    dealt = rows.repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by)
    kind = rows.schema[key].dataType.simpleString()
    return dealt.mapInArrow(run, f"block bigint, key {kind}, rows array<struct<{held}>>, summary binary")


def starts(summaries: DataFrame, machine: Machine) -> DataFrame:
    """From ``block, key, summary``: ``block, key, state, final``: the state before each block, and that after
    it where it is the key's last (else null).  One short row a block."""
    kind = summaries.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # the open block of a key: its number, key, state before and after

        def out(rows: list[list]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), key_type, pa.binary(), pa.binary()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["block", "key", "state", "final"])

        key_type, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_type, rows = batch.schema.field("key").type, []
            column = batch.column("key")
            same = before is not None and not changes(pa.concat_arrays([before, column.slice(0, 1)]))[1]
            new = changes(column)
            new[0] = not same
            for fresh, number, own, summary in zip(new.tolist(), batch.column("block").to_pylist(), column.to_pylist(), batch.column("summary").to_pylist(), strict=True):
                if now:
                    rows.append([now[0], now[1], now[2], pickle.dumps(now[3], 5) if fresh else None])
                state = machine.start() if fresh else now[3]
                now = [number, own, pickle.dumps(state, 5), machine.after(state, pickle.loads(summary))]
            before = column.slice(len(column) - 1)
            if rows:
                yield out(rows)
        if now:
            yield out([[now[0], now[1], now[2], pickle.dumps(now[3], 5)]])

    dealt = summaries.select("block", "key", "summary").repartition("key").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, f"block bigint, key {kind}, state binary, final binary")


def scan(rows: DataFrame, key: str, order: list[str], machine: Machine, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with what ``machine`` gives for each.  Rows of equal order are told apart by the columns
    that the machine reads; a null order comes first.  Blocks are written to the shared folder when this is called."""
    cut = stored(blocks(rows, key, order, machine, block_rows), "scan-blocks")
    states = starts(cut, machine).select("block", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ends = batch.column("rows"), np.cumsum([0, *pc.list_value_length(batch.column("rows")).to_pylist()])
            every = pa.Table.from_batches([pa.RecordBatch.from_struct_array(held.flatten())])
            for i, state in enumerate(batch.column("state").to_pylist()):
                own = every.slice(int(ends[i]), int(ends[i + 1] - ends[i])).combine_chunks()
                made = machine.run(pickle.loads(state), own)
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in own.columns), *made], [*own.column_names, *_names(machine.gives)])

    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return cut.select("block", "rows").join(states, "block").select("rows", "state").mapInArrow(run, f"{held}, {machine.gives}")


def last(rows: DataFrame, key: str, order: list[str], machine: Machine, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key`` and ``schema``: what ``machine.last`` reports of each key after its last row.  Only functions
    of blocks leave a task, so nothing is written or read again."""
    kind = rows.schema[key].dataType.simpleString()
    need = list(dict.fromkeys([key, *order, *machine.reads]))
    cut = blocks(rows.select(*need), key, order, machine, block_rows).select("block", "key", "summary")
    final = starts(cut, machine).where("final is not null").select("key", "final")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [machine.last(pickle.loads(x)) for x in batch.column("final").to_pylist()]
            columns = zip(*made, strict=True) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [key, *names])

    names, types = _names(schema), arrow_types(schema)
    return final.mapInArrow(run, f"`{key}` {kind}, {schema}")


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.split(",")]


def arrow_types(schema: str) -> list[pa.DataType]:
    """Arrow types of a DDL schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]


class Automaton(Machine):
    """A finite automaton over symbols ``0, 1, ...`` with counters.

    ``moves[symbol][state]`` is the next state; a counter is ``(resets, adds)``, both by symbol and state: it
    is set to nought first where it resets, then raised.  A block is the map of every state to its end, with
    what happens to each counter on the way; maps are composed pairwise, whole arrays at a time.
    """

    def __init__(self, reads: str, moves: list[list[int]], counters: list[tuple[list[list[bool]], list[list[int]]]], start: int = 0):
        self.reads, self.first = [reads], start
        self.moves = np.array(moves, np.int64)
        self.resets = [np.array(r, bool) for r, _ in counters]
        self.adds = [np.array(a, np.int64) for _, a in counters]

    def symbols(self, rows: pa.Table) -> np.ndarray:
        """Symbol of each row: of a boolean, whether it is true."""
        return pc.fill_null(rows.column(self.reads[0]), False).to_numpy().astype(np.int64)

    def start(self) -> tuple:
        return (self.first, *[0] * len(self.adds))

    def summary(self, rows: pa.Table) -> tuple:
        s = self.symbols(rows)
        to, resets, adds = self.moves[s], [r[s] for r in self.resets], [a[s] for a in self.adds]
        while to.shape[0] > 1:
            rest = slice(to.shape[0] - to.shape[0] % 2, None)
            f, g = slice(0, rest.start, 2), slice(1, rest.start, 2)
            via = lambda x, f=f, g=g: np.take_along_axis(x[g], to[f], 1)  # noqa: B023, E731
            new = [via(r) for r in resets]
            adds = [np.concatenate([np.where(n, 0, a[f]) + via(a), a[rest]]) for n, a in zip(new, adds, strict=True)]
            resets = [np.concatenate([n | r[f], r[rest]]) for n, r in zip(new, resets, strict=True)]
            to = np.concatenate([via(to), to[rest]])
        return to[0], [r[0] for r in resets], [a[0] for a in adds]

    def after(self, state: tuple, summary: tuple) -> tuple:
        at, to = state[0], summary[0]
        return (int(to[at]), *((0 if r[at] else c) + int(a[at]) for c, r, a in zip(state[1:], *summary[1:], strict=True)))


class Breaker(Automaton):
    """A circuit breaker: states are the failures in a row while closed, the turns since it opened, and half-open."""

    gives = "state string, failures bigint, opened bigint"

    def __init__(self, failed: str, threshold: int = 3, rest: int = 5):
        closed, waits = max(1, threshold), max(1, rest)
        half = closed + waits
        to_open = [closed] * (half + 1)
        wait = [*range(closed), *(c + 1 for c in range(closed, half)), half]
        good, bad = list(wait), list(wait)
        for c in [*range(closed), half]:
            good[c] = 0
            bad[c] = c + 1 if c + 1 < closed else to_open[c]
        still = [c in range(closed, half) for c in range(half + 1)]
        opens = [[0] * (half + 1), [int(not still[c] and bad[c] == closed) for c in range(half + 1)]]
        failures = ([[not x for x in still], [False] * (half + 1)], [[0] * (half + 1), [int(not x) for x in still]])
        super().__init__(failed, [good, bad], [failures, ([[False] * (half + 1)] * 2, opens)])
        self.closed, self.half = closed, half

    def last(self, state: tuple) -> tuple:
        name = "closed" if state[0] < self.closed else "half-open" if state[0] == self.half else "open"
        return name, state[1], state[2]

    def run(self, state: tuple, rows: pa.Table) -> list[pa.Array]:
        out = []
        for s in self.symbols(rows).tolist():
            at = state[0]
            state = (int(self.moves[s, at]), *((0 if r[s, at] else c) + int(a[s, at]) for c, r, a in zip(state[1:], self.resets, self.adds, strict=True)))
            out.append(self.last(state))
        return [pa.array(list(c)) for c in zip(*out, strict=True)]


class ResetPeak(Machine):
    """A running peak that starts anew at a value under ``share`` of it and more than ``least_drop`` below it;
    gives how often it has.

    From any peak a block does one of three things: nothing, until its end; or some value reaches the peak; or
    some value falls far enough below it.  From that value on the peak is that value, whatever it was.  Values
    that are the first to reach or to fall below some peak are records of the block, so a summary holds records
    with the end of their course; it is no longer than the block, and as a rule very short.
    """

    gives = "epoch bigint"

    def __init__(self, size: str, share: float, least_drop: int):
        self.reads, self.share, self.least_drop = [size], share, least_drop

    def falls(self, peak, value) -> bool:
        return value < peak * self.share and peak - value > self.least_drop

    def start(self) -> tuple:
        return 0, 0

    def summary(self, rows: pa.Table) -> tuple:
        x = [v for v in rows.column(self.reads[0]).to_pylist() if v is not None]
        n = len(x)
        end: list[tuple] = [(0, 0)] * n
        up: list[int] = []    # values after the present one, each larger than all between
        down: list[int] = []  # the same, each smaller
        for i in range(n - 1, -1, -1):
            while up and x[up[-1]] < x[i]:
                up.pop()
            reached = up[-1] if up else n
            # from the nearest on, values in ``down`` get smaller, and whether they fall is monotone
            low, high = 0, len(down)
            while low < high:
                half = (low + high) // 2
                if self.falls(x[i], x[down[half]]):
                    low = half + 1
                else:
                    high = half
            fallen = down[low - 1] if low else n
            if reached == fallen == n:
                end[i] = (x[i], 0)
            elif reached < fallen:
                end[i] = end[reached]
            else:
                end[i] = (end[fallen][0], end[fallen][1] + 1)
            up.append(i)
            while down and x[down[-1]] >= x[i]:
                down.pop()
            down.append(i)
        peaks, lows = [], []
        for i, v in enumerate(x):
            if not peaks or v > peaks[-1][0]:
                peaks.append((v, i, *end[i]))
            if not lows or v < lows[-1][0]:
                lows.append((v, i, *end[i]))
        return peaks, lows

    def after(self, state: tuple, summary: tuple) -> tuple:
        peak, epoch = state
        peaks, lows = summary
        i = bisect.bisect_left(peaks, peak, key=lambda r: r[0])
        j = bisect.bisect_left(lows, True, key=lambda r: self.falls(peak, r[0]))
        reached, fallen = peaks[i] if i < len(peaks) else None, lows[j] if j < len(lows) else None
        if reached is None and fallen is None:
            return state
        if fallen is None or (reached is not None and reached[1] < fallen[1]):
            return reached[2], epoch + reached[3]
        return fallen[2], epoch + 1 + fallen[3]

    def run(self, state: tuple, rows: pa.Table) -> list[pa.Array]:
        (peak, epoch), out = state, []
        for v in rows.column(self.reads[0]).to_pylist():
            if v is not None:
                if self.falls(peak, v):
                    peak, epoch = v, epoch + 1
                elif v > peak:
                    peak = v
            out.append(epoch)
        return [pa.array(out, pa.int64())]

    def last(self, state: tuple) -> tuple:
        return state


class RunningMean(Machine):
    """A mean of ``chars / tokens`` that turns into an exponential one of weight ``1 / memory`` after ``memory`` samples.

    A block is a function of how many samples came before and of their mean: sums of its first samples, and what
    is added from each of them on once the mean is exponential.
    """

    gives = "samples bigint, chars_per_token double"

    def __init__(self, chars: str, tokens: str, memory: int):
        self.reads, self.memory = [chars, tokens], memory

    def _ratios(self, rows: pa.Table) -> np.ndarray:
        chars, tokens = (np.array(rows.column(c).to_pylist(), np.float64) for c in self.reads)
        return chars / tokens

    def start(self) -> tuple:
        return 0, 0.0

    def summary(self, rows: pa.Table) -> tuple:
        r = self._ratios(rows)
        n, keep = r.size, 1 - 1 / self.memory
        some = min(n, self.memory)
        weighed = r / self.memory * keep ** np.arange(n - 1, -1, -1)
        rest = np.concatenate([np.cumsum(weighed[::-1])[::-1], [0.0]])[: some + 1]
        return n, np.concatenate([[0.0], np.cumsum(r[:some])]), rest

    def after(self, state: tuple, summary: tuple) -> tuple:
        (n, mean), (size, sums, rest) = state, summary
        plain = min(size, max(0, self.memory - n))
        if plain:
            mean = (mean * n + float(sums[plain])) / (n + plain)
        if plain < size:
            mean = mean * (1 - 1 / self.memory) ** (size - plain) + float(rest[plain])
        return n + size, mean

    def run(self, state: tuple, rows: pa.Table) -> list[pa.Array]:
        (n, mean), out = state, []
        for r in self._ratios(rows).tolist():
            mean += (r - mean) / min(n + 1, self.memory)
            n += 1
            out.append((n, mean))
        return [pa.array(list(c)) for c in zip(*out, strict=True)]

    def last(self, state: tuple) -> tuple:
        return state


class LastHashes(Machine):
    """Deliveries of hashes, of which the ``newest`` different ones are remembered with their epoch; gives whether a
    hash was remembered in the same epoch.  A block leaves its own newest hashes behind those before."""

    gives = "safe boolean"

    def __init__(self, hash_: str, epoch: str, newest: int):
        self.reads, self.newest = [hash_, epoch], newest

    def start(self) -> OrderedDict:
        return OrderedDict()

    def _touch(self, held: OrderedDict, pairs) -> OrderedDict:
        for hash_, epoch in pairs:
            held.pop(hash_, None)
            held[hash_] = epoch
            if len(held) > self.newest:
                held.popitem(last=False)
        return held

    def _pairs(self, rows: pa.Table) -> Iterator[tuple]:
        return zip(*(rows.column(c).to_pylist() for c in self.reads), strict=True)

    def summary(self, rows: pa.Table) -> list[tuple]:
        return list(self._touch(OrderedDict(), self._pairs(rows)).items())

    def after(self, state: OrderedDict, summary: list[tuple]) -> OrderedDict:
        return self._touch(state.copy(), summary)

    def run(self, state: OrderedDict, rows: pa.Table) -> list[pa.Array]:
        out = []
        for hash_, epoch in self._pairs(rows):
            out.append(hash_ in state and state[hash_] == epoch)
            self._touch(state, [(hash_, epoch)])
        return [pa.array(out, pa.bool_())]


class RollingFit(Machine):
    """Least squares of ``tokens`` on ``ascii`` over the last ``fitted`` samples, at every sample; a block leaves
    its last samples.  Sums are whole numbers and slide over the borders of blocks, so they are exact."""

    gives = "fitted bigint, slope double, intercept double"

    def __init__(self, ascii_: str, tokens: str, fitted: int = 200):
        self.reads, self.fitted = [ascii_, tokens], fitted

    def start(self) -> np.ndarray:
        return np.zeros((0, 2), np.int64)

    def summary(self, rows: pa.Table) -> np.ndarray:
        return np.array([rows.column(c).to_numpy() for c in self.reads], np.int64).T[-self.fitted:]

    def after(self, state: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return np.concatenate([state, summary])[-self.fitted:]

    def run(self, state: np.ndarray, rows: pa.Table) -> list[pa.Array]:
        own = np.array([rows.column(c).to_numpy() for c in self.reads], np.int64).T
        x, y = np.concatenate([state, own]).T
        end = np.arange(state.shape[0], state.shape[0] + own.shape[0]) + 1
        begin = np.maximum(0, end - self.fitted)
        # from the first value on, so that squares of sums stay small
        dx, dy = x - x[:1], y - y[:1]

        def slid(v: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(v)])
            return total[end] - total[begin]

        n, sx, sy, sxx, sxy = end - begin, slid(dx), slid(dy), slid(dx * dx), slid(dx * dy)
        spread = n * sxx - sx * sx
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(spread > 0, (n * sxy - sx * sy) / spread, 0.0)
            level = np.where(spread > 0, (sy - slope * sx) / n + y[:1] - slope * x[:1], 0.0)
        return [pa.array(n, pa.int64()), pa.array(slope), pa.array(level)]
