"""Ordered per-key reducers: a segmented fold with carry.

The reference pipes each key's rows, in order, through a reducer script. Here a
reducer is a ``Machine``: a state that any stretch of a key's rows can be folded
to, an associative ``merge`` of two neighbouring states, and what is emitted
given the state before. So no key has to be in one task:

1. Rows are range-partitioned by (key, order), which gives shares of about equal
   size however many rows one key has, and written with their share's number.
   The same pass folds the first and the last key of every share (all others
   begin and end inside it): two states a share at most.
2. The states of a key that lies in several shares are merged in order, which
   gives every share the state that its first key starts with.
3. Each share replays its rows once from that state and emits.

A machine works on whole Arrow batches as numpy columns, all keys of a batch at
once; there is no Python call per row or key.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from basketry.session import scratch_path

NEVER = np.iinfo(np.int64).min  # no such time or item
Cols = dict[str, np.ndarray]


class Machine(ABC):
    """A reducer. Rows are columns by name; ``first`` holds the index of every
    key's first row among them; a state is one long per name in ``state``, held
    for several keys at once. The state of no rows is ``zero``."""

    state: tuple[str, ...]
    out: tuple[str, ...]  # columns emitted with the key, all long

    @abstractmethod
    def zero(self, n: int) -> Cols: ...

    @abstractmethod
    def fold(self, rows: Cols, first: np.ndarray) -> Cols:
        """State of each key's rows alone."""

    @abstractmethod
    def merge(self, a: Cols, b: Cols) -> Cols:
        """State of the rows of ``a`` followed by those of ``b`` (associative)."""

    @abstractmethod
    def emit(self, rows: Cols, first: np.ndarray, start: Cols) -> tuple[np.ndarray, Cols]:
        """For keys with the states ``start`` before these rows: which key (its
        number) emits, and the columns emitted."""

    def finish(self, state: Cols) -> tuple[np.ndarray, Cols]:
        """What keys emit when their rows have ended."""
        return np.zeros(0, np.int64), {c: np.zeros(0, np.int64) for c in self.out}


def _last(first: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([first[1:], [n]]) - 1


def _pick(state: Cols, at) -> Cols:
    return {k: v[at] for k, v in state.items()}


def _segments(keys: list[np.ndarray]) -> np.ndarray:
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _numpy(batch, names: list[str]) -> Cols:
    """Columns as numpy; null numbers as ``NEVER``, null texts as None."""
    out = {}
    for c in names:
        col = batch.column(batch.schema.get_field_index(c))
        if pa.types.is_integer(col.type):
            out[c] = col.cast(pa.int64()).fill_null(NEVER).to_numpy(zero_copy_only=False)
        else:
            out[c] = col.to_numpy(zero_copy_only=False)
    return out


def _states(machine: Machine, key: list[str], names: list[str]):
    """Rows of one sorted share pass through; the states of its first and last
    key follow in rows of their own (``_edge`` 0 and 1; one of 2 if there is a
    single key)."""
    def run(batches):
        share, head, tail = None, None, None  # (key values, state)
        sample = None
        for b in batches:
            if not b.num_rows:
                continue
            sample = b
            share = b.column(b.schema.get_field_index("_share"))[0].as_py()
            yield _padded(b, machine)
            rows = _numpy(b, names)
            first = _segments([rows[k] for k in key])
            ends = np.concatenate([first, [b.num_rows]])
            for seg in dict.fromkeys((0, len(first) - 1)):
                part = {c: v[ends[seg]:ends[seg + 1]] for c, v in rows.items()}
                name = tuple(part[k][0] for k in key)
                state = machine.fold(part, np.zeros(1, np.int64))
                if tail is not None and tail[0] == name:
                    state = machine.merge(tail[1], state)
                elif tail is not None and head is None:
                    head = tail
                tail = (name, state)
        if tail is None:
            return
        if head is None:
            edges = [(2, *tail)]
        else:
            edges = [(0, *head), (1, *tail)]
        cols = {c: pa.nulls(len(edges), sample.schema.field(c).type) for c in sample.schema.names}
        for i, k in enumerate(key):
            values = [name[i].item() if hasattr(name[i], "item") else name[i] for _, name, _ in edges]
            cols[k] = pa.array(values, sample.schema.field(k).type)
        cols["_share"] = pa.array([share] * len(edges), sample.schema.field("_share").type)
        cols["_edge"] = pa.array([e for e, _, _ in edges], pa.int32())
        for s in machine.state:
            cols["_s_" + s] = pa.array([int(state[s][0]) for _, _, state in edges], pa.int64())
        yield pa.RecordBatch.from_pydict(cols)
    return run


def _padded(b, machine: Machine):
    extra = [pa.nulls(b.num_rows, pa.int32())] + [pa.nulls(b.num_rows, pa.int64()) for _ in machine.state]
    return pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "_edge", *["_s_" + s for s in machine.state]])


def _carried(machine: Machine, key: list[str]):
    """Edge states of one key (a row for each of its shares): for every share, the
    state before it and whether the key goes on in a later one."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_share", "ascending")])
        states = {s: t.column("_s_" + s).to_numpy() for s in machine.state}
        now, before = machine.zero(1), []
        for i in range(t.num_rows):
            before.append(now)
            now = machine.merge(now, _pick(states, slice(i, i + 1)))
        out = t
        for s in machine.state:
            out = out.set_column(out.schema.get_field_index("_s_" + s), "_s_" + s,
                                 pa.array([int(x[s][0]) for x in before], pa.int64()))
        more = pa.array([1] * (t.num_rows - 1) + [0], pa.int32())
        return out.append_column("_more", more)
    return run


def _replay(machine: Machine, key: list[str], names: list[str], schema: pa.Schema):
    """Shares one after another, each led by its edge rows (``_edge`` not null)."""
    def made(name_cols, which, cols):
        arrays = [pa.array(name_cols[k][which], schema.field(k).type) for k in key]
        for c in machine.out:
            arrays.append(pa.array(cols[c], pa.int64(), mask=cols[c] == NEVER))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        share, now, state, starts, more = None, None, None, {}, set()

        def close():
            if now is not None and now not in more:
                which, cols = machine.finish(state)
                if len(which):
                    yield made({k: np.array([v], object if isinstance(v, str) else None) for k, v in zip(key, now)}, which, cols)

        for b in batches:
            if not b.num_rows:
                continue
            shares = b.column(b.schema.get_field_index("_share")).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(shares[1:] != shares[:-1]) + 1, [b.num_rows]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = b.slice(lo, hi - lo)
                if shares[lo] != share:
                    yield from close()
                    share, now, state, starts, more = shares[lo], None, None, {}, set()
                edge = part.column(part.schema.get_field_index("_edge"))
                n_edges = hi - lo - edge.null_count
                if n_edges:
                    e = _numpy(part.slice(0, n_edges), [*key, "_more", *["_s_" + s for s in machine.state]])
                    for i in range(n_edges):
                        name = tuple(e[k][i] for k in key)
                        starts[name] = {s: e["_s_" + s][i:i + 1] for s in machine.state}
                        if e["_more"][i]:
                            more.add(name)
                    part = part.slice(n_edges)
                    if not part.num_rows:
                        continue
                rows = _numpy(part, names)
                first = _segments([rows[k] for k in key])
                name_cols = {k: rows[k][first] for k in key}
                start = machine.zero(len(first))
                name = tuple(name_cols[k][0] for k in key)
                if name == now:
                    lead = state
                else:
                    yield from close()
                    lead = starts.get(name)
                if lead is not None:
                    for s in machine.state:
                        start[s][0] = lead[s][0]
                which, cols = machine.emit(rows, first, start)
                if len(which):
                    yield made(name_cols, which, cols)
                after = machine.merge(start, machine.fold(rows, first))
                if len(first) > 1:
                    which, cols = machine.finish(_pick(after, slice(0, len(first) - 1)))
                    if len(which):
                        yield made(name_cols, which, cols)
                now = tuple(name_cols[k][-1] for k in key)
                state = _pick(after, slice(len(first) - 1, None))
        yield from close()
    return run


def segmented_fold(df: DataFrame, key: list[str], order: list[str], machine: Machine,
                   columns: list[str], partitions: int | None = None) -> DataFrame:
    """Fold each key's rows, sorted by ``order``, with ``machine``; returns the key
    columns and the machine's ``out``.

    ``columns`` are the row columns (whole numbers) that the machine reads.
    Rows with a null key or a null first order column belong to nobody and are
    dropped. ``order`` should make a key's rows distinct; rows equal in it come in
    any order. Nothing is held but one share's batch and state, so a key may hold
    any part of all rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*dict.fromkeys([*key, *order, *columns])).dropna(subset=[*key, order[0]])
    kept = rows.columns
    by = [F.col(c) for c in (*key, *order)]
    shares = (rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
              .withColumn("_share", F.spark_partition_id()))
    state = ", ".join(f"_s_{s} long" for s in machine.state)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shares.schema.fields)
    path = scratch_path(spark, "fold")
    shares.mapInArrow(_states(machine, key, [*key, *columns]), f"{ddl}, _edge int, {state}").write.parquet(path)
    written = spark.read.parquet(path)
    edges = written.where("_edge is not null")
    edges = edges.groupBy(*key).applyInArrow(
        _carried(machine, key), T.StructType([*written.schema.fields, T.StructField("_more", T.IntegerType())]))
    both = written.where("_edge is null").withColumn("_more", F.lit(None).cast("int")).unionByName(edges)
    lined = both.repartition(n, "_share").sortWithinPartitions(
        "_share", F.col("_edge").asc_nulls_last(), *by)
    out = T.StructType([*[f for f in rows.schema.fields if f.name in key], *[T.StructField(c, T.LongType()) for c in machine.out]])
    return lined.select("_share", "_edge", "_more", *kept, *["_s_" + s for s in machine.state]).mapInArrow(
        _replay(machine, key, [*key, *columns], to_arrow_schema(out)), out)


# -- reducers of the click jobs ----------------------------------------------

class Sessions(Machine):
    """Numbered sessions of a user's clicks: a gap of more than ``timeout`` ends
    one. Emits each with its pages and its last cart and checkout time. ``cart``
    and ``checkout`` are row columns holding the time of such a click, else null.

    State: number of clicks, first and last time, number of gaps, and pages,
    last cart, last checkout of the first (``h``) and the last session (``t``).
    """

    PARTS = ("pages", "cart", "checkout")
    state = ("n", "first", "last", "gaps", *["h" + p for p in PARTS], *["t" + p for p in PARTS])
    out = ("session_no", "pages", "last_cart", "last_checkout")

    def __init__(self, ts: str, cart: str, checkout: str, timeout: int):
        self.ts, self.cart, self.checkout, self.timeout = ts, cart, checkout, timeout

    def zero(self, n):
        full = {s: np.full(n, NEVER) for s in self.state}
        return full | {s: np.zeros(n, np.int64) for s in ("n", "gaps", "hpages", "tpages")}

    def _groups(self, rows, first, breaks):
        """Sessions among the rows: index of their first row, and their parts."""
        at = np.flatnonzero(breaks)
        n = len(rows[self.ts])
        return at, {"pages": np.diff(np.concatenate([at, [n]])),
                    "cart": np.maximum.reduceat(rows[self.cart], at),
                    "checkout": np.maximum.reduceat(rows[self.checkout], at)}

    def _breaks(self, rows, first):
        t = rows[self.ts]
        breaks = np.zeros(len(t), bool)
        breaks[1:] = t[1:] - t[:-1] > self.timeout
        breaks[first] = True
        return breaks

    def fold(self, rows, first):
        last = _last(first, len(rows[self.ts]))
        at, parts = self._groups(rows, first, self._breaks(rows, first))
        head = np.searchsorted(at, first)
        tail = np.searchsorted(at, last, side="right") - 1
        out = {"n": last - first + 1, "first": rows[self.ts][first], "last": rows[self.ts][last], "gaps": tail - head}
        for p in self.PARTS:
            out["h" + p], out["t" + p] = parts[p][head], parts[p][tail]
        return out

    def merge(self, a, b):
        none_a, none_b = a["n"] == 0, b["n"] == 0
        gap = np.where(none_a | none_b, 0, b["first"]) - np.where(none_a | none_b, 0, a["last"]) > self.timeout
        out = {"n": a["n"] + b["n"], "first": np.where(none_a, b["first"], a["first"]),
               "last": np.where(none_b, a["last"], b["last"]), "gaps": a["gaps"] + b["gaps"] + gap}
        for p, join in zip(self.PARTS, (np.add, np.maximum, np.maximum)):
            both = join(a["t" + p], b["h" + p])
            head = np.where((a["gaps"] == 0) & ~gap, both, a["h" + p])
            tail = np.where((b["gaps"] == 0) & ~gap, both, b["t" + p])
            out["h" + p] = np.where(none_a, b["h" + p], np.where(none_b, a["h" + p], head))
            out["t" + p] = np.where(none_a, b["t" + p], np.where(none_b, a["t" + p], tail))
        return out

    def emit(self, rows, first, start):
        """Sessions known to have ended: followed by one of the same key."""
        at, parts = self._groups(rows, first, self._breaks(rows, first))
        head = np.searchsorted(at, first)
        owner = np.searchsorted(first, at, side="right") - 1
        open_ = start["n"] > 0
        gap = open_ & (rows[self.ts][first] - np.where(open_, start["last"], 0) > self.timeout)
        joins = open_ & ~gap  # the first session here began before
        for p, join in zip(self.PARTS, (np.add, np.maximum, np.maximum)):
            parts[p][head[joins]] = join(parts[p][head[joins]], start["t" + p][joins])
        number = start["gaps"][owner] + gap[owner] + 1 + np.arange(len(at)) - head[owner]
        ended = np.concatenate([owner[1:] == owner[:-1], [False]])
        which = np.concatenate([np.flatnonzero(gap), owner[ended]])
        cols = {"session_no": np.concatenate([start["gaps"][gap] + 1, number[ended]])}
        for p, name in zip(self.PARTS, ("pages", "last_cart", "last_checkout")):
            cols[name] = np.concatenate([start["t" + p][gap], parts[p][ended]])
        return which, cols

    def finish(self, state):
        n = len(state["n"])
        return np.arange(n), {"session_no": state["gaps"] + 1, "pages": state["tpages"],
                              "last_cart": state["tcart"], "last_checkout": state["tcheckout"]}


class SeenBefore(Machine):
    """Sales whose user saw a page at most ``within`` earlier. ``seen`` and ``sale``
    are row columns: the time of such a page, and the sale's id, else null.
    State: when the last page was seen."""

    state = ("seen",)
    out = ("sale_id",)

    def __init__(self, ts: str, seen: str, sale: str, within: int):
        self.ts, self.seen, self.sale, self.within = ts, seen, sale, within

    def zero(self, n):
        return {"seen": np.full(n, NEVER)}

    def fold(self, rows, first):
        return {"seen": np.maximum.reduceat(rows[self.seen], first)}

    def merge(self, a, b):
        return {"seen": np.maximum(a["seen"], b["seen"])}

    def emit(self, rows, first, start):
        t, n = rows[self.ts], len(rows[self.ts])
        owner = np.searchsorted(first, np.arange(n), side="right") - 1
        at = np.maximum.accumulate(np.where(rows[self.seen] != NEVER, np.arange(n), -1))
        inside = at >= first[owner]
        seen = np.where(inside, rows[self.seen][np.maximum(at, 0)], start["seen"][owner])
        hit = (rows[self.sale] != NEVER) & (seen != NEVER)
        hit[hit] = t[hit] - seen[hit] <= self.within
        return owner[hit], {"sale_id": rows[self.sale][hit]}


class LastSeen(Machine):
    """For each purchase the last ``n`` items viewed, at most ``within`` older.
    ``view`` and ``buy`` are row columns with the item viewed or bought, else null.
    State: times and items of the last n views, the latest first."""

    out = ("purchased_item", "lastviewed_item")

    def __init__(self, ts: str, view: str, buy: str, within: int, n: int):
        self.ts, self.view, self.buy, self.within, self.n = ts, view, buy, within, n
        self.state = tuple(f"{c}{k}" for k in range(n) for c in "ti")

    def zero(self, n):
        return {s: np.full(n, NEVER) for s in self.state}

    def _views(self, rows, first):
        """Index of every view, and by key the number of views up to its end."""
        at = np.flatnonzero(rows[self.view] != NEVER)
        return at, np.searchsorted(at, first), np.searchsorted(at, _last(first, len(rows[self.ts])), side="right")

    def _back(self, rows, at, low, high, start, owner, k):
        """Time and item of the view ``k`` before place ``high`` of the view list;
        those before ``low`` are the start state's."""
        pos = high - 1 - k
        inside = pos >= low
        own = at[np.where(inside, pos, 0)] if len(at) else np.zeros(len(pos), np.int64)
        over = np.where(inside, 0, low - 1 - pos)  # which of the start's
        old = [np.stack([start[f"{c}{j}"] for j in range(self.n)]) for c in "ti"]
        return tuple(np.where(inside, rows[c][own], o[np.minimum(over, self.n - 1), owner])
                     for c, o in zip((self.ts, self.view), old))

    def fold(self, rows, first):
        at, low, high = self._views(rows, first)
        zero, out = self.zero(len(first)), {}
        for k in range(self.n):
            out[f"t{k}"], out[f"i{k}"] = self._back(rows, at, low, high, zero, np.arange(len(first)), k)
        return out

    def merge(self, a, b):
        have = sum((b[f"t{k}"] != NEVER).astype(np.int64) for k in range(self.n))
        out = {}
        for c in "ti":
            old = np.stack([a[f"{c}{j}"] for j in range(self.n)])
            for k in range(self.n):
                from_a = old[np.maximum(k - have, 0), np.arange(old.shape[1])]
                out[f"{c}{k}"] = np.where(k < have, b[f"{c}{k}"], from_a)
        return out

    def emit(self, rows, first, start):
        at, low, _ = self._views(rows, first)
        buys = np.flatnonzero(rows[self.buy] != NEVER)
        owner = np.searchsorted(first, buys, side="right") - 1
        high = np.searchsorted(at, buys)
        which, bought, viewed = [], [], []
        for k in range(self.n):
            t, item = self._back(rows, at, low[owner], high, start, owner, k)
            ok = t != NEVER
            ok[ok] = rows[self.ts][buys][ok] - t[ok] <= self.within
            which.append(owner[ok])
            bought.append(rows[self.buy][buys][ok])
            viewed.append(item[ok])
        return np.concatenate(which), {"purchased_item": np.concatenate(bought), "lastviewed_item": np.concatenate(viewed)}
