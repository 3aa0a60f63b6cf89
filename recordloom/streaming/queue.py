"""A leased work queue as two stateful stages over a stream of commands, in which no task holds a whole queue.

1. Items are dealt to shards of their queue by the hash of their name.  A shard keeps its items in keyed state: the first ones in a
   short sorted front, the others one by one in a map, from which the front is refilled.  For each batch it runs its own adds and
   dones in their order and offers those items to the tournament that come to its head in it.
2. The tournament of a queue keeps the claims only, one a worker at most, and runs the batch's claims in their order over what
   the shards have offered: logarithmic time a command, by a heap of free items and one of leases.  Adds that no claim of the
   batch can meet give their row in a lane beside it.

What a shard has to offer: so many items are claimed as there are workers whose lease may run, or who ask in this batch, so a
claim meets one of the first items of a shard, that many and one more.  Those that stand there at some time of the batch, and
those that it names, decide every claim exactly.  For that a shard has to know the workers only: claims are dealt to all
shards by worker, from each Arrow batch once.

A lease is over by the time of the command that looks at it, so claims need no timer; they are dropped with their worker's next
command, or when their lease has run out before a batch begins.

Commands: (queue, seq, at, command, worker, item, urgent); add, claim_next, claim_one, release, done.  Order: at, then seq.

Defined cases: times must not fall from batch to batch; an item that is added again takes its new place; done or claim_one of an
unknown item changes nothing but the worker's other claims; null items and workers are empty names; an empty batch gives no rows.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEASE = 600.0
SHARDS = 8
#: Items that a front holds at least after it is refilled; from four times as many, half of it goes back to the map.
FRONT = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DEALT = "queue string, seq long, at double, command string, worker string, item string, urgent boolean, shard int, mine boolean, since double"
_OFFERS = "queue string, lane int, kind string, seq long, at double, command string, worker string, item string, later boolean"
_OUT = "queue string, seq long, worker string, item string"


class QueueFold:
    """Claims on one queue, in order of the commands."""

    def __init__(self, items: dict[str, tuple[bool, float]] | None = None, claims: dict[str, tuple[str, float]] | None = None, lease: float = LEASE):
        self.items, self.claims, self.lease = items or {}, claims or {}, lease
        # Entries of items that are gone or have another place are passed over when they come up; claimed ones are then set aside.
        self.free = [(*key, i) for i, key in self.items.items()]
        self.leases = [(at, i, w) for i, (w, at) in self.claims.items()]
        heapq.heapify(self.free)
        heapq.heapify(self.leases)
        self.aside: set[str] = set()
        self.held: dict[str, set[str]] = {}
        for i, (w, _) in self.claims.items():
            self.held.setdefault(w, set()).add(i)

    def _back(self, item: str) -> None:
        if item in self.aside:
            self.aside.remove(item)
            heapq.heappush(self.free, (*self.items[item], item))

    def _claim(self, worker: str, at: float, item: str) -> str:
        self.claims[item] = (worker, at)
        self.held.setdefault(worker, set()).add(item)
        heapq.heappush(self.leases, (at, item, worker))
        return item

    def _next(self, at: float) -> str | None:
        """The first item that no lease holds."""
        while self.leases and self.leases[0][0] + self.lease <= at:
            since, item, worker = heapq.heappop(self.leases)
            if self.claims.get(item) == (worker, since):
                self._back(item)
        while self.free:
            later, since, item = heapq.heappop(self.free)
            if self.items.get(item) == (later, since) and item not in self.aside:
                self.aside.add(item)
                claim = self.claims.get(item)
                if claim is None or claim[1] + self.lease <= at:
                    return item
        return None

    def step(self, at: float, command: str, worker: str, item: str, urgent: bool = False) -> str | None:
        """The item that the worker now holds, or its holder if claim_one fails."""
        if command == "add":
            self.items[item] = (not urgent, at)
            self.aside.discard(item)
            heapq.heappush(self.free, (not urgent, at, item))
            return None
        if command == "done":
            self.items.pop(item, None)
            self.claims.pop(item, None)
            self.aside.discard(item)
            return None
        holder = self.claims.get(item)
        if command == "claim_one" and holder and holder[0] != worker and holder[1] + self.lease > at:
            return holder[0]
        for i in self.held.pop(worker, ()):
            if i in self.claims and self.claims[i][0] == worker:
                del self.claims[i]
                self._back(i)
        if command == "claim_one" and item in self.items:
            return self._claim(worker, at, item)
        if command == "claim_next" and (found := self._next(at)) is not None:
            return self._claim(worker, at, found)
        return None


class ShardItems:
    """Items of one shard: front (sorted, kept as one value) and rest (a map with get, put, pop, all)."""

    def __init__(self, front: list[tuple[bool, float, str]], rest: Any):
        self.front, self.rest, self.room = front, rest, FRONT
        self.of = {item: (later, at, item) for later, at, item in front}

    def get(self, item: str) -> tuple[bool, float, str] | None:
        return self.of.get(item) or ((*found, item) if (found := self.rest.get(item)) else None)

    def remove(self, item: str) -> None:
        if key := self.of.pop(item, None):
            del self.front[bisect_left(self.front, key)]
        else:
            self.rest.pop(item)

    def place(self, item: str) -> int | None:
        """Where the item stands in the front."""
        return bisect_left(self.front, key) if (key := self.of.get(item)) else None

    def add(self, item: str, later: bool, at: float) -> None:
        if old := self.of.pop(item, None):
            del self.front[bisect_left(self.front, old)]
        key = (later, at, item)
        if (ahead := bool(self.front) and key < self.front[-1]) or self.rest.empty():
            if ahead and not old:
                self.rest.pop(item)
            insort(self.front, key)
            self.of[item] = key
            if len(self.front) > 4 * self.room:
                for later, at, item in self.front[2 * self.room :]:
                    self.rest.put(item, (later, at))
                    del self.of[item]
                del self.front[2 * self.room :]
        else:
            self.rest.put(item, (later, at))

    def first(self, n: int) -> list[tuple[bool, float, str]]:
        """The first n items; the front is refilled by one pass over the rest when it is too short."""
        if len(self.front) < n and not self.rest.empty():
            for later, at, item in heapq.nsmallest(n - len(self.front) + self.room, self.rest.all()):
                self.rest.pop(item)
                self.front.append((later, at, item))
                self.of[item] = (later, at, item)
        return self.front[:n]


def offers(items: ShardItems, changes: Iterator[tuple[bool, str, bool, float]], depth: int, named: set[str]) -> tuple[dict[str, tuple[bool, float, str]], set[str]]:
    """Run the changes (add, item, later, at) in their order.

    Gives the items from before them that a claim may meet: those named, and those that come among the first `depth`; and all
    items, added ones too, whose changes such a claim depends on.
    """
    offered, met, added = {}, set(named), set()
    items.room = max(items.room, depth)

    def fill() -> None:
        if len(items.front) < depth and not items.rest.empty():
            items.first(depth)
            items.room *= 2  # so the passes over the rest are few, however much of it a batch uses up

    def enter(key: tuple[bool, float, str]) -> None:
        met.add(key[2])
        if key[2] not in added:
            offered[key[2]] = key

    for item in named:
        if found := items.get(item):
            offered[item] = found
    fill()
    for key in items.front[:depth]:
        enter(key)
    for add, item, later, at in changes:
        before = items.place(item)
        if add:
            items.add(item, later, at)
            added.add(item)
        else:
            items.remove(item)
        if not depth:
            continue
        fill()
        if before is not None and before < depth <= len(items.front):
            enter(items.front[depth - 1])
        if add and (now := items.place(item)) is not None and now < depth:
            met.add(item)
    return offered, met


class _Rest:
    """The map of a shard in keyed state; each call of the state is a message to the JVM."""

    def __init__(self, state):
        self.state, self.none = state, None

    def get(self, item: str) -> tuple[bool, float] | None:
        return tuple(self.state.getValue((item,))) if self.state.containsKey((item,)) else None

    def put(self, item: str, value: tuple[bool, float]) -> None:
        self.state.updateValue((item,), value)
        self.none = False

    def pop(self, item: str) -> None:
        if self.none is not True:
            self.state.removeKey((item,))
            self.none = None

    def empty(self) -> bool:
        if self.none is None:
            self.none = not self.state.exists()
        return self.none

    def all(self) -> Iterator[tuple[bool, float, str]]:
        return ((bool(v[0]), float(v[1]), k[0]) for k, v in self.state.iterator())


class Shard(StatefulProcessor):
    """Stage 1, by (queue, shard)."""

    def __init__(self, lease: float = LEASE):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.front = handle.getValueState("front", "items string")
        self.rest = handle.getMapState("rest", "item string", "later boolean, at double")
        self.workers = handle.getMapState("workers", "worker string", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        items = ShardItems([tuple(x) for x in json.loads(self.front.get()[0])] if self.front.exists() else [], _Rest(self.rest))
        begin = float(batch.since.min())
        known = {k[0]: v[0] for k, v in self.workers.iterator()}
        live = {w for w, at in known.items() if at + self.lease > begin}
        for old in known.keys() - live:
            self.workers.removeKey((old,))
        claiming = batch[batch.command.isin(["claim_next", "claim_one"])]
        last = claiming.groupby("worker")["at"].max()
        live |= set(last.index)
        for worker, at in last.items():
            self.workers.updateValue((worker,), (float(at),))
        own = batch[batch.mine].sort_values(["at", "seq"])
        changes = own[own.command.isin(["add", "done"])]
        depth = len(live) + 1 if (claiming.command == "claim_next").any() else 0
        offered, met = offers(items, zip(changes.command == "add", changes.item, ~changes.urgent.astype(bool), changes["at"].astype(float), strict=True), depth, set(own.item[own.command == "claim_one"]))
        self.front.update((json.dumps(items.front),))
        lane = ((own.command == "add") & ~own.item.isin(met)) * (key[1] + 1)
        yield pd.DataFrame({"queue": key[0], "lane": lane, "kind": "command", "seq": own.seq, "at": own["at"], "command": own.command, "worker": own.worker, "item": own.item, "later": ~own.urgent.astype(bool)})
        if offered:
            later, at, item = zip(*offered.values(), strict=True)
            yield pd.DataFrame({"queue": key[0], "lane": 0, "kind": "offer", "seq": 0, "at": at, "command": "", "worker": "", "item": item, "later": later})

    def close(self) -> None:
        pass


class Tournament(StatefulProcessor):
    """Stage 2, by (queue, lane): claims run in lane 0, rows of the others pass."""

    def __init__(self, lease: float = LEASE):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getMapState("claims", "item string", "worker string, at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[1]:
            for part in rows:
                yield part[["queue", "seq", "worker"]].assign(item=pd.Series(None, index=part.index, dtype=object))
            return
        every = pd.concat(list(rows))
        commands = every[every.kind == "command"].sort_values(["at", "seq"])
        offers = every[every.kind == "offer"]
        begin = float(commands["at"].min()) if len(commands) else 0.0
        before = {k[0]: (v[0], float(v[1])) for k, v in self.claims.iterator()}
        fold = QueueFold({i: (bool(late), float(at)) for i, late, at in zip(offers.item, offers.later, offers["at"], strict=True)}, {i: c for i, c in before.items() if c[1] + self.lease > begin}, self.lease)
        got = [fold.step(float(at), c, w, i, not late) for at, c, w, i, late in zip(commands["at"], commands.command, commands.worker, commands.item, commands.later, strict=True)]
        for item in before.keys() - fold.claims.keys():
            self.claims.removeKey((item,))
        for item, claim in fold.claims.items():
            if before.get(item) != claim:
                self.claims.updateValue((item,), claim)
        yield pd.DataFrame({"queue": key[0], "seq": commands.seq, "worker": commands.worker, "item": pd.Series(got, index=commands.index, dtype=object)})

    def close(self) -> None:
        pass


def queue_stream(commands: DataFrame, shards: int = SHARDS, lease: float = LEASE) -> DataFrame:
    """queue, seq, worker, item: what each command gave.  The stream must be started under `PROVIDER` (see `drain_queue`)."""
    named = commands.select("queue", "seq", F.col("at").cast("double").alias("at"), "command", *[F.coalesce(c, F.lit("")).alias(c) for c in ("worker", "item")], F.coalesce("urgent", F.lit(False)).alias("urgent"))
    own = F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int")
    home = F.when(F.col("command").isin("claim_next", "release"), 0).otherwise(own)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each command to its shard; and to every shard, as it may hold the head, who claims, from when and until when."""
        for b in batches:
            b = b.append_column("mine", pa.array([True] * len(b), pa.bool_())).append_column("since", b.column("at"))
            yield b
            t = pa.Table.from_batches([b])
            asks = t.filter(pc.is_in(t["command"], pa.array(["claim_next", "claim_one"]))).group_by(["queue", "worker", "command"]).aggregate([("at", "max"), ("at", "min")])
            n = len(asks) * shards
            if n:
                wide = pa.concat_tables([asks] * shards)
                column = {
                    "queue": wide["queue"], "seq": pa.array([0] * n, pa.int64()), "at": wide["at_max"], "command": wide["command"], "worker": wide["worker"], "item": pa.array([""] * n), "urgent": pa.array([False] * n),
                    "shard": pa.array([k for k in range(shards) for _ in range(len(asks))], pa.int32()), "mine": pa.array([False] * n), "since": wide["at_min"],
                }
                yield from pa.table({c: column[c] for c in b.schema.names}).cast(b.schema).combine_chunks().to_batches()

    dealt = named.withColumn("shard", home).mapInArrow(deal, _DEALT)
    offered = dealt.groupBy("queue", "shard").transformWithStateInPandas(Shard(lease), _OFFERS, "Append", "None")
    return offered.groupBy("queue", "lane").transformWithStateInPandas(Tournament(lease), _OUT, "Append", "None")


def drain_queue(stream: DataFrame, path: str) -> DataFrame:
    """Run the queue over the commands that there are and read what all runs gave; state and output stay under `path` for the next run."""
    from recordloom.streaming.state import drain

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, PROVIDER)
    try:
        return drain(stream, path)
    finally:
        conf.set(name, before)
