"""The sharded queue against one ordered fold of each queue."""

import random
import time

import pytest

from recordloom.streaming import queue as Q

SCHEMA = "queue string, seq long, at double, command string, worker string, item string, urgent boolean"


def _commands(seed, n):
    r = random.Random(seed)
    out, at, known = [], 0.0, ["nothing"]
    for seq in range(n):
        at += r.choice([0, 1, 5, 40, 300]) if r.random() < 0.7 else 0
        command = r.choices(["add", "claim_next", "claim_one", "release", "done"], [5, 4, 1, 1, 2])[0]
        item = r.choice(known[-30:]) if command in ("claim_one", "done") or r.random() < 0.1 else f"i{seq}"
        if command == "add":
            known.append(item)
        out.append((r.choice(["a", "a", "b"]), seq, at, command, r.choice("uvwxyz"), item if command in ("add", "claim_one", "done") else None, r.random() < 0.2))
    return out


def _want(commands):
    folds, out = {}, []
    for queue, seq, at, command, worker, item, urgent in sorted(commands, key=lambda x: (x[2], x[1])):
        out.append((queue, seq, worker, folds.setdefault(queue, Q.QueueFold()).step(at, command, worker, item or "", urgent)))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3])
def test_batches(spark, tmp_path, shards):
    commands = _commands(shards, 400)
    folder = str(tmp_path / "landing")
    for i, (a, b) in enumerate([(0, 150), (150, 151), (151, 300), (300, 400)]):
        spark.createDataFrame(commands[a:b], SCHEMA).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        got = Q.drain_queue(Q.queue_stream(stream, shards), str(tmp_path / "queue"))
    assert sorted(map(tuple, got.collect())) == _want(commands)


class _Rest(dict):
    put = dict.__setitem__

    def pop(self, item):
        dict.pop(self, item, None)

    def empty(self):
        return not self

    def all(self):
        return [(*v, k) for k, v in self.items()]


@pytest.mark.parametrize("seed", range(5))
def test_front_and_rest(seed, monkeypatch):
    monkeypatch.setattr(Q, "FRONT", 3)
    r, rest = random.Random(seed), _Rest()
    items, plain, most = Q.ShardItems([], rest), {}, 0
    for i in range(600):
        if r.random() < 0.6:
            item = f"i{r.randrange(80)}"
            key = (r.random() < 0.7, float(r.randrange(50)))
            items.add(item, *key)
            plain[item] = key
        else:
            item = r.choice([*plain, "none"])
            items.remove(item)
            plain.pop(item, None)
        n = r.randrange(0, 6)
        assert items.first(n) == sorted((*v, k) for k, v in plain.items())[:n]
        assert items.get(item) == ((*plain[item], item) if item in plain else None)
        most = max(most, len(items.front))
    assert most <= 13 and len(rest) + len(items.front) == len(plain)


class _PlainFold(Q.QueueFold):
    """The rule as it is read: all items are looked through for each claim."""

    def step(self, at, command, worker, item, urgent=False):
        if command == "add":
            self.items[item] = (not urgent, at)
        elif command == "done":
            self.items.pop(item, None)
            self.claims.pop(item, None)
        else:
            holder = self.claims.get(item)
            if command == "claim_one" and holder and holder[0] != worker and holder[1] + self.lease > at:
                return holder[0]
            self.claims = {i: c for i, c in self.claims.items() if c[0] != worker}
            free = [i for i in self.items if i not in self.claims or self.claims[i][1] + self.lease <= at] if command == "claim_next" else [item] if command == "claim_one" and item in self.items else []
            if free:
                item = min(free, key=lambda i: (*self.items[i], i))
                self.claims[item] = (worker, at)
                return item
        return None


@pytest.mark.parametrize("seed", range(20))
def test_fold_against_the_plain_rule(seed):
    fold, plain = Q.QueueFold(), _PlainFold()
    for _, _, at, command, worker, item, urgent in sorted(_commands(seed, 1500), key=lambda x: (x[2], x[1])):
        assert fold.step(at, command, worker, item or "", urgent) == plain.step(at, command, worker, item or "", urgent)
        assert fold.claims == plain.claims and fold.items == plain.items


def test_claims_do_not_look_through_all_items():
    n = 30_000
    fold, begin = Q.QueueFold({f"i{i:06}": (True, float(i)) for i in range(n)}), time.process_time()
    got = [fold.step(n + i / 100, "claim_next", f"w{i % 1000}", "") for i in range(n)]
    assert got[:1000] == [f"i{i:06}" for i in range(1000)] and None not in got
    assert time.process_time() - begin < 20


@pytest.mark.parametrize("seed", range(10))
def test_offers_decide_every_claim(seed, monkeypatch):
    """Batches of one shard: what is offered and met gives the claims that all items give, and dones of other items offer nothing."""
    monkeypatch.setattr(Q, "FRONT", 2)
    commands = sorted((c for c in _commands(seed, 1200) if c[0] == "a"), key=lambda x: (x[2], x[1]))
    plain, claims, front, rest = _PlainFold(), {}, [], _Rest()
    for k in range(0, len(commands), 70):
        batch = commands[k : k + 70]
        items = Q.ShardItems(front, rest)
        changes = [(c[3] == "add", c[5], not c[6], c[2]) for c in batch if c[3] in ("add", "done")]
        offered, met = Q.offers(items, iter(changes), 7, {c[5] for c in batch if c[3] == "claim_one"})
        front, fold = items.front, Q.QueueFold({i: x[:2] for i, x in offered.items()}, claims)
        for _, _, at, command, worker, item, urgent in batch:
            want = plain.step(at, command, worker, item or "", urgent)
            if command != "add" or item in met:
                assert fold.step(at, command, worker, item or "", urgent) == want
        claims = fold.claims
        assert claims == plain.claims
    items = Q.ShardItems([], _Rest({f"i{i:04}": (True, float(i)) for i in range(1000)}))
    offered, met = Q.offers(items, iter([(False, f"none{i}", False, 0.0) for i in range(500)]), 3, set())
    assert len(offered) == 3 and len(items.front) <= 10
