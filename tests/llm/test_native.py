"""The operators that are built of DataFrame functions, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import decontaminate as D
from recordloom.llm import exact_dedup as E
from recordloom.llm import sharding as S
from recordloom.llm import url_filter as U
from recordloom.llm.common import join_hot
from recordloom.llm.rows import keep_rows

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    return W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def _contaminated(docs, items, span=13):
    out = {}
    for d, t in docs:
        w = _words(t)
        hit, which = set(), set()
        for i, x in items:
            iw = _words(x)
            n = min(span, len(iw))
            windows = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    which.add(str(i))
        out[d] = (len(w), sorted(hit), sorted(which), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontaminate(spark):
    r = random.Random(3)
    vocab = ["the", "of", "Über", "a1", "zz", "Q", "漢字", "x9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 13, 14, 60, 12, 5, 3, 1, 25])]
    items += [(20, None), (21, "..."), (22, "the " * 30), (1, "a second text of one item that has more than thirteen words in all of it")]
    docs = []
    for i in range(60):
        w = [r.choice(vocab + [f"w{r.randrange(99)}"]) for _ in range(r.randrange(0, 80))]
        if i % 2:
            x = (r.choice(items)[1] or "").split()
            a = r.randrange(0, max(1, len(x)))
            at = r.randrange(0, len(w) + 1)
            w[at:at] = x[a : a + r.randrange(1, 40)]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, "the " * 3000), (103, (items[0][1] + " ") * 50)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.hit_at, x.item_ids, x.contaminated) for x in D.decontaminate(df, bench).collect()}
    want = _contaminated(docs, items)
    assert got == want
    twice = df.unionByName(df.filter("doc_id = 103"))
    assert D.decontaminate(twice, bench).filter("doc_id = 103 AND contaminated").count() == 2
    none = D.decontaminate(df, bench.limit(0)).agg(F.sum("n_hit"), F.count("doc_id")).first()
    assert tuple(none) == (0, len(docs))
    assert D.decontaminate(df.limit(0), bench).count() == 0


def test_exact_dedup(spark):
    rows = [(1, "a", 1), (2, "b", 1), (3, "a", 1), (4, None, 1), (5, "", 1), (3, "a", 1), (6, "A", 1), (7, "x" * 200_000, 1), (8, "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    for keep, pick in (("max", max), ("min", min)):
        got = E.exact_dedup(df, keep=keep).collect()
        assert len(got) == len(rows)
        groups = defaultdict(list)
        for d, t, _ in rows:
            groups[t or ""].append(d)
        seen = defaultdict(int)
        for x in got:
            t = next(t or "" for d, t, _ in rows if d == x.doc_id)
            assert (x.keep_id, x.group_size, x.text_sha256) == (pick(groups[t]), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())
            seen[t] += x.kept
        assert set(seen.values()) == {1}
    assert E.exact_dedup(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    for keep in ("min", "max"):
        assert sorted((x.doc_id or 0, x.keep_id or 0, x.group_size, x.kept) for x in E.exact_dedup(null, keep=keep).collect()) == [(0, 0, 2, False), (0, 0, 2, True), (0, 4, 2, False), (4, 4, 2, True)]


def test_an_index_takes_batch_after_batch(spark, tmp_path):
    batches = [[(1, "a"), (2, "b"), (2, "b"), (None, "n")], [(3, "a"), (4, "c"), (0, "b"), (5, "n"), (6, None)], [], [(7, "c"), (8, ""), (9, "d"), (1, "a")]]
    for keep, pick in (("min", min), ("max", max)):
        ids, before = defaultdict(list), 0
        for k, rows in enumerate(batches):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
            for d, t in rows:
                ids[t or ""].append(d)
            got = E.exact_dedup(df, keep=keep, index_path=str(tmp_path / keep)).collect()
            best = {t: pick([d for d in v if d is not None], default=None) for t, v in ids.items()}
            assert sorted((x.doc_id or -1, x.keep_id or -1, x.group_size, x.text_sha256) for x in got) == sorted(
                (d or -1, best[t or ""] or -1, len(ids[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows
            )
            # A row stays if the best id is one of this batch and no earlier row has it.
            new = {t or "" for d, t in rows if d == best[t or ""] and [x for b in batches[:k] for x in b].count((d, t)) == 0}
            assert sorted(x.text_sha256 for x in got if x.kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in new)


def test_clashing_digests_are_told_apart_by_bytes(spark, monkeypatch):
    """With a digest of one bit, groups are still those of equal texts."""
    weak = lambda c, n: F.concat(F.lit("0"), (F.length(c) % 2).cast("string"))
    monkeypatch.setattr(E.F, "sha2", weak)
    rows = [(i, t) for i, t in enumerate(["a", "b", "cc", "a", "dd", "b", "a", "e", "cc"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in E.exact_dedup(df, keep="max").collect()}
    want = {}
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        want[i] = (max(same), len(same), i == max(same))
    assert got == want


def test_permutation_and_inverse():
    for n in (1, 2, 3, 7, 8, 100, 1025):
        p = S.Permutation(n, seed=5)
        place = p.place_of(np.arange(n))
        assert sorted(place.tolist()) == list(range(n)) and (p.row_at(place) == np.arange(n)).all()
    assert S.Permutation(1000, 1).place_of(np.arange(9)).tolist() != S.Permutation(1000, 2).place_of(np.arange(9)).tolist()


def test_shards(spark):
    rows = [(i * 7 % 1001, f"t{i}" if i % 9 else None, "x") for i in range(1001)] + [(5, "same", "x")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = S.shard(df, shards=8, seed=3).collect()
    counts = defaultdict(list)
    for x in got:
        counts[x.shard].append(x.slot)
    assert len(got) == len(rows) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    order = sorted(got, key=lambda x: x.row_number)
    assert [x.row_number for x in order] == list(range(len(rows))) and [x.doc_id for x in order] == sorted(d for d, _, _ in rows)
    place = S.Permutation(len(rows), 3).place_of(np.arange(len(rows)))
    assert all((x.shard, x.slot) == (place[x.row_number] % 8, place[x.row_number] // 8) for x in got)
    texts = {(d, zlib.crc32((t or "").encode())): len((t or "").encode()) + 1 for d, t, _ in rows}
    assert all(texts[x.doc_id, x.text_crc32] == x.size for x in got)
    again = {(x.doc_id, x.text_crc32): x for x in S.shard(df.repartition(2), shards=8, seed=3).collect() if x.doc_id != 5}
    assert all((again[x.doc_id, x.text_crc32].shard, again[x.doc_id, x.text_crc32].slot) == (x.shard, x.slot) for x in got if x.doc_id != 5)
    assert S.shard(df.limit(0)).count() == 0 and S.shard(df.limit(1)).count() == 1


def test_urls(spark):
    lines = ["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/", "block a.b/", "block x.y/q.*/", "block whole.host"]
    rules = [U.parse_rule(x) for x in lines]
    urls = ["http://Www.Example.COM/en/742?x#y", "https://example.com/en/8", "ftp://m.example.net/de/81", "http://notexample.net/de/8", "http://e.org/es", "http://e.org/es/", "no url", None, "://", "http://a.b", "http://a.b/", "http://h.com:80/en/", "http://x.y/q.*/z", "http://x.y/qqq/z", "http://com/en/#://net/de/", "http://e.com\n/en/", "http://e.com/en/\n", "x" * 100_000, "http://a\n.com/en/1", "http://c\nom/en/", "http://s.whole.host", "http://whole.host/any", "http://whole.hostile/any"]
    df = spark.createDataFrame([(i, u, "r", 7) for i, u in enumerate(urls)], "page_id long, url string, rule string, _at int")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in U.filter_urls(df, rules).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        best = max((r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.text), default=None)
        assert got[i] == (host, path, best and best.text, best.action if best else "allow"), u
    assert {x._at for x in U.filter_urls(df, rules).collect()} == {7}
    many = [U.parse_rule(f"block h{i}.example/{i % 9}/") for i in range(3000)] + rules
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in U.filter_urls(df, many).collect()} == got
    assert U.filter_urls(df.limit(0), rules).count() == 0 and U.filter_urls(df, []).filter("verdict = 'allow'").count() == len(urls)


def test_every_rule_is_indexed_by_its_rarest_token():
    rules = [U.parse_rule(x) for x in ["block com/", "block a.com/en/x/", "block b.com/en/7"]]
    index = U.rarest_tokens(rules)
    assert sorted(i for v in index.values() for i in v) == [0, 1, 2] and "h:com" in index and index["h:com"] == [0]


def test_keep_rows(spark):
    names = "doc_id long, text string, _id int, _digest int, _k int, _maybe string, _page int, _bits int, _times int, c0 int, n int"
    own = (7, 8, 9, "m", 1, 2, 3, 4, 5)
    docs = spark.createDataFrame([(1, "a", *own), (2, "b", *own), (2, "b", *own), (3, None, *own), (None, "b", *own)], names)
    key = lambda x: (x.doc_id is None, x.doc_id)
    assert sorted(map(key, keep_rows(docs, docs.filter("doc_id = 1").select("doc_id")).collect())) == [(False, 2), (False, 2), (False, 3), (True, None)]
    named = spark.createDataFrame([(2, hashlib.sha256(b"b").hexdigest()), (3, "no"), (None, hashlib.sha256(b"b").hexdigest())], "doc_id long, digest string")
    got = keep_rows(docs, named).collect()
    assert sorted(x.doc_id for x in got) == [1, 2, 3] and {tuple(x)[2:] for x in got} == {own}
    assert keep_rows(docs, named.limit(0)).count() == 5 and keep_rows(docs.limit(0), named).count() == 0


def test_hot_keys_are_joined_whole(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 50}") for i in range(4000)], "i long, k string")
    groups = rows.groupBy("k").agg(F.count("i").alias("n"))
    got = join_hot(rows, groups, "k", "n", 4000)
    assert got.count() == 4000 and got.select("i").distinct().count() == 4000 and got.filter("k = 'hot'").first().n == 2666
