import hashlib

import numpy as np
import pandas as pd

from recordloom.llm import near_dedup as N


def _text(r, n):
    return [f"w{x}" for x in r.integers(0, 5000, n)]


def _edited(r, words, k):
    out = list(words)
    for at in r.choice(len(out), k, replace=False):
        out[at] = f"e{r.integers(0, 10**9)}"
    return out


def _brute(rows):
    """Components of all pairs of different texts by plain counting; equal texts are one class."""
    texts = sorted({t or "" for _, t in rows})
    x = [N.shingles(t) for t in texts]
    df = {}
    for s, _ in x:
        for h in s.tolist():
            df[h] = df.get(h, 0) + 1
    n, rare = len(texts), max(N.RARE_SHARE * len(texts), N.RARE_DOCS)
    w = []
    for s, tf in x:
        idf = [1.0 if df[h] <= rare else min(1.0, max(N.IDF_FLOOR, np.log(n / df[h]) / np.log(n / rare))) for h in s.tolist()]
        w.append({h: (1 + np.log(f)) * i for h, f, i in zip(s.tolist(), tf, idf, strict=True)})
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            low = sum(min(v, w[j][h]) for h, v in w[i].items() if h in w[j])
            total = sum(w[i].values()) + sum(w[j].values()) - low
            if total and low / total >= N.THRESHOLD:
                label[root(i)] = root(j)
    at = {t: root(i) for i, t in enumerate(texts)}
    groups = {}
    for d, t in rows:
        groups.setdefault(at[t or ""], set()).add(d)
    return {frozenset(g) for g in groups.values()}


def _found(df):
    got = N.near_duplicates(df).toPandas()
    assert len(got) == df.count()
    for _, g in got.groupby("component"):
        assert g.component.iloc[0] == g.doc_id.min()
    return {frozenset(g.doc_id) for _, g in got.groupby("component")}


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows, i = [], 0
    for g in range(25):
        base = _text(r, int(r.integers(20, 200)))
        for _ in range(int(r.integers(1, 9))):
            k = int(r.integers(0, max(2, len(base) // 25)))
            rows.append((i, " ".join(_edited(r, base, k))))
            i += 1
    # A hot group: near copies of one text, more than a bucket may hold open, and one passage that all share.
    base, passage = _text(r, 120), _text(r, 30)
    for _ in range(90):
        rows.append((i, " ".join(_edited(r, base, int(r.integers(1, 6))))))
        rows.append((i + 1, " ".join(_text(r, 30) + passage)))
        i += 2
    rows += [(i, None), (i + 1, ""), (i + 2, "***"), (i + 3, "one two"), (i + 4, "one two"), (i + 5, "one two three"), (i + 6, "long " * 30_000)]
    df = spark.createDataFrame([(a, t, "x") for a, t in rows], "doc_id long, text string, component string")
    assert _found(df) == _brute(rows)


def test_a_group_of_a_third_of_the_texts_keeps_its_links(spark, tmp_path):
    """Through the query, against plain Jaccard similarity; a passage of many texts still weighs less."""
    from recordloom.llm.queries import op1_minhash_near_dedup

    r = np.random.default_rng(21)
    base, passage = _text(r, 200), _text(r, 40)
    texts = [" ".join(_edited(r, base, 2)) for _ in range(90)] + [" ".join(_text(r, 30) + passage) for _ in range(90)] + [" ".join(_text(r, 60)) for _ in range(120)]
    x = [set(N.shingles(t)[0].tolist()) for t in texts[:90]]
    assert all(len(a & b) >= N.THRESHOLD * len(a | b) for a in x for b in x)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_minhash_near_dedup(spark, str(tmp_path)).toPandas().set_index("doc_id").cluster_id.sort_index()
    assert (got[:90] == 0).all() and all(got[i] == i for i in range(90, 300))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumnRenamed("doc_id", "digest")
    idf = N.once_per_source(docs, N.document_frequencies(docs, 300))
    s, tf = N.shingles(" ".join(base))
    assert (idf.weights(s, tf) == 1).mean() > 0.95
    s, tf = N.shingles(" ".join(passage))
    assert (idf.weights(s, tf) < 0.7).all()


def test_sources_are_counted_over_all_classes(spark):
    """A passage in 300 near copies of one text and in 300 texts else has 301 sources."""
    r = np.random.default_rng(22)
    base, passage = _text(r, 100), _text(r, 12)
    texts = [" ".join(_edited(r, base, 1) + passage) for _ in range(300)] + [" ".join(_text(r, 30) + passage) for _ in range(300)] + [" ".join(_text(r, 10)) for _ in range(5_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "digest long, text string")
    before = N.document_frequencies(docs, len(texts))
    s, _ = N.shingles(" ".join(passage))

    def df(idf):
        return np.min([np.where(np.isin(own, x), n[np.minimum(np.searchsorted(x, own), len(x) - 1)], 0) for own, x, n in zip(N._slots(s), idf.slots, idf.counts, strict=True)], 0)

    assert (df(before) >= 600).all()
    assert (df(N.once_per_source(docs, before)) == 301).mean() > 0.7


def test_members_of_a_source_are_folded_before_the_shuffle(spark, monkeypatch):
    """A large group sends each code once from a part of the table, not once for each member; the counts are those of plain sets."""
    r = np.random.default_rng(23)
    rows = [(7, sorted(r.choice(50, 30, replace=False).tolist())) for _ in range(6_000)]
    rows += [(int(c), sorted(r.choice(60, int(r.integers(1, 9)), replace=False).tolist())) for c in r.integers(8, 900, 2_000)]
    rows += [(None, sorted(r.choice(60, 3, replace=False).tolist())) for _ in range(500)]
    want = {}
    for i, (c, held) in enumerate(rows):
        for code in held:
            want.setdefault(code, set()).add(-1 - i if c is None else c)
    want = {code: len(x) for code, x in want.items()}
    of = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "component bigint, held array<int>").repartition(4)
    for most in (N.FOLDED, 1_000):
        monkeypatch.setattr(N, "FOLDED", most)
        assert {x.code: x.n for x in N.source_counts(of, 60).collect()} == want
    monkeypatch.undo()
    sent = of.filter("component = 7").mapInArrow(N._folded, "component bigint, held array<int>").collect()
    assert len(sent) <= 4 and all(len(x.held) == len(set(x.held)) == 50 for x in sent)
    plan = N.source_counts(of, 60)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_collisions_follow_the_similarity():
    r = np.random.default_rng(2)
    sampler = N.Sampler(samples=2000, seed=3)
    s = np.unique(r.integers(1, 2**62, 60).astype(np.uint64))
    a, b = s[:45], s[10:]
    wa, wb = r.choice([1.0, 0.3, 2.2], len(a)), r.choice([1.0, 0.3, 2.2], len(b))
    same = (sampler.signature(a, wa) == sampler.signature(b, wb)).mean()
    assert abs(same - N.weighted_jaccard((a, wa), (b, wb))) < 0.05


def test_frequent_shingles_weigh_less():
    idf = N.Idf(1000, [np.array([3])] * 2, [np.array([500.0])] * 2)
    idf.slots = [np.sort(x) for x in N._slots(np.array([77], np.uint64))]
    w = idf.weights(np.array([77, 78], np.uint64), np.array([1.0, np.e]))
    assert 0.1 <= w[0] < 0.5 and w[1] == 2.0


def test_block_links_give_the_components_of_all_pairs():
    r = np.random.default_rng(8)
    bases = [_text(r, 60) for _ in range(6)]
    sets = []
    for i in range(60):
        x, tf = N.shingles(" ".join(_edited(r, bases[i % 6], int(r.integers(0, 4)))))
        sets.append((x, 1 + np.log(tf)))
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if N.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [b if v == a else v for v in label]
    mine = list(range(60))
    for i, j in N.block_links(np.arange(60), sets, 0.8):
        a, b = mine[i], mine[j]
        assert a != b
        mine = [b if v == a else v for v in mine]
    assert len({(a, b) for a, b in zip(label, mine, strict=True)}) == len(set(label)) == len(set(mine))


def test_mixed_buckets_over_a_block_are_compared_whole(spark, monkeypatch):
    """Pairs in buckets of texts on one template, none of them near the bucket's smallest id."""
    r = np.random.default_rng(12)
    template, rows = _text(r, 200), []
    for i in range(40):
        own = template + _text(r, 40)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own + _text(r, 5)))]
    monkeypatch.setattr(N, "MAX_OPEN", 8)
    monkeypatch.setattr(N, "BLOCK", 6)
    classes = spark.createDataFrame([(i.to_bytes(2), t) for i, t in rows], "digest binary, text string").cache()
    idf = N.Idf(len(rows), [np.zeros(0, np.int64)] * 2, [np.zeros(0)] * 2)
    sigs = spark.createDataFrame([(i, i.to_bytes(2), [1, 2], bytes(72), len(N.shingles(t)[0])) for i, t in rows], "no long, digest binary, keys array<bigint>, bits binary, size bigint")
    got = {r.id: r.component for r in N.components(sigs, classes, idf, 0.9).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_agreeing_members_against_all_pairs():
    r = np.random.default_rng(4)
    bits = r.integers(0, 3, (150, 72)).astype(np.uint8)
    bits[70:90] = bits[:20]
    bits[75, :20] += 1
    comps, part = r.integers(0, 8, 150), r.integers(0, 2, 150)
    same = (bits[:, None, :] == bits[None]).sum(2)
    want = ((same >= N.MIN_AGREE) & (comps[:, None] != comps[None]) & (part[:, None] != part[None])).any(1)
    assert want.any() and (N.agreeing(bits, comps, part) == want).all()
    want = ((same >= N.MIN_AGREE) & (comps[:, None] != comps[None])).any(1)
    assert (N.agreeing(bits, comps, np.zeros(150)) == want).all()


def test_ids_that_repeat_or_are_null(spark):
    r = np.random.default_rng(9)
    a, b = _text(r, 60), _text(r, 60)
    near = [" ".join(_edited(r, a, 1)) for _ in range(3)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near[0]), (3, " ".join(b)), (None, near[1]), (None, near[1]), (2, near[0])]
    other = [" ".join(_edited(r, _text(r, 60), 0))] * 2
    rows += [(None, other[0]), (None, other[1])]
    schema = "doc_id long, text string, component long, kept boolean, digest string, row long, no long, first string"
    got = N.near_duplicates(spark.createDataFrame([(i, t, 0, False, "", 0, 0, "") for i, t in rows], schema)).toPandas()
    assert len(got) == len(rows)
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for _, t in rows}
    of = {t: set(got[got.text_sha256 == d].component.fillna(-1)) for t, d in digest.items()}
    assert of[rows[0][1]] == of[near[0]] == of[near[1]] == {1} and of[rows[1][1]] == {1} and of[other[0]] == {-1}
    kept = got[got.kept].sort_values("text_sha256")
    assert sorted(kept.text_sha256) == sorted(digest[t] for t in (rows[0][1], rows[1][1], other[0]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0
    one = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2], "text": ["", "!"]}))
    assert _found(one) == {frozenset([1]), frozenset([2])}
