"""The pipeline against a brute-force version of its stages on a small corpus."""

import numpy as np
import public_tokenizers as P
import sentencepiece

import corpus_pipeline
from tests.llm.test_native import _contaminated
from tests.llm.test_near_dedup import _brute, _edited, _text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    r = np.random.default_rng(12)
    items = [(i, " ".join(_text(r, 30))) for i in range(4)]
    docs, labels = [], []
    for g in range(40):
        base = _text(r, int(r.integers(30, 90)))
        toxic = g % 4 == 0
        if toxic:
            base += ["vileword"] * 4 + ["nastyword"] * 3
        if g % 7 == 3:
            base[10:10] = items[g % 4][1].split()[: 13 + g % 10]
        for k in range(int(r.integers(1, 5))):
            docs.append((len(docs), " ".join(_edited(r, base, k // 2))))
            labels.append((len(docs) - 1, 1, int(toxic)))
    docs += [(900, None), (901, ""), (902, "!"), (903, docs[5][1]), (904, docs[5][1])]
    return docs, labels, items


def test_stages_and_run(spark, tmp_path):
    docs, labels, items = _corpus()
    d = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels[::2], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    left = [(i, t) for i, t in docs if "vileword" not in (t or "")]
    last = {}
    for i, t in left:
        last[t or ""] = max(i, last.get(t or "", -1))
    left = [(i, t) for i, t in left if last[t or ""] == i]
    kept = {min(g) for g in _brute(left)}
    left = [(i, t) for i, t in left if i in kept]
    bad = _contaminated(left, items)
    left = [(i, t) for i, t in left if not bad[i][3]]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(corpus_pipeline.TOKENIZER))
    want = {i: sp.encode(t or "") for i, t in left}

    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.parity and r.n_tokens == len(r.ids) for r in got)
    table = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), d).columns == table.columns


def test_contamination_goes_by_id_and_text(spark, tmp_path):
    """A clean text stays beside a contaminated one of the same id, null ids too."""
    d = str(tmp_path / "sf")
    passage = " ".join(_text(np.random.default_rng(5), 20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(i, t, "en", "s", 0) for i in (1, None) for t in (passage, "quite another text", None)]
    got = corpus_pipeline.contamination(spark, spark.createDataFrame(rows, COLUMNS), d).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(i, t) for i in (0, 1) for t in ("", "quite another text")]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact", "near", "contamination", "sentencepiece"]
