"""The corpus pipeline, stage by stage and as a whole."""

import collections
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

STAGES = dict(corpus_pipeline.STAGES)


def _shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_pipeline(spark, sf):
    """Each stage against a plain version of what it is to do with its own input."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {"start": docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns
        rows[name] = docs.collect()
    good, single, clean, mixed = (rows[n] for n in list(STAGES)[:-1])
    # only what the labels call bad goes, of labelled documents
    kept = {r.doc_id for r in good}
    assert all((labels[r.doc_id] == 1) == (r.doc_id in kept) for r in rows["start"] if r.doc_id in labels)
    # components of similar texts, the smallest doc_id of each
    sets, root = {r.doc_id: _shingles(r.text) for r in good}, {r.doc_id: r.doc_id for r in good}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in single) == [a for a in ids if top(a) == a]
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in single if not any(i in r.text for i in items))
    # a document is taken whole, at most three times; a source's words come near those that the mix wants
    times = collections.Counter(r.doc_id for r in mixed)
    texts = {r.doc_id: r.text for r in clean}
    assert set(times) <= set(texts) and max(times.values()) <= 3 and all(r.text == texts[r.doc_id] for r in mixed)
    # ids in ascending order of doc_id
    tokens = STAGES["token_ids"](spark, docs, sf).collect()
    plain, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r, want in zip(sorted(tokens, key=lambda r: r.start), sorted(mixed, key=lambda r: r.doc_id), strict=True):
        ids = np.array([*plain.encode(want.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (want.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


ROWS = [(1, "a short text", "x"), (2, None, "x"), (3, "", None), (None, "no id but some words here", "y"), (5, "word " * 60_000, "y"), (6, "a short text", "x"), (6, "a short text", "x"), (7, "another text stands here", "z")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder with documents of odd rows and clashing columns, with labels and a benchmark of one row each, and one with empty tables."""
    out = []
    for rows in (ROWS, []):
        d = str(tmp_path_factory.mktemp("tables"))
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("__id", "__hash", "node", "component", "n_shingles", "copy", "row", "size", "place")})
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(100, 1)][: len(rows)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "what is the name of the river that runs by this town")][: len(rows)], "item_id int, text string").write.parquet(f"{d}/benchmark.parquet")
        out.append(d)
    return out


def test_pipeline_of_odd_rows_and_empty_tables(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    good = STAGES["quality_classifier"](spark, docs, odd[0])
    assert sorted(map(str, (r.doc_id for r in good.collect()))) == sorted(str(r[0]) for r in ROWS)
    single = STAGES["minhash_near_dedup"](spark, good, odd[0])
    assert sorted(map(str, (r.doc_id for r in single.collect()))) == sorted(["1", "2", "3", "None", "5", "7"])
    clean = STAGES["benchmark_decontamination"](spark, single, odd[0])
    assert clean.count() == 6 and clean.columns == docs.columns
    mixed = STAGES["mix_sources"](spark, clean, odd[0])
    assert mixed.columns == docs.columns
    n = mixed.count()
    assert STAGES["token_ids"](spark, mixed, odd[0]).count() == n
    assert corpus_pipeline.run(spark, odd[1]).count() == 0


def test_runs_do_not_touch_one_another(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    mixed = STAGES["mix_sources"](spark, docs, odd[0])
    tokens = STAGES["token_ids"](spark, mixed, odd[0])
    n = tokens.count()
    other = corpus_pipeline.run(spark, odd[0])
    assert tokens.count() == n == mixed.count() and other.count() > 0
