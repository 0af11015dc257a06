"""Importance resampling, license rules and ranked search: edges, and results against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import lexical, licenses, resample
from svloom.llm.common import Workspace

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "tea Straße K river " * 20000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank today and then it sleeps for an hour or two by the old mill"), (2, None), (3, ""), (4, " \n,;"), (5, LONG), (5, LONG), (6, "Tea"),
    (None, "tea and the river and more of the same words than there are in most of the other texts here, as it has to be drawn too"), (7, "Ünder dem İ Fluß, TEA-tea_tea\ttea"), (8, "the quick brown fox jumps over the lazy dog near the river bank today and then it sleeps for an hour or two by the old mill"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Further columns have names that the operators use inside."""
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "item", "words", "norm", "text_hash", "planes", "score", "__at", "part", "hits", "n_words")})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "The river, tea; the FOX"), (1, "The river, tea; the FOX"), (2, None), (3, ""), (4, "absent words"), (5, "tea tea straße")], "item_id long, text string").withColumn("terms", F.lit(1))


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---------------------------------------------------------------- 11 resampling
def brute_resample(texts, targets, share, min_words, seed, n_buckets, max_run):
    def buckets(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n_buckets for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]

    s, t = (collections.Counter(b for x in part for b in buckets(x)) for part in ([x for _, x in texts], targets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n_buckets) / ((s[b] + 1) * (all_t + n_buckets)))) for b in range(n_buckets)]
    out = []
    for doc_id, text in texts:
        own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= min_words])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    ranks = collections.defaultdict(list)
    for k, x in enumerate(fit[: share * len(fit) // 100]):
        ranks[x[0]].append(k + 1)
    return collections.Counter((x[0], x[1], x[2], x[3], ranks[x[0]].pop(0) if x[4] and ranks[x[0]] else None) for x in out)


@pytest.mark.parametrize("settings", [{}, {"share": 70, "min_words": 2}, {"share": 100, "min_words": 1, "n_buckets": 130, "max_run": 3}])
def test_resample_by_brute_force(spark, docs, items, settings):
    settings = {"share": 10, "min_words": 20, "seed": 2024, "n_buckets": 10000, "max_run": 1} | settings
    found = rows_of(resample.resample(docs, items, **settings), "doc_id", "n_features", "weight", "score", "rank")
    assert found == brute_resample(TEXTS, [r.text for r in items.collect()], **settings)


def test_resample_of_tables_by_brute_force(spark, sf):
    texts, targets = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = resample.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), share=40, max_run=2)
    assert rows_of(found, "doc_id", "n_features", "weight", "score", "rank") == brute_resample(texts, [t for _, t in targets], 40, 20, 2024, 10000, 2)


def test_resampled_documents_and_empty_tables(spark, docs, items):
    kept = resample.resampled_documents(docs, items, share=50, min_words=1)
    assert kept.columns == docs.columns and 0 < kept.count() < len(TEXTS)
    assert resample.resample(docs.limit(0), items).count() == 0
    assert resample.resample(docs, items.limit(0)).count() == len(TEXTS)


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 200):
        gains = rng.integers(-40000, 40000, n)
        planes, powers = resample.signed_planes(gains)
        counts = rng.integers(0, 1000, n)
        sliced = np.ascontiguousarray(resample.bit_planes(counts)).view(np.uint64)
        sums = resample.weighted_sums(sliced, planes, powers)
        assert int((sums << np.arange(len(sums))).sum()) == int((gains * counts).sum())
    planes, powers = resample.signed_planes(np.zeros(5, np.int64))
    assert len(planes) == len(powers) == 1


# ---------------------------------------------------------------- 12 licenses
def brute_licenses(text, rules=licenses.RULES):
    w = words(text)
    norm, found = "  " + "  ".join(w) + "  ", []
    for k, rule in enumerate(rules):
        for m in re.finditer(licenses.spaced(rule.pattern), norm):
            found.append((norm[: m.start()].count(" ") // 2, norm[: m.end()].count(" ") // 2, rule.priority, k, rule.label))
    kept = [a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and (b[2] > a[2] or b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[1] - b[0] == a[1] - a[0] and b[3] < a[3])) for b in found)]
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels = sorted({x[4] for x in kept} | {x[1] for x in base})
    starts = [x[0] for x in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[1] for x in base})), ",".join(labels), len(kept)


NOTICES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "under the GNU Lesser General Public Licence v2.1 or later, not the general public license",
    "SPDX-License-Identifier: GPL-3.0-only", "MIT License\nMIT   LICENSE mit licensed mit", "Lizenz mit dem Apache Licence", "see creativecommons.org/licenses/by-nc-sa/4.0 or CC BY-SA 4.0", "general public license general public license version 3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "All rights reserved. Released under the 3-clause BSD license", "This is free and unencumbered software released into the public domain.", "Kernel mİt license", "available under the terms of the Mozilla Public License 2.0",
]
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_detections")


def test_licenses_by_brute_force(spark, docs):
    rng = random.Random(4)
    texts = [*NOTICES, *[t for _, t in TEXTS], *[" ".join(rng.choice(NOTICES) if rng.random() < 0.5 else "and words between" for _ in range(rng.randint(1, 9))) for _ in range(40)], "mit license " * 5000]
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect() if r.doc_id < len(texts) - 1} == {k: brute_licenses(t) for k, t in enumerate(texts[:-1])}
    last = found.filter(F.col("doc_id") == len(texts) - 1).first()
    assert (last.n_base, last.last_word, last.labels, last.n_detections) == (5000, 9998, "mit", 5000)


@pytest.mark.parametrize(
    "text,labels",
    [(NOTICES[0], "apache,apache-2.0"), (NOTICES[2], "gpl-3.0"), (NOTICES[7], "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("ein Haus mit Garten", ""), (NOTICES[9], "unlicense"), (NOTICES[11], "mpl-2.0"), ("the BSD-3-Clause licence", "bsd-3-clause")],
)
def test_labels_of_notices(text, labels):
    assert brute_licenses(text)[5] == labels


def test_license_edges(spark, docs):
    rows = licenses.scan_licenses(docs).collect()
    assert len(rows) == len(TEXTS) and {r.score for r in rows} == {0.0}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert len(licenses.RULES) >= 300 and all(set(k.split("|")) for r in licenses.RULES for k in r.keywords)


def test_keywords_lose_no_match(spark):
    """Rules without keywords find the same."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(NOTICES) for _ in range(3)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    open_rules = tuple(licenses.Rule(r.label, r.priority, (), r.pattern) for r in licenses.RULES)
    assert rows_of(licenses.scan_licenses(df), "doc_id", "labels", "score") == rows_of(licenses.scan_licenses(df, open_rules), "doc_id", "labels", "score")


# ---------------------------------------------------------------- 13 ranked search
def brute_search(texts, items, k, share=90):
    bags = [collections.Counter(words(t)) for _, t in texts]
    full = [b for b in bags if b]
    n, total = len(full), sum(sum(b.values()) for b in full)
    held = collections.Counter(t for b in full for t in b)
    out = collections.Counter()
    for item_id, text in items:
        scored = []
        for (doc_id, _), bag in zip(texts, bags):
            m = 100 - share + share * sum(bag.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(words(text)) if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]):
            out[item_id, rank + 1, doc_id, -score] += 1
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_by_brute_force(docs, items, k):
    found = rows_of(lexical.ranked_search(docs, items, k), "item_id", "rank", "doc_id", "score")
    assert found == brute_search(TEXTS, [(r.item_id, r.text) for r in items.collect()], k)


def test_search_in_shards_and_blocks(spark, sf, monkeypatch):
    """Small shards, blocks of states and blocks of items."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    monkeypatch.setattr(lexical, "SHARD_BYTES", 30000)
    monkeypatch.setattr(lexical, "FIRST_STATES", 2)
    monkeypatch.setattr(lexical, "MORE_STATES", 2)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 500)
    texts, asked = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]
    assert rows_of(lexical.ranked_search(docs, items), "item_id", "rank", "doc_id", "score") == brute_search(texts, asked, 10)


def test_search_edges(spark, docs, items):
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert lexical.ranked_search(named, items).filter("item_id = 5").count() == 5
    space = Workspace(spark, "index")
    index = lexical.build_index(space, docs)
    assert lexical.search(space, index, items, 2).count() == lexical.search(space, index, items, 2).count() == 7
    space.close()


def test_treap_holds_its_cells():
    rng = np.random.default_rng(8)
    for size in (1, 2, 7, 300):
        cells = np.unique(rng.integers(0, size * size, min(size * 3, size * size)))
        rows, columns, impacts = cells // size, cells % size, rng.integers(1, 1 << 20, len(cells))
        treap = lexical.Treap(lexical.build_treap(rows, columns, impacts))
        for row in np.unique(rows):
            found, scores = treap.best(np.array([row]), np.array([1]), 10**6)
            own = rows == row
            assert dict(zip(found.tolist(), scores.tolist())) == dict(zip(columns[own].tolist(), impacts[own].tolist()))
