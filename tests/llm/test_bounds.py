"""What a row, a text or a query may cost, at sizes that small tables don't have."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gevel.llm import packing, pii
from gevel.llm.ann import Graph, halved
from gevel.llm.packing import pack
from gevel.llm.tokenizer_files import path


def test_a_rare_source_has_no_more_parts_than_tokens_or_windows(spark):
    window, big = 1 << 30, 10**12
    sizes = spark.createDataFrame([(0, "big", big), (1, "rare", 1), (2, "few", 900), (3, "few", 1)], "row long, queue string, n long")
    parts = packing.placed(sizes, window, None).collect()
    windows = big // window + 2
    for row, n in ((0, big), (1, 1), (2, 900), (3, 1)):
        own = sorted((p.start, p.size) for p in parts if p.row == row)
        assert len(own) <= min(n, windows) and own[0][0] == 0 and sum(s for _, s in own) == n
        assert all(a + s == b for (a, s), (b, _) in zip(own, own[1:], strict=False))
    spans = sorted((p.at, p.size) for p in parts)
    assert spans[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:], strict=False))


def test_forced_mixture_while_all_sources_last_and_after(spark):
    rows = [(k, "word " * 60, "a") for k in range(300)] + [(1000 + k, "word " * 60, "b") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pack(df, path("byte_bpe_50k.tiktoken"), window=600, shares={"a": 1.0, "b": 1.0}).join(df.select("doc_id", "source"), "doc_id")
    totals = {(r.window_id, r.source): r.n for r in out.groupBy("window_id", "source").agg(F.sum("length").alias("n")).collect()}
    last = max(w for w, s in totals if s == "b")
    assert last >= 4 and all(totals[w, "a"] == totals[w, "b"] == 300 for w in range(last))
    # Then the other goes on at its own pace.
    assert all((w, "b") not in totals for w in range(last + 1, max(w for w, _ in totals)))
    assert out.agg(F.sum("length")).first()[0] == sum(len(t.split()) + 2 for _, t, _ in rows)
    with pytest.raises(ValueError, match="above 0"):
        pack(df, path("byte_bpe_50k.tiktoken"), shares={"a": 1.0, "b": 0.0})


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 2)
    monkeypatch.setattr(packing, "BUCKETS", 1)
    sizes = spark.range(40).select(F.col("id").alias("row"), F.lit("q").alias("queue"), (F.col("id") + 1).alias("n"))
    parts = packing.placed(sizes, 64, None).collect()
    spans = sorted((p.at, p.size) for p in parts)
    assert sum(s for _, s in spans) == 820 and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:], strict=False))


def test_many_identifiers_in_one_text():
    n = 50_000
    text = " ".join(f"u{k}@example.com and v{k} [at] example [dot] org" for k in range(n))
    began = time.time()
    base, every = pii.spans(text)
    assert time.time() - began < 20
    assert len(base["email"]) == n and len(every["email"]) == 2 * n


@pytest.mark.parametrize("spread", [0.0, 0.3])
def test_the_graph_leads_to_all_near_lists(spread):
    random = np.random.default_rng(8)
    middles = random.normal(size=(60, 32))
    points = random.normal(size=(40_000, 32)) if not spread else middles[random.integers(0, 60, 40_000)] + spread * random.normal(size=(40_000, 32))
    graph = Graph.of(halved(points, 2048))
    queries = points[:200]
    found = missed = looked = 0
    for query, known, far in zip(queries, *graph.walk(queries), strict=True):
        p, _ = graph.around(query, known[known >= 0], far[known >= 0], 1.6)
        d = np.sqrt(((graph.centroids - query) ** 2).sum(1))
        near = set(np.flatnonzero(d <= 1.6 * d.min()).tolist())
        found, missed, looked = found + len(near), missed + len(near - set(p.tolist())), looked + len(p)
    assert missed <= 0.01 * found
    # In clusters a query looks at a part of the centroids only.
    assert not spread or looked < 0.75 * 200 * 2048
