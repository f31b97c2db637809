"""Each operator against a plain version of itself, also on odd input."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import tarfile
import zlib
from io import BytesIO

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gevel.llm import ann, language, licenses, media, ngram_join, packing, pii, pretokens, token_count, toxicity
from gevel.llm.ann import nearest
from gevel.llm.bpe import encode_decode
from gevel.llm.components import components
from gevel.llm.ngram_join import jaccard_groups, most_shared, sketch
from gevel.llm.token_count import token_counts
from gevel.llm.tokenizer_files import path

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t ", "a", "a b", "Ünïcödé ﬁ İstanbul ΣΑΣ", "x" * 5000, "word " * 3000, "<|endoftext|> it's I'LL we've", "日本語 text 123,456", "a b　c  d", "🙂🙂 é"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(99, "a b", None)], "doc_id long, text string, n long".replace("n long", "ids string"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def groups(texts: dict[int, str | None], width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in texts}

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, docs, odd, empty, width, percent):
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    more = [(1000 + 10 * k + j, " ".join(w[: len(w) - j * len(w) // 25])) for k, t in base[:25] for j in (1, 2, 3) if (w := t.split())]
    rows = base + more + [(5000 + k, t) for k, t in enumerate(ODD)] + [(6000, "a b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()}
    assert got == groups(dict(rows), width, percent)
    assert jaccard_groups(empty).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_links_are_counted(spark, docs, empty, width, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "SIDE", 8)
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    words = [f"w{k}" for k in range(400)]
    near = [(20_000 + k, " ".join(words[k : 300 + k // 2])) for k in range(0, 90)]
    copies = [(30_000 + k, near[7 * k % 40][1].upper()) for k in range(30)]
    rows = base + near + copies + [(40_000, None), (40_001, ""), (40_002, "a b"), (40_003, "A b"), (40_004, "a c")]
    got = {r.doc_id: r.n_links for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent, links=True).collect()}
    sets = {k: plain_set(t, width) for k, t in rows}
    alike = lambda a, b: (n := len(a & b)) and 100 * n >= percent * (len(a) + len(b) - n)
    want = {k: sum(1 for j, y in sets.items() if j != k and alike(x, y)) for k, x in sets.items()}
    assert got == want and max(want.values()) > 20 and len({want[k] for k, _ in near}) > 3
    assert jaccard_groups(empty, links=True).count() == 0


@pytest.mark.parametrize(("width", "percent", "short", "turns"), [(3, 90, 24, 4), (3, 90, 3, 3), (5, 80, 3, 4), (5, 80, 3, 1)])
def test_groups_just_below_the_threshold(spark, width, percent, short, turns, monkeypatch):
    """Hundreds of texts that share most n-grams with one text, of which few link with each other, some only through changes that they share."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "TURNS", turns)
    r = np.random.default_rng(width)
    base = [f"w{k}" for k in range(150)]
    rows, kinds = [], [base]
    for k in range(260):
        words = list(kinds[r.integers(len(kinds))])
        for at in r.choice(150, r.integers(0, 12), replace=False):
            words[at] = f"v{r.integers(3)}x{at}" if k % 4 else f"u{k}x{at}"
        if k % 20 == 7:
            kinds.append(words)
        rows.append((k, " ".join(words[: 150 - k % 3])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()}
    want = groups(dict(rows), width, percent)
    assert got == want and 5 < len({c for _, c in want.values()}) < 255


THUE_MORSE = "a"
while len(THUE_MORSE) < 1024:
    THUE_MORSE += THUE_MORSE.translate({97: 98, 98: 97})
TWINS = THUE_MORSE, THUE_MORSE.translate({97: 98, 98: 97})


def test_words_of_like_structure_differ(spark):
    """Hashes that are polynomials of the letters take these two words for one."""
    df = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1]), (3, " ".join(TWINS)), (4, TWINS[0].upper())], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_groups(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    pieces = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts(df, path("piece_bpe_32k.model")).collect()} == {r.doc_id: len(pieces.encode(r.text)) for r in df.collect()}
    words = Tokenizer.from_file(path("word_bpe_49k.json"))
    words.no_truncation()
    got = {r.doc_id: list(r.ids) for r in encode_decode(df, path("word_bpe_49k.json"), keep=True).collect()}
    assert got == {r.doc_id: words.encode(r.text, add_special_tokens=False).ids for r in df.collect()}


def test_equal_hashes_do_no_harm(monkeypatch):
    monkeypatch.setattr(pretokens, "hashed_points", lambda cp, a, b: ((b - a) % 3).astype(np.uint64))
    seen = []
    store = pretokens.Store(lambda words: [seen.append(w) or np.array([len(w), ord(w[0])]) for w in words], np.int64)
    words = ["abc", "abd", "x", "abcdef", "abc", "y", "x"]
    for _ in range(2):
        cp, at = pretokens.points(words)
        values, sizes = store.rows(store.of(cp, at[:-1], at[1:]))
        assert values.reshape(-1, 2).tolist() == [[len(w), ord(w[0])] for w in words] and set(sizes) == {2}
    assert sorted(seen) == sorted(set(words))


def plain_set(text: str | None, width: int) -> set[tuple[str, ...]]:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def test_null_ids_stay_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_groups(df).collect()) == [("1", "1"), ("None", "None"), ("None", "None")]


def test_sketches_bound_what_sets_share():
    r = np.random.default_rng(5)
    for n in (1, 40, 900, 5000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 1 << 63, n, dtype=np.uint64)]))
        assert most_shared(sketch(a), sketch(b)) >= len(np.intersect1d(a, b))


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (120, 2))] + [(300 + k, 301 + k) for k in range(40)]
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_packing(spark, docs, odd, empty):
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = docs.select("doc_id", "text", "source").unionByName(odd.selectExpr("doc_id + 9000 as doc_id", "text", "cast(null as string) as source"))
    pieces = packing.pack(rows, path("byte_bpe_50k.tiktoken")).collect()
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    for k, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start):
            part = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32, bytes(p.ids)) == (at, len(ids), zlib.crc32(part), part)
            at += p.length
        assert at == len(ids)
    fills = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fills.get(p.sequence_id, 0)
        fills[p.sequence_id] = p.offset + p.length
    assert sorted(fills) == list(range(len(fills))) and all(n == 1024 for s, n in fills.items() if s < len(fills) - 1)
    assert packing.pack(empty, path("byte_bpe_50k.tiktoken")).count() == 0


def test_windows_hold_sources_in_their_shares(spark):
    rows = spark.createDataFrame([(k, "a b c " * 20, "big" if k % 3 else "small") for k in range(3000)], "doc_id long, text string, source string")
    pieces = packing.pack(rows, path("byte_bpe_50k.tiktoken"), window=8192)
    got = {}
    for r in pieces.join(rows.select("doc_id", "source"), "doc_id").groupBy("window_id", "source").sum("length").collect():
        got.setdefault(r.window_id, {})[r.source] = r[2]
    assert len(got) > 10
    assert all(abs(x["small"] / sum(x.values()) - 1 / 3) < 0.03 for w, x in got.items() if w < max(got))


def test_texts_are_cut_where_windows_end(spark):
    """A long text of a small source doesn't fill a window alone, and shares can differ from the sources' own."""
    rows = spark.createDataFrame([(k, "a b c " * 20, "big") for k in range(3000)] + [(9000, "x y " * 20_000, "small"), (9001, None, "small")], "doc_id long, text string, source string")
    for shares, part in ((None, None), ({"big": 0.5, "small": 0.5}, 0.5)):
        pieces = packing.pack(rows, path("byte_bpe_50k.tiktoken"), window=8192, shares=shares).join(rows.select("doc_id", "source"), "doc_id").collect()
        whole, by = {}, {}
        for p in pieces:
            whole[p.source] = whole.get(p.source, 0) + p.length
            by.setdefault(p.window_id, {}).setdefault(p.source, []).append(p)
        want = part or whole["small"] / sum(whole.values())
        full = [x for x in by.values() if len(x) == 2 and sum(p.length for v in x.values() for p in v) >= 8190]
        assert len(full) >= 8 and all(abs(sum(p.length for p in x["small"]) - want * 8192) <= 2 for x in full)
        for k in (9000, 9001, 5):
            own = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == own[0].doc_tokens


def test_licenses(spark, docs, empty):
    mit = licenses._MIT
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "  ")), (2, "text\nReleased under the MIT licence\nmore"), (3, None), (4, ""), (5, "!!"), (6, mit + " x")]
    got = {(r.doc_id, r.unit, r.line): r.license_id for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "text", 0): "MIT", (2, "text", 0): None, (2, "line", 2): "MIT", (3, "text", 0): None, (4, "text", 0): None, (5, "text", 0): None, (6, "text", 0): None}
    assert licenses.license_scan(empty).count() == 0
    plan = licenses.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_line_breaks_do_not_matter(spark):
    import textwrap

    texts = [("MIT", licenses._MIT)] + [(r["license_id"], r["text"]) for r in map(json.loads, licenses.TEXTS.read_text().splitlines()) if r["license_id"] in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0")]
    wrap = lambda t, w: "\n\n".join(textwrap.fill(" ".join(p.split()), w) for p in t.split("\n\n"))
    rows = [(n, w, k, "Copyright (c) 2019-2021 Some One\n\n" + wrap(t, w)) for n, (k, t) in enumerate(texts) for w in range(40 + n % 3, 121, 9)]
    df = spark.createDataFrame([(n * 1000 + w, t) for n, w, _, t in rows], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.license_id for r in licenses.license_scan(df).where("unit = 'text'").collect()}
    assert not [(k, w) for n, w, k, _ in rows if got[n * 1000 + w] != k]


def test_whole_license_texts(spark):
    whole = {}
    for r in map(json.loads, licenses.TEXTS.read_text().splitlines()):
        whole.setdefault(r["license_id"], []).append(r["text"])
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-SA-4.0"} <= set(whole)
    rows = [(name, "Copyright 2021 Some One\n\n" + t.upper()) for name, texts in whole.items() for t in texts]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.license_scan(df).where("unit = 'text'").collect()} == {k: name for k, (name, _) in enumerate(rows)}
    cut = df.selectExpr("doc_id", "substring(text, 1, length(text) - 40) as text")
    assert licenses.license_scan(cut).where("unit = 'text' and license_id is not null").count() == 0


def test_nearest(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 24)) * 3
    points = (centres[r.integers(0, 30, 4000)] + r.normal(size=(4000, 24))).astype(np.float32)
    points[100:160] = points[0]
    rows = [(k, p.tolist()) for k, p in enumerate(points)] + [(4000, None), (4100, [0.0] * 24), (4200, [float("nan")] * 24), (4300, [1.0, None] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    assert set(got) == set(range(0, 4000, 100))
    hits = 0
    wide = points.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        want = [k for k in np.lexsort((np.arange(4000), d)) if k != q][:10]
        hits += len({k for _, k in found} & set(want))
        assert len(found) == 10 and found == sorted(found) and np.allclose([s for s, _ in found], [d[k] for _, k in found], rtol=1e-12, atol=1e-12)
    assert hits >= 0.9 * 10 * len(got)
    assert nearest(df.where("vec_id < 0")).count() == 0
    assert nearest(df.where("vec_id < 3")).count() == 2


def test_all_near_lists_are_read(monkeypatch, spark):
    monkeypatch.setattr(ann, "LIST_SIZE", 16)
    monkeypatch.setattr(ann, "ENOUGH", 32)
    points = np.random.default_rng(4).normal(size=(6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = {}
    for x in nearest(df).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    wide, hits = points.astype(np.float64), 0
    for q in range(0, 6000, 100):
        d = ((wide - wide[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.95 * 600


def test_token_counts(docs, odd, empty):
    own = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    for df in (docs, odd):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = {r.doc_id: tuple(r)[1:] for r in token_counts(df, path("piece_bpe_32k.model")).collect()}
        assert got == {k: (len(t.encode()), n := len(own.encode(t)), n > 4096) for k, t in texts.items()}
    assert token_counts(empty, path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("salts", [1, 10**6])
def test_counts_of_frequent_and_other_words(spark, monkeypatch, salts):
    """No pre-token dealt by block, or all; repeated rows, null and clashing columns, a very long text, a long pre-token."""
    monkeypatch.setattr(token_count, "SALTS", salts)
    monkeypatch.setattr(token_count, "BUCKETS", 16)
    monkeypatch.setattr(token_count, "AT_ONCE", 20)
    own = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    texts = [(1, "the the cat"), (1, "the the cat"), (1, "a dog\n\n the"), (None, "the cat"), (None, None), (7, "the quick brown fox " * 60_000), (8, "x" * 3000 + " the"), (8, "  ▁ ▁the")]
    df = spark.createDataFrame([(k, t, 5, "w") for k, t in texts], "doc_id long, text string, n_tokens int, word string").withColumn("row", F.lit(0))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, path("piece_bpe_32k.model")).collect())
    assert got == sorted((str(k), len((t or "").encode()), n := len(own.encode(t or "")), n > 4096) for k, t in texts)


def test_bpe(docs, odd, empty):
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    for df in (docs, odd):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        got = {r.doc_id: tuple(r)[1:] for r in encode_decode(df, path("word_bpe_49k.json")).collect()}
        for k, t in texts.items():
            ids = own.encode(t, add_special_tokens=False).ids
            assert got[k] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()), t[:80]
    assert encode_decode(empty, path("word_bpe_49k.json")).count() == 0


def test_forward_backward_is_that_of_all_paths():
    from itertools import product

    r = np.random.default_rng(1)
    says, moves, start = r.normal(size=(7, 3)), r.normal(size=(3, 3)), r.normal(size=3)
    first = np.array([1, 0, 0, 0, 1, 0, 0], bool)
    p, pairs = language.marginals(says, first, moves, start)
    want, want_pairs = np.zeros((7, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 7)):
        every = list(product(range(3), repeat=b - a))
        weight = np.exp([start[y[0]] + sum(says[a + i, y[i]] for i in range(b - a)) + sum(moves[y[i], y[i + 1]] for i in range(b - a - 1)) for y in every])
        for y, w in zip(every, weight / weight.sum(), strict=True):
            for i, k in enumerate(y):
                want[a + i, k] += w
            for i in range(b - a - 1):
                want_pairs[y[i], y[i + 1]] += w
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_languages(spark, docs, odd, empty):
    rows = {r.doc_id: r for r in language.languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [k for k, r in rows.items() if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= rows[k].score <= 1 for k in rows)
    assert np.mean([rows[k].lang_pred == truth[k] for k in held]) > 0.97
    model = language.train(docs)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect()}
    assert all(found[k] == ("und", 0.0) for k in (0, 1, 2)) and found[3][0] in model.languages
    words = [(r.word, r.lang) for r in language.label_words(spark.createDataFrame([(1, "the and of with this que pour dans les der die und nicht mit"), (2, None)], "doc_id long, text string"), model).orderBy("position").collect()]
    # "que", between English and French words, is a word of Spanish too.
    assert [x for w, x in words if w != "que"] == ["en"] * 5 + ["fr"] * 3 + ["de"] * 5 and dict(words)["que"] in ("fr", "es")
    assert language.languages(empty).count() == 0
    many = spark.createDataFrame([(k, f"{chr(97 + k % 20)}{chr(97 + k // 20)} " * 5, f"l{k:03}") for k in range(300)], "doc_id long, text string, lang string")
    assert len(language.train(many).languages) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(300))


def test_strange_texts_stand_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    rows = {r.lang: r.text for r in docs.where("length(text) > 600").collect()}
    mixed = " ".join(" ".join(t.split()[:25]) for t in rows.values())
    junk = "".join(np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyz "), 400))
    other = "zażółć gęślą jaźń pchnąć w tę łódź jeża lub ośm skrzyń fig"
    found = language.strangeness(model, [mixed, junk, other, "", "12 34", *rows.values()])
    assert (found[[1, 2]] > 8).all() and (np.delete(found, [1, 2]) < 5).all() and (found[[3, 4]] == 0).all()


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()}
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    toxic, clean = ([got[k].predicted for k, y in truth.items() if y == kind and k in got and got[k].held_out] for kind in (1, 0))
    assert len(toxic) > 50 and np.mean(toxic) > 0.75 and np.mean(clean) < 0.01
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("toxic > 5")).collect()} == {0}


def test_learning_is_plain_ftrl(monkeypatch):
    """Against a version with one dictionary entry and one loop for each coordinate."""
    monkeypatch.setattr(toxicity, "PLACES", 50)
    monkeypatch.setattr(toxicity, "L1", 0.3)
    r = np.random.default_rng(6)
    rows = [np.unique(r.integers(0, 50, 8)).astype(np.uint32) for _ in range(60)]
    labels = np.array([int(3 in x or 7 in x) for x in rows])
    z, n = dict.fromkeys(range(51), 0.0), dict.fromkeys(range(51), 0.0)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for x, y in zip(rows, labels, strict=True):
            at = [*map(int, x), 50]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    place, found, bias = toxicity.fit(rows, labels)
    want = {i: w for i in range(50) if (w := weight(i))}
    assert set(place.tolist()) == set(want) and np.allclose(found, [want[i] for i in place.tolist()]) and np.isclose(bias, weight(50))
    assert 0 < len(want) < 50


def test_toxicity_of_odd_texts(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 9000 as doc_id", "text")).unionByName(spark.createDataFrame([(9100, "word " * 200_000), (9003, "a"), (None, "a")], "doc_id long, text string"))
    got = toxicity.toxicity(rows.withColumn("score", F.lit("x")), labels).where("doc_id >= 9000 or doc_id is null").collect()
    assert len(got) == len(ODD) + 4 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (9000, 9001, 9002)]
    assert len(set(same)) == 1 and len({r.score for r in got if r.doc_id in (9003, None)}) == 1


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= sum(c in "0123456789" for c in s) <= 15),
}


def test_pii(spark, docs, empty):
    tricky = ["a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.400", "4111 1111 1111 1111 1", "4111-1111-1111-1111", "+1 (234) 567-8901", "x@y", "@a.b", "a..b@c-d.e-.f", "é@a.b +12", "1.2.3", "0001.2.3.4"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, t) for k, t in enumerate(tricky)] + [(20_000, None)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        base = [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in BASE.items() for m in re.finditer(pattern, t or "") if ok(m[0])]
        assert got[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t[:80]
        assert set(base) <= set(got[k].spans.split(",")) or not base
    assert pii.find_pii(empty).count() == 0


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail jane [at] example (dot) com now", "email", "jane [at] example (dot) com"), ("jane at example dot org", "email", "jane at example dot org"),
    ("jane&#64;example.com", "email", "jane&#64;example.com"), ("x jane_at_example_dot_com", "email", "jane_at_example_dot_com"), ("jane.doe at mail.example dot co.uk is", "email", "jane.doe at mail.example dot co.uk"),
    ("jane @ example . com", "email", "jane @ example . com"), ("host 10 dot 0 dot zero dot one now", "ip", "10 dot 0 dot zero dot one"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"), ("plus four nine one seven zero one two three four five six seven", "phone", None), ("１９２.１６８.０.１", "ip", "１９２.１６８.０.１"),
])
def test_disguised(text, kind, found):
    _, every = pii.spans(text)
    assert every[kind]
    if found:
        assert [text[a:b] for a, b in every[kind]] == [found]
    assert pii.redacted(text, every).count(f"[{kind.upper()}]") == len(every[kind])


def test_plain_words_are_left_alone():
    for text in ("I was at home. We met at noon dot", "one two three four", "version 1.2.3 of 2024-01-02", "Look at example.com for details", "I was at google.com", "see you at node.js meetup", "We met at noon . Then we left",
                 "We met @ noon . Then we left", "Find it at 10.30 today", "at noon dot 5", "look at three dot one four", "a point in time, one point two", "bob & alice; at&t;"):
        assert not any(pii.spans(text)[1].values())


def test_media(spark, docs, odd, empty, tmp_path):
    folder = f"file://{tmp_path}/media"
    got = {r.doc_id: r for r in media.media_columns(odd, folder=folder).collect()}
    for k, t in [*enumerate(ODD), (99, "a b")]:
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert (r.width, r.height, r.bits) == (576, len(want) // 576, 8)
        with tarfile.open(f"{tmp_path}/media/{r.shard}") as tar:
            stored = tar.extractfile(f"{r.digest}.png").read()
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and len(stored) == r.media_bytes == r.length
        assert media.samples(BytesIO(stored).read()) == want
    assert got[4].media_sha256 == got[99].media_sha256 and got[4].feature == got[99].feature
    assert media.media_columns(empty).count() == 0


def test_equal_texts_are_stored_once(spark, tmp_path):
    """From any task: one tar member for each distinct payload, also for repeated rows, null ids, a very long text and clashing columns."""
    texts = ["a b", "c", None, "", "long " * 300_000, "é"]
    rows = [(k % 40 if k % 7 else None, texts[k % 6] if k % 5 else f"only {k}", "x") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("digest", F.lit(1)).repartition(16)
    got = media.media_columns(df, folder=f"file://{tmp_path}/media").collect()
    digest = lambda t: hashlib.sha256(media.payload(t or "")[0]).hexdigest()
    assert sorted((str(r.doc_id), r.digest) for r in got) == sorted((str(k), digest(t)) for k, t, _ in rows)
    members = [m.name for p in (tmp_path / "media").glob("*.tar") for m in tarfile.open(p).getmembers()]
    assert sorted(members) == sorted(f"{d}.png" for d in {digest(t) for _, t, _ in rows})
    assert all(r.payload_sha256 == r.digest for r in got) and len({(r.shard, r.offset) for r in got}) == len(members)
