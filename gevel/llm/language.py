"""Language identification by a linear-chain conditional random field over the words of a text.

Each word is a place in the chain and each language a label. A word speaks for languages by its n-grams of letters, its affixes and the lexicons that hold it; learned transitions say how readily a text changes its language from one word to the next. Forward-backward gives each word's share of every language, which labels the words of mixed texts; a text's language is the one with the largest share of its words.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gevel.llm.pretokens import LETTER, NUMBER, batches_of, point_classes, points
from gevel.llm.stages import dropped, frugal, written
from gevel.llm.toxicity import fold
from gevel.llm.words import hashed_points, mixed, parts

#: Places that n-grams and affixes are hashed to; the longest n-gram and the longest affix.
PLACES, GRAM, AFFIX = 1 << 16, 4, 3
#: Labelled rows that the model is fitted on, about (taken by a hash of the id, as many for each language, one at least); four times as many at most.
SAMPLE = 2000
#: Letters of the n-grams that tell whether words are of any learned language.
KNOWN_GRAM = 3
#: Frequent words of each language in its lexicon.
LEXICON = 2000
#: Passes over the sample, words in one step, and the step's size.
PASSES, STEP_WORDS, RATE = 3, 20_000, 0.3
#: Characters of texts that are gone through at once.
AT_ONCE = 1 << 18
UNKNOWN = "und"


@dataclass
class Field:
    """A fitted model: languages in order, weights of places, lexicons and transitions."""

    languages: list[str]
    grams: np.ndarray
    words: np.ndarray
    member: np.ndarray
    lexicon: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    #: Logarithms of how frequent n-grams are, a mean word's and text's, and how words and texts spread about them.
    seen: np.ndarray
    usual: tuple[float, float, float] = (0.0, 1.0, 1.0)

    @staticmethod
    def empty(languages: list[str]) -> Field:
        k = len(languages)
        return Field(languages, np.zeros((PLACES, k)), np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((k, k)), np.zeros((k, k)), np.zeros(k), np.zeros(PLACES, np.float32))


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, begins, ends, index of each text's first word, one more at the end); words are runs of letters."""
    cp, starts = points([t.lower() for t in texts])
    letter = np.zeros(len(cp) + 1, bool)
    letter[:-1] = point_classes()[cp] == LETTER
    edge = np.zeros(len(cp) + 1, bool)
    edge[starts] = True
    before = np.zeros_like(letter)
    before[1:] = letter[:-1]
    begins = np.flatnonzero(letter & (~before | edge))
    ends = np.flatnonzero(before & (~letter | edge))
    return cp, begins, ends, np.searchsorted(begins, starts)


def _flat(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[i] .. begins[i] + sizes[i] - 1 of all i in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def word_features(cp: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) of every n-gram and affix of each word."""
    sizes = ends - begins
    letters = cp[_flat(begins, sizes)].astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    last = np.cumsum(sizes) - 1
    inside = np.arange(len(letters)) - np.repeat(last + 1 - sizes, sizes)
    key = np.zeros(len(letters), np.uint64)
    places, words = [], []
    for n in range(1, GRAM + 1):
        key[1:] = key[:-1] * np.uint64(0x9E3779B97F4A7C15)
        key[0] = 0
        key += letters + np.uint64(1)
        if n < 2:
            key = letters + np.uint64(1)
        whole = np.flatnonzero(inside >= n - 1)
        found = mixed(key[whole] + np.uint64(n << 32))
        places.append(found)
        words.append(owner[whole])
        if n <= AFFIX:
            head = inside[whole] == n - 1
            tail = whole == last[owner[whole]]
            for side, salt in ((head, 0x5851F42D4C957F2D), (tail, 0x14057B7EF767814F)):
                places.append(mixed(found[side] + np.uint64(salt)))
                words.append(owner[whole][side])
    return (np.concatenate(places) & np.uint64(PLACES - 1)).astype(np.int64), np.concatenate(words)


def lexicons_of(model: Field, hashes: np.ndarray) -> np.ndarray:
    """Which languages' lexicons hold each word, as numbers 0 and 1."""
    if not len(model.words):
        return np.zeros((len(hashes), len(model.languages)))
    at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
    return model.member[at] * (model.words[at] == hashes)[:, None]


def emissions(model: Field, place: np.ndarray, word: np.ndarray, n: int, member: np.ndarray) -> np.ndarray:
    """What each of n words says for each language."""
    out = member @ model.lexicon
    for k in range(len(model.languages)):
        out[:, k] += np.bincount(word, model.grams[place, k], n)
    return out


def known_grams(cp: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, word) of every run of KNOWN_GRAM letters of each word with a mark before and behind it."""
    sizes = ends - begins + 2
    marked = np.zeros(int(sizes.sum()), np.uint64)
    heads = np.cumsum(sizes) - sizes
    marked[_flat(heads + 1, sizes - 2)] = cp[_flat(begins, sizes - 2)].astype(np.uint64) + np.uint64(1)
    counts = np.maximum(sizes - KNOWN_GRAM + 1, 0)
    at = _flat(heads, counts)
    key = np.zeros(len(at), np.uint64)
    for k in range(KNOWN_GRAM):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + marked[at + k])
    return (key & np.uint64(PLACES - 1)).astype(np.int64), np.repeat(np.arange(len(sizes)), counts)


def familiar(model: Field, cp: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How frequent the n-grams of each word are in what was learned, as a mean of logarithms."""
    place, word = known_grams(cp, begins, ends)
    return np.bincount(word, model.seen[place], len(begins)) / np.maximum(np.bincount(word, minlength=len(begins)), 1)


def apart(cp: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, text) of each text's distinct words that no digit touches, unlike the pieces of keys and numbers."""
    digit = np.append(point_classes()[cp] == NUMBER, False)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    some = np.flatnonzero(~digit[begins - 1] & ~digit[ends])
    _, at = np.unique(mixed(hashed_points(cp, begins[some], ends[some]) + text[some].astype(np.uint64)), return_index=True)
    some = np.sort(some[at])
    return begins[some], ends[some], text[some]


def learn_grams(model: Field, cp: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray) -> None:
    """Counts the n-grams of each half of the texts; what is usual is told by the other half's counts, and in the end all count."""
    begins, ends, text = apart(cp, begins, ends, first)
    place, word = known_grams(cp, begins, ends)
    says = np.zeros(len(begins))
    for half in (0, 1, 2):
        own = text % 2 == half
        counts = np.bincount(place[~own[word]], minlength=PLACES)
        model.seen = np.log((counts + 0.5) / (counts.sum() + 0.5 * PLACES)).astype(np.float32)
        says[own] = familiar(model, cp, begins[own], ends[own])
    n = np.bincount(text, minlength=len(first) - 1)
    means = (np.bincount(text, says, len(first) - 1) / np.maximum(n, 1))[n >= 20]
    if len(says):
        model.usual = float(np.median(means if len(means) else says)), float(says.std()) + 1e-3, float(means.std() if len(means) > 1 else 0.0) + 1e-3


def marginals(says: np.ndarray, first: np.ndarray, moves: np.ndarray, starting: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, pairs): each word's shares of the languages, and the expected number of each move, by forward-backward.

    says (n, k) are the words' scores of all texts in a row, first flags each text's first word. All texts are one chain in which a first word forgets what is before it. The chain is cut into equal blocks: the product of each block's steps is taken for all blocks at once, then carried from block to block, then all blocks are walked at once from what reaches them; the result is exact.
    """
    n, k = says.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    step = np.exp(moves - moves.max())
    start = np.exp(starting - starting.max())
    length = max(1, int(n**0.5) // 2)
    blocks = -(-n // length)
    psi = np.ones((blocks * length, k))
    psi[:n] = np.exp(says - says.max(1, keepdims=True))
    fresh = np.ones(blocks * length, bool)
    fresh[:n] = first
    psi, fresh = psi.reshape(blocks, length, k), fresh.reshape(blocks, length)

    def advance(x: np.ndarray, t: int, sums: np.ndarray, moved: np.ndarray) -> np.ndarray:
        return np.where(fresh[:, t].reshape((-1,) + (1,) * (x.ndim - 1)), sums * start, moved) * (psi[:, t] if x.ndim == 2 else psi[:, t, None])

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(length):
        product = advance(product, t, product.sum(2, keepdims=True), product @ step)
        product /= product.max((1, 2), keepdims=True)
    carried = np.ones((blocks, k)) / k
    for b in range(1, blocks):
        x = carried[b - 1] @ product[b - 1]
        carried[b] = x / x.sum()
    behind = np.ones((blocks, k)) / k
    for b in range(blocks - 2, -1, -1):
        x = product[b + 1] @ behind[b + 1]
        behind[b] = x / x.sum()
    forward = np.empty((blocks, length, k))
    x = carried
    for t in range(length):
        x = advance(x, t, x.sum(1, keepdims=True), x @ step)
        x /= x.sum(1, keepdims=True)
        forward[:, t] = x
    backward = np.empty((blocks, length, k))
    x = behind
    for t in range(length - 1, -1, -1):
        backward[:, t] = x
        y = psi[:, t] * x
        x = np.where(fresh[:, t, None], (y @ start)[:, None], y @ step.T)
        x /= x.sum(1, keepdims=True)
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    # Moves into every word that is not a text's first.
    before = np.concatenate([carried[:, None], forward[:, :-1]], 1).reshape(-1, k)
    after = (psi * backward).reshape(-1, k)
    some = np.flatnonzero(~fresh.reshape(-1))
    weight = np.einsum("ik,kl,il->i", before[some], step, after[some])
    pairs = (before[some] / weight[:, None]).T @ after[some] * step
    return p.reshape(-1, k)[:n], pairs


def fit(texts: list[str], labels: list[int], languages: list[str], seed: int = 3) -> Field:
    """Fits the field to labelled texts: half of them as they are, half cut into runs of 5 to 40 words that are shuffled into mixed texts of eight runs, from which moves between languages are learned."""
    model = Field.empty(languages)
    k = len(languages)
    random = np.random.default_rng(seed)
    cp, begins, ends, first = text_words(texts)
    if not len(begins):
        return model
    learn_grams(model, cp, begins, ends, first)
    label = np.repeat(np.array(labels), np.diff(first))
    hashes = hashed_points(cp, begins, ends)
    frequent = [np.unique(hashes[label == j], return_counts=True) for j in range(k)]
    kept = [w[np.lexsort((w, -n))[:LEXICON]] for w, n in frequent]
    model.words = np.unique(np.concatenate(kept))
    model.member = np.stack([np.isin(model.words, w) for w in kept], 1).astype(float)

    # The chain: runs of words (begin, end, whether a text starts there).
    runs = [(a, b, True) for a, b in zip(first[:-1:2], first[1::2], strict=False) if b > a]
    mixed_runs = []
    for a, b in zip(first[1:-1:2], first[2::2], strict=False):
        while a < b:
            size = int(random.integers(5, 41))
            mixed_runs.append((a, min(b, a + size)))
            a += size
    runs += [(*mixed_runs[j], at % 8 == 0) for at, j in enumerate(random.permutation(len(mixed_runs)))]
    order = random.permutation(len(starts := [j for j, r in enumerate(runs) if r[2]]))
    texts_of_runs = [runs[a:b] for a, b in zip(starts, [*starts[1:], len(runs)], strict=True)]
    steps: list[list[tuple[int, int, bool]]] = [[]]
    size = 0
    for j in order:
        steps[-1] += texts_of_runs[j]
        size += sum(b - a for a, b, _ in texts_of_runs[j])
        if size >= STEP_WORDS:
            steps.append([])
            size = 0
    squares = [np.full_like(x, 1e-6) for x in (model.grams, model.lexicon, model.moves, model.first)]
    for _ in range(PASSES):
        for step in steps:
            if not step:
                continue
            begin, end, fresh = (np.array(x) for x in zip(*step, strict=True))
            index = _flat(begin, end - begin)
            is_first = np.zeros(len(index), bool)
            is_first[(np.cumsum(end - begin) - (end - begin))[fresh]] = True
            y = label[index]
            distinct, at, inverse = np.unique(hashes[index], return_index=True, return_inverse=True)
            place, word = word_features(cp, begins[index[at]], ends[index[at]])
            member = lexicons_of(model, distinct)
            says = emissions(model, place, word, len(distinct), member)[inverse]
            p, pairs = marginals(says, is_first, model.moves, model.first)
            p[np.arange(len(y)), y] -= 1
            wrong = np.stack([np.bincount(inverse, p[:, j], len(distinct)) for j in range(k)], 1)
            true_pairs = np.zeros((k, k))
            np.add.at(true_pairs, (y[:-1][~is_first[1:]], y[1:][~is_first[1:]]), 1)
            slopes = [
                np.stack([np.bincount(place, wrong[word, j], PLACES) for j in range(k)], 1),
                member.T @ wrong,
                pairs - true_pairs,
                p[is_first].sum(0),
            ]
            for x, g, s in zip((model.grams, model.lexicon, model.moves, model.first), slopes, squares, strict=True):
                g = g / len(y) * 1000 + 1e-4 * x
                s += g * g
                x -= RATE * g / np.sqrt(s)
    model.grams = model.grams.astype(np.float32)
    return model


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (3, 1)) -> Field:
    """A field fitted on about SAMPLE rows, of every language one at least, whose crc32(id as text) modulo held_out[0] is not held_out[1]; those texts go to one task."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where((fold(F.col("id"), held_out[0]) != held_out[1]) & F.col("lang").isNotNull())
    counts = written(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64("id")).alias("least")), "languages")
    kinds = counts.count()
    if not kinds:
        return Field.empty([])
    each = max(1, SAMPLE // kinds)
    # The row of the least hash is there of every language, so none is unknown for being rare.
    near = F.expr(f"n <= {each} or (xxhash64(id) & {(1 << 53) - 1}) < {each} / n * {float(1 << 53)!r} or xxhash64(id) = least")
    sample = written(rows.join(F.broadcast(counts) if kinds <= 4 * SAMPLE else counts, "lang").where(near).select("text", "lang").limit(4 * max(SAMPLE, kinds)), "sample")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(t, x) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t}, key=lambda e: (hash_of(e[0]), e))
        model = fit([t for t, _ in found], [languages.index(x) for _, x in found], languages)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    model = pickle.loads(sample.repartition(1).mapInArrow(frugal(learn), "model binary").first()["model"])
    dropped(counts, sample)
    return model


def hash_of(text: str) -> int:
    """An order of texts that doesn't depend on how they arrive, nor sorts like texts together."""
    cp, _ = points([text])
    return int(hashed_points(cp, np.array([0]), np.array([len(cp)]))[0])


def shares(model: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, begins, ends, first): each word's shares of the languages, where it stands in the lower-cased texts, and each text's first word."""
    cp, begins, ends, first = text_words(texts)
    if not len(begins) or not model.languages:
        return np.zeros((len(begins), len(model.languages))), begins, ends, first
    distinct, at, inverse = np.unique(hashed_points(cp, begins, ends), return_index=True, return_inverse=True)
    place, word = word_features(cp, begins[at], ends[at])
    says = emissions(model, place, word, len(distinct), lexicons_of(model, distinct))[inverse]
    is_first = np.zeros(len(begins), bool)
    is_first[first[:-1][np.diff(first) > 0]] = True
    p, _ = marginals(says, is_first, model.moves, model.first)
    return p, begins, ends, first


def predict(model: Field, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Each text's language and its share of the words; `und` and 0 without a letter or a model."""
    p, _, _, first = shares(model, texts)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    upto = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
    total = upto[first[1:]] - upto[first[:-1]]
    n = np.diff(first)
    best = total.argmax(1)
    score = np.clip(total[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
    return [model.languages[j] if c else UNKNOWN for j, c in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def strangeness(model: Field, texts: list[str]) -> np.ndarray:
    """By how many spreads each text's n-grams are rarer than usual in what was learned, whatever language its words are of; few words spread more. A text's words count once each, pieces of keys and numbers not at all. 0 without a word or a model."""
    cp, begins, ends, first = text_words(texts)
    if not len(begins) or not model.languages:
        return np.zeros(len(texts))
    begins, ends, text = apart(cp, begins, ends, first)
    n = np.bincount(text, minlength=len(texts))
    means = np.bincount(text, familiar(model, cp, begins, ends), len(texts)) / np.maximum(n, 1)
    middle, by_word, by_text = model.usual
    return np.where(n > 0, (middle - means) / np.sqrt(by_text**2 + by_word**2 / np.maximum(n, 1)), 0.0)


def identify(df: DataFrame, model: Field, text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """All columns of df and, by the names given, (lang_pred, score double): the language of most of the text's words and its share of them; by a third name, also its strangeness (double). Null texts and texts without a letter have `und` and 0. Repeated rows stay; columns of df with these names are replaced."""
    rest = [c for c in df.columns if c not in names]
    rows = df.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, at, AT_ONCE)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found, score = predict(shared.value, texts)
            added = [pa.array(found, pa.string()), pa.array(score), *([pa.array(strangeness(shared.value, texts))] if names[2:] else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    kinds = (StringType(), DoubleType(), DoubleType())
    return rows.mapInArrow(frugal(work), StructType([*rows.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=False))]))


def label_words(df: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, position, word, lang, score) of each word of each row, words lower-cased and numbered from 0: what language it is in, in its place in the text. Null texts and texts without a letter have no words."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batches_of(texts, AT_ONCE):
                p, begins, ends, first = shares(model, texts[a:b])
                n = len(begins) if model.languages else 0
                joined = "".join(t.lower() for t in texts[a:b])
                best = p.argmax(1) if n else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(a, b), np.diff(first))[:n]
                arrays = [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array((np.arange(len(begins)) - np.repeat(first[:-1], np.diff(first)))[:n], pa.int64()),
                    pa.array([joined[i:j] for i, j in zip(begins[:n], ends[:n], strict=True)], pa.string()),
                    pa.array([model.languages[j] for j in best], pa.string()),
                    pa.array(p[np.arange(n), best] if n else np.zeros(0)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "position", "word", "lang", "score"])

    return rows.mapInArrow(frugal(work), f"id {kind}, position long, word string, lang string, score double").withColumnRenamed("id", id_col)


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of each row of df, by a field that is trained on df's own labelled rows outside the held-out part.

    Without any labelled row every language is `und`. A null id is held out of learning and has held_out null; texts that are null, empty or without a letter are `und` with score 0; an empty table gives an empty one. Only the text goes into a prediction.
    """
    model = train(df, id_col, text_col, lang_col, held_out)
    rows = df.select(F.col(id_col).alias("id"), _held(F.col(id_col), held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return identify(rows, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def _held(ident: Column, held_out: tuple[int, int]) -> Column:
    return fold(ident, held_out[0]) == held_out[1]
