"""The main text of web pages: boosted trees judge the nodes of a page's tree, and a decoding over the tree makes their judgements agree.

Each node with text is of the article, or not of it, or mixed. A node of the first two kinds holds only nodes of its own kind, so an article's block can't stand in a footer, nor a menu's in an article, unless what holds them is mixed. Of all ways to give the nodes kinds under this rule the likeliest is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm import boosting
from gevel.llm.dom import TRUTH, Forest, Tree, grams, parse
from gevel.llm.layouts import Layouts

#: Pages that texts for fitting are taken from, and the longest of these; pages laid out from them.
SAMPLE, LONGEST, LAID_OUT = 300, 200_000, 700
#: Parts of hashes that a share of the pages is taken by.
PLACES = 1 << 40
#: Kinds of nodes.
OURS, THEIRS, MIXED = range(3)
#: Characters of pages that are gone through at once.
AT_ONCE = 4_000_000
#: Times that a word of attributes must be met to count, and what is added to each count.
SEEN, SMOOTH = 4, 1.0


@dataclass(frozen=True)
class Extractor:
    """What tells articles: words of attributes and trees."""

    odds: dict[str, float]
    model: boosting.Model

    def kept(self, forest: Forest) -> np.ndarray:
        """Which nodes are of the article."""
        return decoded(forest, -self.model.log_shares(forest.features(self.odds))) == OURS


def decoded(forest: Forest, costs: np.ndarray) -> np.ndarray:
    """The kind of each node, so that the costs of all nodes with text are least, and what is not mixed holds only its own kind."""
    costs = costs * (forest.chars > 0)[:, None]
    whole = np.column_stack([forest.within(costs[:, OURS]), forest.within(costs[:, THEIRS])])
    has_inner = np.zeros(len(costs), bool)
    has_inner[forest.parents[forest.parents >= 0]] = True
    mixed, levels = np.where(has_inner, costs[:, MIXED], np.inf), forest.levels()
    for nodes in levels[:0:-1]:
        np.add.at(mixed, forest.parents[nodes], np.minimum(whole[nodes].min(1), mixed[nodes]))
    kinds = np.where(mixed < whole.min(1), MIXED, np.where(whole[:, OURS] < whole[:, THEIRS], OURS, THEIRS))
    for nodes in levels[1:]:
        above = kinds[forest.parents[nodes]]
        kinds[nodes] = np.where(above == MIXED, kinds[nodes], above)
    return kinds


def labelled(trees: list[Tree]) -> tuple[Forest, np.ndarray, np.ndarray]:
    """The forest of marked pages, the kind of each node by its marks, and which nodes have text."""
    forest = Forest.of(trees)
    mark = np.array([{"yes": 1, "no": 0}.get(t, -1) for t in forest.truths])
    mark[forest.roots] = 0
    for nodes in forest.levels()[1:]:
        mark[nodes] = np.where(mark[nodes] < 0, mark[forest.parents[nodes]], mark[nodes])
    size = np.bincount(forest.run_nodes, [len(r) for r in forest.runs], len(mark))
    ours, all_ = forest.within(size * (mark == 1)), forest.within(size)
    return forest, np.where(ours == 0, THEIRS, np.where(ours == all_, OURS, MIXED)), all_ > 0


def word_odds(forest: Forest, kinds: np.ndarray, used: np.ndarray) -> dict[str, float]:
    """How much each word of an attribute speaks for the article: the logarithm of its odds there."""
    ours, theirs = Counter(), Counter()
    for words, kind, use in zip(forest.words, kinds, used, strict=True):
        if use and words and kind != MIXED:
            (ours if kind == OURS else theirs).update(grams(words))
    return {w: float(np.log((ours[w] + SMOOTH) / (theirs[w] + SMOOTH))) for w in ours | theirs if ours[w] + theirs[w] >= SEEN}


def texts_of(pages: list[Tree]) -> tuple[list[str], list[str]]:
    """Long and short runs of pages' texts."""
    runs = [(r, x.tags[n]) for x in pages for r, n in zip(x.run_texts, x.run_nodes, strict=True)]
    return [r for r, t in runs if t == "p"], [r for r, t in runs if t != "p" and len(r) < 80]


def sample(df: DataFrame, html_col: str) -> DataFrame:
    """Up to SAMPLE different pages of df with at most LONGEST characters: those of the least hashes. They come from about four times as many rows that tasks send on, at any size of df."""
    pages = df.where(F.length(html_col).between(1, LONGEST)).select(F.col(html_col).alias("html"))
    share = min(1.0, 4 * SAMPLE / max(1, pages.count()))
    place = F.pmod(F.xxhash64("html"), F.lit(PLACES))
    return pages.where(place < int(share * PLACES)).distinct().orderBy(place, "html").limit(SAMPLE)


def train(df: DataFrame, html_col: str = "html") -> Extractor:
    """Fits on pages that are laid out from texts of a sample of df's pages, and on these pages themselves where they have one article element. The sample comes to the driver: at most 60 million characters."""
    some = sample(df, html_col)
    pages = [r["html"] for r in some.collect()]
    found = [parse(p) for p in pages]
    layouts = Layouts(*texts_of(found))
    marked = [re.sub(r"<article\b", f'<article {TRUTH}="yes"', p, flags=re.I) for p, t in zip(pages, found, strict=True) if t.tags.count("article") == 1]
    trees = [parse(p) for p in [layouts.page() for _ in range(LAID_OUT)] + marked]
    forest, kinds, used = labelled(trees)
    odds = word_odds(forest, kinds, used)
    # Pages count alike, however many nodes they have.
    per_page = np.add.reduceat(used.astype(float), forest.roots)
    weights = np.repeat(used.sum() / len(trees) / np.maximum(per_page, 1), np.diff([*forest.roots, len(used)]))
    x = forest.features(odds)
    return Extractor(odds, boosting.fit(x[used], kinds[used], 3, weights[used]))


def main_texts(pages: list[str], extractor: Extractor) -> list[str]:
    """The main text of each page."""
    forest = Forest.of([parse(p) for p in pages])
    keep = extractor.kept(forest)[forest.run_nodes] if len(forest.runs) else []
    return ["\n".join(forest.runs[k] for k in range(a, b) if keep[k]) for a, b in zip(forest.run_begins, forest.run_begins[1:], strict=False)]


def html_text(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", extractor: Extractor | None = None) -> DataFrame:
    """The keys of each row, text (its page's main text: blocks in their order, one line each, white space within them one space, empty if there is none) and n_chars (its code points).

    Null counts as empty. Pages are gone through whole, whatever their length; broken HTML is read as far as it goes. Rows that repeat give rows that repeat; null keys stay null; other columns don't matter; an empty table gives an empty one. Scripts, styles, form controls and titles of the window are never text. Without an extractor one is fitted, see train.
    """
    extractor = extractor or train(df, html_col)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(extractor)
    rows = df.select(*keys, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", text string, n_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(pc.binary_length(batch.column(len(keys))).to_pylist(), np.int64)
            group = np.cumsum(lengths) // AT_ONCE
            ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
            begin = 0
            for end in ends:
                part = batch.slice(begin, end - begin)
                texts = main_texts(part.column(len(keys)).to_pylist(), shared.value)
                begin = end
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    return rows.mapInArrow(work, schema)
