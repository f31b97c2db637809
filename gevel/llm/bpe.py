"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one valid encoding, so it has one last token. An automaton over the vocabulary lists the tokens that end at each place; a token is the last one of its prefix exactly if the encoding of what stands before it ends in a token that it is compatible with: the merges of both, side by side, would not join across. Back-pointers from the whole word give its ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from gevel.llm.pretokens import Store, batches_of, points, word_starts

NEVER = 1 << 60
_LOWER = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself if it prints, else the next free one from 256 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printing else chr(next(free)) for b in range(256)]


class Encoder:
    """A vocabulary with merges, whose words end in a suffix."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.suffix = suffix
        self.strings = dict(zip(vocabulary.values(), vocabulary, strict=True))
        self.rank = {(vocabulary[a], vocabulary[b]): k for k, (a, b) in enumerate(merges)}
        self.parts = {}
        for a, b in merges:
            self.parts.setdefault(vocabulary[a + b], (vocabulary[a], vocabulary[b]))
        self.letters = byte_letters()
        self.automaton = ahocorasick.Automaton()
        for string, k in vocabulary.items():
            spelled = string[: -len(suffix)] + "\0" if string.endswith(suffix) else string
            self.automaton.add_word(spelled, (len(spelled), k))
        self.automaton.make_automaton()
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along one edge of a token's merge tree, from the letter up, each with the rank of the merge that takes it up."""
        found = []
        above = NEVER
        while True:
            found.append((token, above))
            if token not in self.parts:
                return found[::-1]
            above = self.rank[self.parts[token]]
            token = self.parts[token][side]

    def _met(self, a: int, b: int) -> tuple[int, int] | None:
        """The first tokens that would merge across the border of a and b."""
        if a not in self.right:
            self.right[a] = self._edge(a, 1)
        if b not in self.left:
            self.left[b] = self._edge(b, 0)
        xs, ys = self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, up_x), (y, up_y) = xs[i], ys[j]
            across = self.rank.get((x, y), NEVER)
            # Of equal ranks the leftmost goes first.
            if across < up_x and across <= up_y and across < NEVER:
                return x, y
            if up_x == NEVER and up_y == NEVER:
                return None
            if up_x <= up_y:
                i += 1
            else:
                j += 1

    def reached(self, token: int) -> bool:
        """The token's own text is encoded as that token."""
        found = self.whole.get(token)
        if found is None:
            pair = self.parts.get(token)
            found = self.whole[token] = pair is None or (self.reached(pair[0]) and self.reached(pair[1]) and self._met(*pair) == pair)
        return found

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[key] = self._met(a, b) is None
        return found

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        letters = self.letters
        text = "".join([letters[b] for b in word.encode()])
        n = len(text)
        last: list[tuple[int, int]] = [(-1, 0)] * (n + 2)
        # The last letter and the suffix are one symbol: no prefix ends between them.
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n + 2)]
        for end, match in self.automaton.iter(text + "\0"):
            matches[end + 1].append(match)
        for end in (*range(1, n), n + 1):
            for size, token in matches[end]:
                begin = end - size
                if begin == n or not self.reached(token):
                    continue
                if begin == 0 or last[begin][0] >= 0 and self.compatible(last[begin][0], token):
                    last[end] = token, begin
                    break
        if last[n + 1][0] < 0:
            raise ValueError(f"no tokens for {word!r}")
        out = []
        at = n + 1
        while at:
            token, at = last[at]
            out.append(token)
        return out[::-1]


class Tokenizer:
    """The parts of a tokenizer file that its results depend on."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        self.encoder = Encoder(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.strings = self.encoder.strings | {v: k for k, v in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.store = Store(lambda words: [np.array(self.encoder.encode(w), np.int32) for w in words], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become those tokens."""
        parts, owners = [], []
        special: dict[int, int] = {}
        for k, text in enumerate(texts):
            for part in self.cut.split(text) if "<|" in text else (text,):
                if part in self.special:
                    special[len(parts)] = self.special[part]
                    parts.append("")
                else:
                    parts.append(lowered(part))
                owners.append(k)
        cp, starts = points(parts)
        begins, ends = word_starts(cp, starts) if len(cp) else (np.zeros(0, np.int64),) * 2
        ids, sizes = self.store.rows(self.store.of(cp, begins, ends)) if len(begins) else (np.zeros(0, np.int32),) * 2
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, starts)]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for k, owner in enumerate(owners):
            found[owner].append(np.array([special[k]], np.int32) if k in special else ids[upto[k] : upto[k + 1]])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with a blank between them, as without a decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def lowered(text: str) -> str:
    """NFC and lower case, each character for itself; beyond U+1800 by the library's tables, which are of a newer Unicode."""
    if not text.isascii():
        if max(text) >= "\u1800":
            return _LOWER.normalize_str(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@functools.cache
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def encode_decode(df: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each row, and with keep also (ids array<int>, decoded).

    ids_sha256 is of the ids as little-endian unsigned 32-bit numbers, decoded_sha256 of the decoded text in UTF-8. Null counts as empty, which has no ids; repeated rows stay; an empty table gives an empty one. Distinct words are encoded once for each worker.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for a, b in batches_of(texts):
                for ids in own.encode(texts[a:b]):
                    decoded = own.decode(ids)
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep:
                        out[3].append(ids)
                        out[4].append(decoded)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())] if keep else []), names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
