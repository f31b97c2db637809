"""Reads public tokenizer files once for each Python worker."""

from __future__ import annotations

import base64
import functools

import public_tokenizers
import sentencepiece
import tiktoken

END_OF_TEXT = "<|endoftext|>"


def path(name: str) -> str:
    """The place of an installed vocabulary file."""
    return public_tokenizers.path(name)


@functools.cache
def byte_level(file: str) -> tiktoken.Encoding:
    """A byte-level BPE from a file of ranks; the free id after the ranks is the end-of-text string's."""
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


@functools.cache
def pieces(file: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=file)
