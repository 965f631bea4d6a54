"""Token ids of a public byte-level BPE vocabulary.

Ids are those of the ``tokenizers`` library for ``vocabulary`` (a file of
``public_tokenizers``). Texts of plain Latin characters take a faster encoder over the
same ranks, which gives the same ids (tested); any other text, and any text that
contains the vocabulary's special token, goes through ``tokenizers`` itself."""

from __future__ import annotations

import base64
import os
import re
import sys

import numpy as np
from pyspark import cloudpickle

from .words import process_cache

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
END_OF_TEXT = 50256


def _fast(vocabulary: str):
    cache = process_cache("bpe")
    if vocabulary not in cache:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[vocabulary] = (tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}),
                             re.compile("[^\\x00-\\u024f]").search)
    return cache[vocabulary]


def _library(vocabulary: str, special: bool):
    cache = process_cache("bpe")
    if (vocabulary, special) not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        t.encode_special_tokens = not special
        cache[vocabulary, special] = t
    return cache[vocabulary, special]


def encode(text: str, special: bool = True, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of a text as uint32; with ``special`` the special token's string in a
    text is that token (the library's default), else ordinary text."""
    fast, other = _fast(vocabulary)
    if other(text) is None and SPECIAL not in text:
        return np.asarray(fast.encode_to_numpy(text), np.uint32)
    return np.asarray(_library(vocabulary, special).encode(text, add_special_tokens=False).ids, np.uint32)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
