"""Byte-level BPE ids of whole texts.

``tokenizers`` defines the ids.  The same vocabulary and split pattern as tiktoken ranks gives the same ids several
times faster, so it is used where its file is there.  Texts that spell the special token go through ``tokenizers``, and so do
those with a run of RUN or more blanks, letters or other characters of one kind: the fast path's time and stack grow with such a run.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"
RUN = 500
_LONG = re.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.json"))


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def _ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Ids (uint32) of one text, without special tokens added."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if SPECIAL in text or not os.path.exists(ranks) or len(text) >= RUN and _LONG.search(text):
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(_ranks(ranks).encode_ordinary(text), np.uint32)
