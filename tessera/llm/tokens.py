"""Sizes in tokens of a public tokenizer, counted in Arrow batches.

The vocabulary file is a parameter; it is loaded once per Python worker and never copied. All
of a text is encoded, however long it is. NULL and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files, and the one used unless another is asked for.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Splits a text before the merges of a rank file (part of that file's definition).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Blanks in a row from which on a run is cut out.
LONG_RUN = 1000

_loaded: dict[str, Callable[[str], int]] = {}


def _blank_safe(encoding) -> Callable[[str], int]:
    """Counts tokens without giving very long runs of blanks to the split pattern, whose look-ahead overflows its stack on them.

    The pattern makes such a run one piece, but for its last blank if something follows; a piece is
    merged by itself, so the parts add up to the count of the whole.
    """
    long_run = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")

    def count(text: str) -> int:
        total, start = 0, 0
        for run in long_run.finditer(text) if len(text) >= LONG_RUN else ():
            end = run.end() - (run.end() < len(text))
            total += len(encoding.encode_ordinary(text[start : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
            start = end
        return total + len(encoding.encode_ordinary(text[start:] if start else text))

    return count


def counter(vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Callable[[str], int]:
    """A function from a text to its number of tokens."""
    path = os.path.join(folder, vocabulary)
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        count = _blank_safe(tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}))
    elif path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(model.encode(text))
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    _loaded[path] = count
    return count


def n_tokens(text: str, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> Column:
    """Number of tokens of a text column as INT; 0 for NULL."""

    @F.pandas_udf("int")
    def count_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(vocabulary, folder)
        for part in parts:
            yield pd.Series([count(t) if t else 0 for t in part], dtype="int32")

    return count_tokens(F.col(text))
