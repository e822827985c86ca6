"""Token counts by a public byte-level tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator  # noqa: TC003 (read by pandas_udf)

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sitewise.shared import ship, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of blanks beyond this are encoded apart, as the library's pattern engine can't take them at any length.
RUN = 4096
#: Fixed value: the blanks that the pattern's \\s stands for.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_loaded: dict = {}


def encoder(path: str):  # noqa: ANN201
    """The encoder for a vocabulary file, loaded once in a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """The ids of the whole text, those of the tokenizer at any length; decoding them gives the text back.

    The pattern takes a run of blanks before a word as one piece up to its last blank, and the last with the word; so a
    long run is cut there and merged as the one piece that it is.
    """
    e = encoder(path)
    if len(text) <= RUN or not re.search(BLANK + "{%d}" % RUN, text):
        return e.encode_ordinary(text)
    out, at = [], 0
    for run in re.finditer(BLANK + "{%d,}" % RUN, text):
        end = run.end() - (run.end() < len(text))  # the last blank goes with what follows
        out += e.encode_ordinary(text[at : run.start()]) + e._encode_single_piece(text[run.start() : end])
        at = end
    return out + e.encode_ordinary(text[at:])


def n_tokens(c: Column, path: str = VOCABULARY) -> Column:
    @F.pandas_udf(LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda s: len(encode(s, path)) if isinstance(s, str) else 0)

    return count(c)


def counted(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, same, n_tokens, row) of the documents that have a text, written once; `same` is one for equal
    texts, `row` differs for every row, repeated documents included."""
    ship(documents.sparkSession)
    return written(documents.where("text is not null").select("doc_id", "source", F.xxhash64("text").alias("same"), n_tokens(F.col("text"), path).alias("n_tokens"), F.monotonically_increasing_id().alias("row")))
