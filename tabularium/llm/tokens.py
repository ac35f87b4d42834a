"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder and file of the vocabulary; every function takes another path as a parameter.
TOKENIZER = os.environ.get("TABULARIUM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Public pre-tokenisation pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def counter(path: str):
    """A function text -> number of tokens for a vocabulary file (.tiktoken, .json or .model)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        coder = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(coder.encode_ordinary(text))
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda text: len(tok.encode(text, add_special_tokens=False).ids)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text, num_threads=1))


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(id_col, *keep, tokens) per row of df. Null and empty texts have 0 tokens; whole texts are counted."""
    kept = df.select(id_col, *keep, text_col)
    schema = kept.drop(text_col).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            sizes = [count(t) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "tokens"])

    return kept.mapInArrow(run, schema)
