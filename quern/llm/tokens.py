"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary used where none is given: byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that parts text before the merges of a rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; the kind of tokenizer follows from the file's ending."""
    if vocabulary.endswith(".tiktoken"):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if vocabulary.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of vocabulary: {vocabulary}")


def with_token_counts(df: DataFrame, text_column: str, *, vocabulary: str = VOCABULARY, count: str = "n_tokens") -> DataFrame:
    """Replaces ``text_column`` by its number of tokens; null and empty texts have none. Nothing is shuffled."""
    kept = [c for c in df.columns if c not in (text_column, count)]
    fields = [df.schema[c] for c in kept] + [T.StructField(count, T.IntegerType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = counter(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            counts = size([t or "" for t in batch.column(at).to_pylist()])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], names=[*kept, count])

    return df.select(*[F.col(f"`{c}`") for c in [*kept, text_column]]).mapInArrow(run, T.StructType(fields))
