"""Token counts with public tokenizers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of ``text`` (null counts 0). ``tokenizer`` None: byte level, one token a UTF-8 byte, in the JVM. Otherwise
    the path of a ``tokenizers`` JSON file or a ``sentencepiece`` model, which every executor can read."""
    if tokenizer is None:
        return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            for s in batches:
                yield pd.Series([len(x) for x in model.encode(s.fillna("").tolist(), num_threads=1)], dtype="int64")
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(tokenizer)
            model.encode_special_tokens = True
            for s in batches:
                yield pd.Series([len(x.ids) for x in model.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count(text)
