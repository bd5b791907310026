"""Token counts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=2)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(texts: list[str], path: str) -> list[int]:
    t, out = load(path), []
    for i in range(0, len(texts), 64):
        out += [len(e) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
    return out


def with_tokens(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, *more: str) -> DataFrame:
    """(doc, more..., tokens) of every row with an id and a text; the text itself is left behind."""
    rows = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), *[F.col(c).alias(c) for c in more], F.col(text).alias("_text"))
    kept = rows.drop("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = token_counts(b.column(b.num_columns - 1).to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int32())], [*b.schema.names[:-1], "tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", tokens int")
