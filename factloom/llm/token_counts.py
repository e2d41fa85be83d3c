"""Token counts without token ids.

Per task, each distinct pre-token is counted once (a bounded memo for the worker), joined to the document's
frequencies and summed. No shuffle: a document's count needs its own text alone.

Null text: empty, 0 tokens. Null doc_id: the row stays. Repeated rows, and rows that share a doc_id: one result each.
Very long texts: whole, in time that grows with their length where their pre-tokens do not (a single pre-token is
merged as the library does it). Other columns, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import counter, vocabulary_path
from .common import table, texts

TOKEN_LIMIT = 1024


def token_counts(documents: DataFrame, tokenizer_path: str, token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of documents."""

    def count(batches):
        of = counter(tokenizer_path)
        for batch in batches:
            read = batch.column("text").to_pylist()
            tokens = [of.count(x) for x in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x.encode()) for x in read], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > token_limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(documents).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())
