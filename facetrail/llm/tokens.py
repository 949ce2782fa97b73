"""Encoding of a corpus with a public tokenizer, and decoding back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.llm import bpe

VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a rank file: a path as it is, a name from the installed vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def _bare(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    Null and empty texts have an empty list; a null key is kept; repeated rows give repeated rows; strings that look like
    special tokens are ordinary text; other columns are left behind, whatever their names. Texts are encoded whole, in one
    pass without a shuffle; only distinct words of a slice are encoded one by one.
    """
    path = vocabulary_path(vocabulary)
    rows = _bare(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            for first, n in bpe.pieces_of(batch.column(1)):
                part = batch.slice(first, n)
                enc = coder.texts(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(enc.text_token0, pa.int32()), pa.array(enc.ids(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    schema = T.StructType([rows.schema["key"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).toDF(key, ids)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, tokens: str = "n_tokens") -> DataFrame:
    """The columns of ``keep`` and the number of tokens of the text, 0 for null and empty ones."""
    path = vocabulary_path(vocabulary)
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            for first, n in bpe.pieces_of(batch.column(len(keep))):
                part = batch.slice(first, n)
                counts = coder.texts(part.column(len(keep))).counts()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "n"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType())])
    return rows.mapInArrow(run, schema).toDF(*keep, tokens)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """(key, text): the inverse of ``encode_corpus``; null and empty lists give an empty text, bytes that are no UTF-8 a
    replacement character."""
    path = vocabulary_path(vocabulary)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            lists = batch.column(1)
            out = [coder.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else "" for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    schema = T.StructType([rows.schema["key"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).toDF(key, text)
