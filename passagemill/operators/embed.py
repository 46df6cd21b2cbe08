"""Vectors for texts: hashed words, plug-in providers, request batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import constants as K
from passagemill.functions import text

WORD = re.compile("[a-z0-9]+")


NO_LIMIT = (1 << 31) - 1
HASHED_WORDS = "hashed-words"


@dataclass(frozen=True)
class Provider:
    """A vector producer with its request limits. ``embed`` keeps the order of its inputs."""

    embed: Callable[[list[str]], list[list[float]]]
    dimensions: int
    max_input_tokens: int = K.MAX_INPUT_TOKENS
    max_request_tokens: int = K.MAX_REQUEST_TOKENS
    max_batch_size: int = K.MAX_BATCH_SIZE
    name: str = "custom"


def token_weights(df: DataFrame, key: str, column: str, dimensions: int) -> DataFrame:
    """Hashed words per key and dimension, zeros included; integer weights, so sums are exact.

    A text is one row, so the map-side sum already leaves one row per dimension.
    """

    def place_and_sign(code: Column) -> Column:
        sign = F.when(F.shiftright(code, 16) % 2 == 0, 1).otherwise(-1)
        return F.struct((code % dimensions).cast("int").alias("dimension"), sign.alias("weight"))

    zeros = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda place: F.struct(place.alias("dimension"), F.lit(0).alias("weight")),
    )
    tokens = text.embedding_tokens(F.coalesce(F.col(column), F.lit("")))
    words = F.transform(F.transform(tokens, text.hash_token), place_and_sign)
    entries = df.select(key, F.explode(F.concat(words, zeros)).alias("entry")).select(key, "entry.*")
    return entries.groupBy(key, "dimension").agg(F.sum("weight").cast("double").alias("weight"))


def hash_embedding(df: DataFrame, key: str, column: str, dimensions: int) -> DataFrame:
    """Unit vector ``embedding`` of hashed words per unique key; a text without words has the zero vector."""
    ordered = F.array_sort(F.collect_list(F.struct("dimension", "weight")))
    dense = token_weights(df, key, column, dimensions).groupBy(key).agg(
        F.transform(ordered, lambda entry: entry["weight"]).alias("embedding")
    )
    return dense.withColumn("embedding", text.normalise(F.col("embedding")))


def hash_state(token: str) -> int:
    state = K.FNV_OFFSET
    for code in token.encode():
        state = (state ^ code) * K.FNV_PRIME % K.FNV_MODULUS
    return state


def hash_provider(dimensions: int) -> Provider:
    """The same hashed-word vectors as a provider, for plans that already run in Python.

    Nothing is requested from anywhere, so texts of any length are embedded. Each distinct word of a request is hashed once.
    """

    def embed(texts: list[str]) -> list[list[float]]:
        numbers: dict[str, int] = {}
        vectors = np.zeros((len(texts), dimensions))
        found = []
        for value in texts:
            words = WORD.findall(value.lower())
            found.append(np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), dtype=np.int64, count=len(words)))
        states = np.fromiter(map(hash_state, numbers), dtype=np.int64, count=len(numbers))
        places, signs = states % dimensions, np.where(states >> 16 & 1, -1.0, 1.0)
        for row, ids in zip(vectors, found):
            row += np.bincount(places[ids], weights=signs[ids], minlength=dimensions)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.divide(vectors, norms, out=vectors, where=norms > 0).tolist()

    return Provider(embed, dimensions, max_input_tokens=NO_LIMIT, max_request_tokens=NO_LIMIT, name=HASHED_WORDS)


def request_ranges(sizes: list[int], provider: Provider) -> Iterator[tuple[int, int]]:
    """Greedy requests within the token and count caps, in input order."""
    start, total = 0, 0
    for place, size in enumerate(sizes):
        if place > start and (place - start >= provider.max_batch_size or total + size > provider.max_request_tokens):
            yield start, place
            start, total = place, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def embed_with_provider(df: DataFrame, column: str, provider: Provider, token_count: str = "token_count") -> DataFrame:
    """Adds ``embedding``. Oversize texts get none; quarantine them first to report them.

    Only texts and their sizes travel to Python.
    """

    def embed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, sizes in batches:
            fits = np.flatnonzero((sizes <= provider.max_input_tokens).to_numpy())
            vectors: list[list[float] | None] = [None] * len(texts)
            for start, end in request_ranges([int(sizes.iat[place]) for place in fits], provider):
                made = provider.embed([texts.iat[place] for place in fits[start:end]])
                if len(made) != end - start:
                    raise ValueError(f"provider returned {len(made)} vectors for {end - start} inputs")
                if any(len(vector) != provider.dimensions for vector in made):
                    raise ValueError(f"provider returned vectors that have not {provider.dimensions} dimensions")
                for place, vector in zip(fits[start:end], made):
                    vectors[place] = vector
            yield pd.Series(vectors)

    kernel = F.pandas_udf(embed, "array<double>").asNondeterministic()
    return df.withColumn("embedding", kernel(F.col(column), F.col(token_count)))


def embed_all(df: DataFrame, column: str, key: str, provider: Provider, token_count: str = "token_count") -> DataFrame:
    """``embed_with_provider`` that fails at a text over the input limit, naming its ``key`` and size."""
    size, most = F.col(token_count), provider.max_input_tokens
    reason = F.concat(F.lit("text of "), F.col(key).cast("string"), F.lit(" has "), size.cast("string"), F.lit(f" tokens, the provider takes {most}"))
    checked = F.when(size > most, F.raise_error(reason).cast(df.schema[column].dataType)).otherwise(F.col(column))
    return embed_with_provider(df.withColumn(column, checked), column, provider, token_count)


def l2_normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, text.normalise(F.col(column)))


def missing_embeddings(chunks: DataFrame) -> DataFrame:
    """Chunks without a vector: what the vector arm silently cannot return."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("chunks_missing_embedding")
    )
