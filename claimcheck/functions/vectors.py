"""Vector columns and text encoders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimcheck.loading import load_once, model_key

from claimcheck.functions import text as tx

#: Words whose buckets a Python worker remembers, about 15 MB; others are hashed again.
KNOWN_WORDS = 100_000
#: Texts that an encoder is given at a time.
ENCODED_ROWS = 2048


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit vector as float array; a zero vector stays as it is."""
    return tx.let(
        l2_norm(v),
        lambda norm: F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(
            v.cast("array<float>")
        ),
    )


class Encoder(Protocol):
    """Text to vectors.  ``load`` runs once per Python worker, its result once for some of a batch."""

    name: str

    def load(self) -> Callable[[pd.Series], np.ndarray]: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Word counts hashed into ``dim`` buckets; needs no model and is fully reproducible.

    Counts are kept as they are, searching divides by the norms.
    """

    dim: int = 256

    @property
    def name(self) -> str:
        return f"hashing-{self.dim}"

    def load(self) -> Callable[[pd.Series], np.ndarray]:
        bucket_of: dict[str, int] = {}

        def bucket(word: str) -> int:
            found = bucket_of.get(word)
            if found is None:
                found = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:6], 16) % self.dim
                if len(bucket_of) < KNOWN_WORDS:
                    bucket_of[word] = found
            return found

        def encode(texts: pd.Series) -> np.ndarray:
            out = np.zeros((len(texts), self.dim), dtype=np.float32)
            for row, text in enumerate(texts):
                buckets = [bucket(word) for word in (text or "").split()]
                if buckets:
                    out[row] = np.bincount(buckets, minlength=self.dim)
            return out

        return encode


def encoded(encode: Callable[[pd.Series], np.ndarray], texts: pa.Array) -> pa.Array:
    """A list of floats for each text: only ``ENCODED_ROWS`` of them are Python strings at once."""
    flat, sizes = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), ENCODED_ROWS):
        part = texts.slice(at, ENCODED_ROWS).to_pylist()
        rows = np.asarray(encode(pd.Series(part, dtype=object)), dtype=np.float32)
        flat.append(rows.reshape(-1))
        sizes.append(np.full(len(part), rows.shape[1]))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.float32()))


def encode_text(encoder: Encoder) -> Callable[[Column], Column]:
    """Column function that embeds a text column, one model load per worker process."""
    key = model_key(encoder.load)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load_once(key, encoder.load)
        for texts in batches:
            yield encoded(encode, texts)

    # Encoding is costly: never let the optimizer evaluate it twice.
    return run.asNondeterministic()
