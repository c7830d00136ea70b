"""Hashes and min-hash signatures with fixed arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offset and prime of 32-bit FNV-1a, modulus and generator of the permutations, the value of an empty set.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
PERMUTATION_PRIME = 4294967291
LCG_SEED, LCG_FACTOR, LCG_STEP = 42, 1664525, 1013904223
EMPTY = 0xFFFFFFFF
BANDS, ROWS = 16, 8
PLACES = BANDS * ROWS


def coefficients(n: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of n permutations, drawn by the linear congruential generator."""
    state, a, b = LCG_SEED, [], []
    for _ in range(n):
        state = (state * LCG_FACTOR + LCG_STEP) % (1 << 32)
        a.append(state % (PERMUTATION_PRIME - 1) or 1)
        state = (state * LCG_FACTOR + LCG_STEP) % (1 << 32)
        b.append(state % PERMUTATION_PRIME)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, unsigned."""
    step = lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(FNV_OFFSET).cast("long"), step)


def _fnv(word: str) -> int:
    h = FNV_OFFSET
    for unit in word.encode("utf-16-le")[::2] if word.isascii() else [int.from_bytes(word.encode("utf-16-le")[i : i + 2], "little") for i in range(0, len(word.encode("utf-16-le")), 2)]:
        h = ((h ^ unit) * FNV_PRIME) & 0xFFFFFFFF
    return h


def minhash(n: int = 128):
    """An Arrow function: signature of the set of words of an array column (all EMPTY for an empty or null one)."""
    a, b = coefficients(n)

    @F.pandas_udf("array<bigint>")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for words in batch:
                words = set(words) if words is not None else ()
                if not words:
                    out.append([EMPTY] * n)
                    continue
                h = np.array([known[w] if w in known else known.setdefault(w, _fnv(w)) for w in words], np.uint64)
                # a*h + b stays below 2^64
                out.append(((a[:, None] * h[None, :] + b[:, None]) % np.uint64(PERMUTATION_PRIME)).min(axis=1).astype(np.int64))
            yield pd.Series(out)

    return signature


def is_empty_signature(sig: Column) -> Column:
    return sig.isNull() | F.forall(sig, lambda v: v == EMPTY)


def packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a signature column as bytes of the same order (about half the size of an array); null for an empty set or a null one.

    Unsigned 32-bit places take four bytes each; a signature with any other
    place (or a null one, as -1) takes eight each and a last byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            array = batch.column(at)
            out = [None] * batch.num_rows
            values = pc.fill_null(array.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False))
            small, narrow = (values >= 0) & (values <= EMPTY), values.astype(">u4")
            for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
                if (values[start:end] != EMPTY).any():
                    out[i] = narrow[start:end].tobytes() if small[start:end].all() else values[start:end].astype(">i8").tobytes() + b"\1"
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {'binary' if c == column else kind}" for c, kind in df.dtypes))


def unpacked(column: pa.Array) -> np.ndarray:
    """The first places of packed signatures, a row each; -1 where there is none."""
    out = np.full((len(column), PLACES), -1, np.int64)
    for i, x in enumerate(column.to_pylist()):
        if x is not None:
            places = np.frombuffer(x, ">u4") if len(x) % 4 == 0 else np.frombuffer(x[:-1], ">i8")
            out[i, : places.size] = places[:PLACES]
    return out


def equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places the rows of two tables of signatures share; a missing place equals none."""
    return ((a == b) & (a >= 0)).sum(axis=1)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 if either set is empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(is_empty_signature(a) | is_empty_signature(b), 0.0).otherwise(same / F.size(a))


def band_hashes(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Signed 32-bit FNV-1a of each band's values as little-endian bytes."""
    byte = lambda h, v, s: (h.bitwiseXOR(F.shiftright(v, s).bitwiseAND(F.lit(255))) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    value = lambda h, v: byte(byte(byte(byte(h, v, 0), v, 8), v, 16), v, 24)
    band = lambda i: F.aggregate(F.slice(sig, i * rows + 1, rows), F.lit(FNV_OFFSET).cast("long"), value)
    signed = lambda h: F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: signed(band(i)))
