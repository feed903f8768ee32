"""Text and vector similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence of whole texts, bit-parallel (Hyyrö 2004).

    One bit per character of the longer text, one step per character of the shorter one.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    codes = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    masks = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(a)}
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & masks[c]
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def indel_similarity(a: str | None, b: str | None) -> float | None:
    """``2*LCS / (len a + len b)``; two empty texts are equal."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    return 2.0 * lcs_length(a, b) / (len(a) + len(b))


WORD = 64


def lcs_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Longest common subsequence of every pair, pairs with a text of up to 64 characters all at once.

    Each such pair is one 64-bit word with a bit per character of its shorter text, and one step takes the
    next character of all longer ones. Pairs of two longer texts are one wide integer each.
    """
    out = np.zeros(len(pairs), np.int64)
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    short = np.array([i for i, (a, _) in enumerate(pairs) if 0 < len(a) <= WORD], np.int64)
    for i, (a, b) in enumerate(pairs):
        if len(a) > WORD:
            out[i] = lcs_length(a, b)
    # the longest first, so that pairs whose text has ended are a tail
    short = short[np.argsort([-len(pairs[i][1]) for i in short], kind="stable")]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, len(short), 4096):
        some = short[lo : lo + 4096]
        lengths, sizes = (np.array([len(pairs[i][k]) for i in some]) for k in (1, 0))
        steps = np.zeros((len(some), lengths[0]), np.uint32)
        bits = np.full((len(some), sizes.max()), 0xFFFFFFFF, np.uint32)  # no character
        steps[np.arange(lengths[0])[None, :] < lengths[:, None]] = codes("".join(pairs[i][1] for i in some))
        bits[np.arange(bits.shape[1])[None, :] < sizes[:, None]] = codes("".join(pairs[i][0] for i in some))
        place = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
        full = np.full(len(some), np.iinfo(np.uint64).max) >> (WORD - sizes).astype(np.uint64)
        v, live = full.copy(), len(some)
        for j in range(lengths[0]):
            while lengths[live - 1] <= j:
                live -= 1
            u = v[:live] & ((bits[:live] == steps[:live, j : j + 1]) * place).sum(axis=1, dtype=np.uint64)
            v[:live] = ((v[:live] + u) | (v[:live] - u)) & full[:live]
        out[some] = sizes - np.bitwise_count(v)
    return out


def indel_similarities(pairs: list[tuple[str | None, str | None]]) -> np.ndarray:
    """:func:`indel_similarity` of every pair, each different pair once; missing texts give NaN."""
    known: dict[tuple, int] = {}
    at = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
    different = list(known)
    scores = np.ones(len(different))
    odd = [i for i, (a, b) in enumerate(different) if a is not None and b is not None and a != b]
    total = np.array([len(different[i][0]) + len(different[i][1]) for i in odd], float)
    scores[odd] = 2.0 * lcs_lengths([different[i] for i in odd]) / total
    scores[[i for i, (a, b) in enumerate(different) if a is None or b is None]] = np.nan
    return scores[at]


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(indel_similarities(list(zip(a, b)))).replace({np.nan: None}).astype("Float64")


@F.pandas_udf(DoubleType())
def _list_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    both, most = sizes.min(axis=1), sizes.max(axis=1)
    sims = indel_similarities([(p, q) for x, y in zip(a, b) for p, q in zip(x, y)])
    ends = np.cumsum(both)
    total = np.array([sims[e - n : e].sum() for e, n in zip(ends, both)])
    return pd.Series(np.where(most == 0, 1.0, np.where(both == 0, 0.0, total / np.maximum(most, 1))))


def text_similarity(ref: Column, out: Column) -> Column:
    """Scalar comparison: both missing 1, one missing 0, else the indel ratio."""
    both, one = ref.isNull() & out.isNull(), ref.isNull() | out.isNull()
    return F.when(both, 1.0).when(one, 0.0).otherwise(indel_ratio(ref, out))


def list_similarity(ref: Column, out: Column) -> Column:
    """Positional mean of two lists; positions that one list lacks count 0."""
    empty = F.array().cast("array<string>")
    return _list_ratio(F.coalesce(ref, empty), F.coalesce(out, empty))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
