"""Scores: clamped similarity, fuzzy file names, and their weighted sum with term overlap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text

#: A raw fuzzy score of this much counts one half (fixed value).
FUZZY_HALF = 50.0
#: Scored names that a task remembers.
NAMES = 1 << 16


@dataclass(frozen=True)
class RankingWeights:
    """Weights at query time, not normalised; the defaults are fixed values."""

    semantic: float = 0.55
    fuzzy: float = 0.30
    content: float = 0.15


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, 0 where negative or NaN; vectors of unequal length have 0."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) != F.size(b)) | F.isnan(total) | (total < 0), 0.0).otherwise(F.coalesce(total, F.lit(0.0)))


def similarity(embedding: Column, values) -> Column:
    """dot() with one vector for all rows: a matrix product on Arrow batches."""
    query = np.asarray(values, np.float64)

    @F.arrow_udf(DoubleType())
    def run(vectors: pa.Array) -> pa.Array:
        lists = vectors.fill_null([])
        off = np.asarray(lists.offsets)
        fits = np.diff(off) == len(query)
        flat = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
        off = off - off[0]
        x = flat.reshape(-1, len(query)) if fits.all() and len(query) else flat[off[:-1][fits][:, None] + np.arange(len(query))]
        out = np.zeros(len(lists))
        with np.errstate(all="ignore"):
            found = x @ query if len(query) else np.zeros(len(x))
        out[fits] = np.where(found > 0, found, 0.0)
        return pa.array(out)

    return run(embedding)


def vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]) if len(values) else F.array().cast("array<double>")


def fuzzy_raw(name: str, query: str) -> int:
    """Score of the best way to find `query` in `name` as a subsequence; 0 if it is none.

    An affine-gap alignment: 16 for each character, 8 more at the start of a word and 6 more next
    to the match before; a gap costs 3 and 1 for each further character. Case counts only where
    the query has capitals.
    """
    if not query:
        return 0
    written, none = name, -(10**9)
    if query == query.lower() and len(name.lower()) == len(name):
        name = name.lower()
    ends = [none] * (len(name) + 1)  # best score with the query so far matched and its last character at i
    for k, q in enumerate(query):
        new, gap = [none] * (len(name) + 1), none
        for i, c in enumerate(name, 1):
            if c == q:
                start = i == 1 or not written[i - 2].isalnum() or (written[i - 1].isupper() and written[i - 2].islower())
                before = 0 if k == 0 else max(ends[i - 1] + 6, gap)
                if before > none // 2:
                    new[i] = before + 16 + 8 * start
            gap = max(gap - 1, ends[i - 1] - 3 if k else none)
        ends = new
    return max(0, *ends)


def fuzzy(query: str):
    """A column function on file names: raw / (raw + FUZZY_HALF). Each distinct name of a task is scored once."""

    @F.arrow_udf(DoubleType())
    def run(names: pa.Array) -> pa.Array:
        coded = names.fill_null("").dictionary_encode()
        new = [n for n in coded.dictionary.to_pylist() if n not in seen]
        if len(seen) + len(new) > NAMES:
            seen.clear()
            new = coded.dictionary.to_pylist()
        for n in new:
            raw = fuzzy_raw(n, query)
            seen[n] = raw / (raw + FUZZY_HALF)
        return pa.array(np.array([seen[n] for n in coded.dictionary.to_pylist()], np.float64)[np.asarray(coded.indices)])

    seen: dict[str, float] = {}
    return run


def hybrid(semantic: Column, fuzzy_score: Column | None, content: Column, weights: RankingWeights) -> Column:
    """The weighted sum; without a fuzzy score, as for questions, its weight goes to similarity."""
    if fuzzy_score is None:
        return (weights.semantic + weights.fuzzy) * semantic + weights.content * content
    return weights.semantic * semantic + weights.fuzzy * fuzzy_score + weights.content * content


def stored_overlap(query: str, terms: Column) -> Column:
    """overlap() by stored terms instead of the content; equal but for hashes of 64 bits that collide."""
    asked = text.terms(query)
    if not asked:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*[text.term_hash(F.lit(t)) for t in asked]), terms)) / len(asked)


def overlap(query: str, content: Column) -> Column:
    terms = text.terms(query)
    return text.content_match(F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>"), content)
