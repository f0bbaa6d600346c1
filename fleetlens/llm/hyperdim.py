"""Language identification with hyperdimensional profiles.

Every letter (and the blank between words) has a random vector of +1 and -1 that depends on
its code point alone. A trigram is the product of its three letters' vectors, the first rotated by two
places and the second by one, so that order counts. A text is the sum of its trigrams'
vectors, a language the sum of its training texts' vectors; a text gets the language whose
vector has the largest cosine with its own, ties the smaller name by code point.

Sums are whole numbers, so a model does not depend on the order in which tasks end. Tasks send one
vector per language; these are added in two levels. The model holds ``DIMENSIONS``
numbers for each distinct language name, whatever the number of rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and teaches nothing;
so is every text if no language was learned; rows with a null lang or doc_id teach nothing, and a
null doc_id is not held out; repeated rows count as often as they stand; an empty table gives an empty result.
Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import in_batches, landed, summed_vectors, text_rows

DIMENSIONS = 1024
BLANK = 32
SLICE, COLUMNS = 256, 4096  # texts and trigrams multiplied at once
UNKNOWN = "und"


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(20_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([20, code]).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three code points of 21 bits) of the lower-cased words with a blank at both ends, and their counts."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter()[code]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.concatenate(([BLANK], np.where(letter, code, BLANK), [BLANK]))
    code = code[np.concatenate(([True], (code[1:] != BLANK) | (code[:-1] != BLANK)))]
    return np.unique(code[:-2] << 42 | code[1:-1] << 21 | code[2:], return_counts=True)


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    """One row per trigram: rotated letter vectors, multiplied."""
    letters, place = np.unique(np.concatenate((keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF)), return_inverse=True)
    table = np.stack([letter_vector(int(c)) for c in letters])
    first, second, third = place.reshape(3, -1)
    return np.roll(table, 2, 1)[first] * np.roll(table, 1, 1)[second] * table[third]


def bundles(groups: list[list[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """One vector per group of profiles: the sum over its trigrams, exact."""
    out = np.zeros((len(groups), DIMENSIONS), np.float64)
    profiles = [(g, k, n) for g, members in enumerate(groups) for k, n in members]
    if not profiles:
        return out
    owner = np.repeat(np.array([g for g, _, _ in profiles]), [len(k) for _, k, _ in profiles])
    count = np.concatenate([n for _, _, n in profiles])
    keys, place = np.unique(np.concatenate([k for _, k, _ in profiles]), return_inverse=True)
    # Doubles hold every sum of a slice exactly; single precision does while the counts of a group stay below 2^24.
    kind = np.float32 if np.bincount(owner, count).max(initial=0) < 1 << 24 else np.float64
    order = np.argsort(place, kind="stable")
    owner, count, place = owner[order], count[order], place[order]
    for at in range(0, len(keys), COLUMNS):
        a, b = np.searchsorted(place, (at, at + COLUMNS))
        width = min(COLUMNS, len(keys) - at)
        weights = np.bincount(owner[a:b] * width + place[a:b] - at, count[a:b], len(groups) * width).reshape(-1, width)
        out += weights.astype(kind) @ trigram_vectors(keys[at : at + COLUMNS]).astype(kind)
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> vector, from the text and lang of all rows of ``docs``."""
    out = pa.schema([("key", pa.string()), ("part", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                groups: dict[str, list] = {}
                for text, lang in text_rows(iter([batch.slice(at, SLICE)]), "text", "lang"):
                    profile = trigrams(text)
                    if len(profile[0]):
                        groups.setdefault(lang, []).append(profile)
                for lang, vector in zip(groups, bundles([*groups.values()]), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector.astype(np.int64)
        part = TaskContext.get().partitionId()
        yield from in_batches(((k, part, v.tobytes()) for k, v in sums.items()), out, 200)

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    found = summed_vectors(rows.mapInArrow(run, "key string, part long, vector binary"))
    # One row per language, of a fixed size.
    return {r.key: np.frombuffer(r.vector, np.int64) for r in landed(found, "languages").collect()}


def predict(docs: DataFrame, languages: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score (cosine, negative ones as 0) for every row."""
    names = sorted(languages, key=lambda s: s.encode("utf-8", "surrogatepass"))
    matrix = np.array([languages[n] for n in names], np.float64).reshape(len(names), DIMENSIONS)
    matrix /= np.maximum(1e-300, np.sqrt((matrix**2).sum(1)))[:, None]
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix.T.copy()))
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = [(i, trigrams(t)) for i, t in text_rows(iter([batch.slice(at, SLICE)]), "doc_id", "text")]
                vectors = bundles([[p] for _, p in rows])
                size = np.sqrt((vectors**2).sum(1))
                if names:
                    cosine = (vectors @ unit) / np.maximum(1e-300, size)[:, None]
                    best = cosine.argmax(1)
                    score = np.clip(cosine[np.arange(len(rows)), best], 0, 1)
                known = [bool(names) and len(p[0]) > 0 for _, p in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([names[best[j]] if k else UNKNOWN for j, k in enumerate(known)], pa.string()),
                    pa.array([float(score[j]) if k else 0.0 for j, k in enumerate(known)], pa.float64()),
                ], schema=out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; languages are learned from the rows that are not held out."""
    languages = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, languages).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
