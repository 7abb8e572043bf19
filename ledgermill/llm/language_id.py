"""Language identification by rank order: the most frequent letter n-grams of a text against those of each language.

Profiles are learned in Spark: every task counts n-grams per language in a fixed table, only sums are shuffled, and the
most frequent ones of a language in descending order are its profile. A text is ranked likewise, and its distance to a
language is the sum over its n-grams of how far each is out of place; one that the profile lacks costs the most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

PROFILE = 400
#: Slots of the n-gram table: n-grams of one to three letters are hashed to so many.
SLOTS = 1 << 16
UNDETERMINED = "und"
#: A profile table of at most so many languages goes to every task.
MOST_LANGUAGES = 10_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts by slot of the n-grams of one to three letters inside the words of a text, a space at either end of a word
    included; None if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[codes]
    if not inside.any():
        return None
    keep = inside.copy()
    keep[1:] |= inside[:-1]                     # the first other character after a word stands for the space
    line = np.concatenate([[0], np.where(inside, codes, 0)[keep]]).astype(np.uint64)
    if inside[-1]:
        line = np.append(line, np.uint64(0))
    space = line == 0
    two = (line[:-1] * _MIX[0]) ^ (line[1:] + np.uint64(2))
    keys = [line[~space] * _MIX[1], (two * _MIX[1])[~(space[:-1] & space[1:])]]
    three = (two[:-1] * _MIX[0]) ^ (line[2:] + np.uint64(3))
    keys.append((three * _MIX[1])[~space[1:-1]])
    return np.bincount((np.concatenate(keys) >> np.uint64(48)).astype(np.int64), minlength=SLOTS)


def ranking(counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Slots in descending order of count, ties by slot, at most `size`."""
    used = np.flatnonzero(counts)
    return used[np.lexsort((used, -counts[used]))[:size]]


def learn_profiles(labelled: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE) -> DataFrame:
    """lang, slot, rank of all labelled rows. Rows of null lang or without letters add nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                counts = ngram_counts(value.as_py())
                if counts is not None:
                    name = name.as_py()
                    sums[name] = sums[name] + counts if name in sums else counts
            if len(sums) > 64:                  # many labels: hand over what is counted, so that memory stays bounded
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    def rows(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(used), pa.string()), "slot": pa.array(used, pa.int32()),
                                              "n": pa.array(counts[used], pa.int64())})
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    summed = (known.select(F.col(lang).cast("string"), text).mapInArrow(run, "lang string, slot int, n long")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "slot"))       # at most SLOTS rows a language
    return summed.select("lang", "slot", (rank - 1).alias("rank")).where(F.col("rank") < size)


def rank_table(profiles: DataFrame, size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """Languages in order and a table languages x slots of ranks, `size` where a profile lacks the slot. Only profiles
    reach the driver: at most `size` rows a language, and the number of languages is checked."""
    found = profiles.limit(MOST_LANGUAGES * size + 1).toPandas()
    if len(found) > MOST_LANGUAGES * size:
        raise ValueError("more languages than a profile table in memory may have")
    names = sorted(found["lang"].unique())
    table = np.full((len(names), SLOTS), size, np.int16)
    table[np.searchsorted(names, found["lang"].to_numpy()) if names else [], found["slot"].to_numpy(int)] = found["rank"].to_numpy()
    return names, table


def classify(text: str | None, names: list[str], table: np.ndarray, size: int = PROFILE) -> tuple[str, float]:
    """Language of the least distance (ties: the first by name) and 1 - distance / greatest possible distance."""
    counts = ngram_counts(text) if names else None
    if counts is None:
        return UNDETERMINED, 0.0
    ranked = ranking(counts, size)
    distances = np.abs(table[:, ranked].astype(np.int64) - np.arange(len(ranked))).sum(axis=1)
    # a slot that a profile lacks costs `size` less its own rank; count it in full
    missing = table[:, ranked] == size
    distances += (missing * np.arange(len(ranked))).sum(axis=1)
    best = int(np.argmin(distances))
    return names[best], float(1.0 - distances[best] / (size * len(ranked)))


def identify(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """All rows and columns of `docs` with `_lang_pred` and `_lang_score`. Only the text is looked at, and all of it. Null,
    empty and letterless texts: und, 0. If nothing was learned, every text is und."""
    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [classify(t.as_py(), *shared.value) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "_lang_pred", "_lang_score"])
    return docs.mapInArrow(run, schema)


def held_out(docs: DataFrame):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    names, table = rank_table(learn_profiles(docs.where(~held_out(docs)).select("lang", "text")))
    slim = docs.select("doc_id", held_out(docs).alias("held_out"), "text")
    return identify(slim, names, table).select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
