"""Language identification by rank-order n-gram profiles.

A language's profile is the ranked list of its most frequent character n-grams (1 to 3,
within words padded by blanks) over all training texts. A document's most frequent
n-grams are ranked likewise; the out-of-place distance sums how far each of them stands
from its rank in the profile, with the profile's size where it is missing. The closest
profile wins; the score is how much closer it is than the second, 0 to 1.

An n-gram is a number, its code points in 21 bits each, so a text's n-grams are counted
by sorting an array.

Defined cases: null text or no letters: ``und`` with score 0; texts without a language
or without an id teach nothing; no training rows at all: every text is ``und``; equal
distances go to the first language by name; equal counts rank by the n-gram's number;
repeated rows count each time; an empty table gives no rows; further columns drop.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROFILE, TOP = 400, 300
#: Languages that profiles are kept for; more labels than that are an error, since all profiles go to every task.
LANGUAGES = 5000
_BITS, _SPACE = np.uint64(21), 0x20
#: Characters of one language that a task gathers before it counts their n-grams. Bounds memory, not results.
GATHER = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams_of(text: str) -> np.ndarray:
    """All 1- to 3-grams of a text as numbers, repeats included: within words, which stand between single blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    after = np.concatenate([[False], letter[:-1]])
    s = np.where(letter, points, _SPACE)[letter | after]
    s = np.concatenate([[_SPACE], s, [_SPACE] * int(s[-1] != _SPACE)]).astype(np.uint64)
    two = s[:-1] << _BITS | s[1:]
    return np.concatenate([s[s != _SPACE], two, (two[:-1] << _BITS | s[2:])[s[1:-1] != _SPACE]])


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams in order, and their counts."""
    s = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def gram_text(gram: int) -> str:
    parts = [gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF]
    return "".join(chr(p) for p in parts if p)


def learn(docs: DataFrame, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """(lang, gram, rank from 0): size rows for each language, from all rows of docs (text, lang). Counts are summed
    in each task before they are shuffled; only the profiles reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        held: dict[str, int] = {}

        def count(lang: str) -> pa.RecordBatch:
            grams, n = counted(grams_of(" ".join(texts.pop(lang))))
            held[lang] = 0
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                texts.setdefault(lang, []).append(text)
                held[lang] = held.get(lang, 0) + len(text)
                if held[lang] > GATHER:
                    yield count(lang)
        for lang in list(texts):
            yield count(lang)

    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # Ranks up to a constant: each task keeps its first n-grams before they meet in one task a language.
    top = sums.withColumn("rank", rank).where(F.col("rank") <= size).limit(size * LANGUAGES + 1).collect()
    if len(top) > size * LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return [(r.lang, r.gram, r.rank - 1) for r in top]


def _judge(profiles: list[tuple[str, int, int]], size: int, top: int):
    """A function of a text to (language, score), made once in each task."""
    langs = sorted({lang for lang, _, _ in profiles})
    known = np.array(sorted({g for _, g, _ in profiles}), dtype=np.uint64)
    ranks = np.full((len(known) + 1, len(langs)), -1, dtype=np.int32)
    for lang, gram, rank in profiles:
        ranks[np.searchsorted(known, np.uint64(gram)), langs.index(lang)] = rank

    def judge(text: str | None) -> tuple[str, float]:
        grams, counts = counted(grams_of(text or ""))
        if not len(grams) or not langs:
            return "und", 0.0
        best = grams[np.argsort(-counts, kind="stable")[:top]]
        at = np.searchsorted(known, best)
        at[known[np.minimum(at, len(known) - 1)] != best] = len(known)
        theirs = ranks[at]
        away = np.where(theirs < 0, size, np.minimum(np.abs(theirs - np.arange(len(best))[:, None]), size)).sum(axis=0)
        win = int(np.argmin(away))
        if len(langs) == 1:
            return langs[0], 1.0 - float(away[0]) / (size * len(best))
        second = int(np.partition(away, 1)[1])
        return langs[win], float((second - away[win]) / second) if second else 0.0

    return judge


def predict(docs: DataFrame, profiles: list[tuple[str, int, int]], size: int = PROFILE, top: int = TOP) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(profiles, size, top)
        for batch in batches:
            got = [judge(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(folds: int) -> F.Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def keep_known(docs: DataFrame, folds: int = 5) -> DataFrame:
    """docs without the rows whose language stays undetermined: null texts and texts without letters. Without any
    profile nothing is judged and all rows stay. All columns pass through as they are; nothing is shuffled."""
    profiles = learn(docs.where(~held_out(folds)))
    if not profiles:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(profiles, PROFILE, TOP)
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py())[0] != "und" for t in batch["text"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
