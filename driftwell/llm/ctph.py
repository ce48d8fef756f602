"""Context-triggered piecewise hashing.

A rolling hash over seven bytes triggers a boundary where it meets the block size; each
piece gives one base64 character. Two signatures are kept, at the block size and its
double, and signatures of the same block size are compared by edit distance, all pairs of
a batch at once with bit-parallel arithmetic. What follows the last allowed boundary is
folded into the last character, so the whole text counts.

Defined cases: null text counts as empty, whose fingerprint is ``3::``; equal
fingerprints are alike 1, also when empty; fingerprints of incompatible block sizes, or
whose signatures share no run of seven characters (of the whole shorter signature, where
that is shorter), are alike 0; rows without id come first in order, ties go by text,
repeated rows each have their own place; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._arrays import mix, rolling
from ._shared import cut_table, n_tasks, text_bytes

WINDOW, LEAST_BLOCK, LENGTH, COMMON = 7, 3, 64, 7
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.frombuffer(_ALPHABET, dtype=np.uint8)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_NULL_FIRST = -(1 << 63)


def _signature(rolled: np.ndarray, trigger: np.ndarray, block: int, most: int) -> str:
    cuts = np.flatnonzero(trigger % np.uint32(block) == block - 1)[: most - 1] + 1
    starts = np.concatenate([[0], cuts])
    starts = starts[starts < len(rolled)]
    return _CODES[(np.add.reduceat(rolled, starts) >> np.uint64(7) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block:signature:signature at twice the block."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(data):
        return f"{LEAST_BLOCK}::"
    rolled = rolling(np.concatenate([np.zeros(WINDOW - 1, dtype=np.uint64), _BYTES[data]]), WINDOW)
    trigger = (rolled >> np.uint64(32)).astype(np.uint32)
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    while True:
        own = _signature(rolled, trigger, block, LENGTH)
        if len(own) >= LENGTH // 2 or block == LEAST_BLOCK:
            break
        block //= 2
    return f"{block}:{own}:{_signature(rolled, trigger, 2 * block, LENGTH // 2)}"


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of signatures of up to 64 characters (Myers' bit vectors, one pair a lane)."""
    n, one = len(a), np.uint64(1)
    la, lb = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    grid = lambda xs: np.frombuffer("".join(x.ljust(LENGTH, "\0") for x in xs).encode(), dtype=np.uint8).reshape(n, LENGTH)
    ga, gb, lane = grid(a), grid(b), np.arange(n)
    eqs = np.zeros((n, 128), dtype=np.uint64)
    for i in range(LENGTH):
        np.bitwise_or.at(eqs, (lane, ga[:, i]), np.where(i < la, one << np.uint64(i), np.uint64(0)))
    pv, mv, score = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64), la.copy()
    top = np.maximum(la - 1, 0).astype(np.uint64)
    for j in range(int(lb.max(initial=0))):
        live = j < lb
        eq = eqs[lane, gb[:, j]]
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += np.where(live, (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        pv, mv = np.where(live, mh | ~(xv | ph), pv), np.where(live, ph & xv, mv)
    return np.where(la == 0, lb, score)


def _share_run(a: str, b: str) -> bool:
    k = min(COMMON, len(a), len(b))
    return k > 0 and not {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint({b[i : i + k] for i in range(len(b) - k + 1)})


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 less the edit distance over the longer signature, at a shared block size."""
    out, todo = np.zeros(len(pairs)), []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        sides = [(x1, y1), (x2, y2)] if bx == by else [(x1, y2)] if bx == 2 * by else [(x2, y1)] if 2 * bx == by else []
        todo += [(i, p, q) for p, q in sides if _share_run(p, q)]
    if todo:
        far = edit_distances([p for _, p, _ in todo], [q for _, _, q in todo])
        longer = np.array([max(len(p), len(q)) for _, p, q in todo])
        np.maximum.at(out, [i for i, _, _ in todo], 1 - far / longer)
    return out


def edited(text: str, following: str) -> str:
    """text with its last quarter (in code points, rounded down) replaced by as much of following, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(pairs: list[tuple]) -> list[list]:
    """Columns of FOUND for (doc_id, text, its fingerprint, the following text, that one's fingerprint)."""
    new = [edited(text, following) for _, text, _, following, _ in pairs]
    prints = [fingerprint(x) for x in new]
    near = likeness([(own, p) for (_, _, own, _, _), p in zip(pairs, prints)]), likeness([(own, following) for _, _, own, _, following in pairs])
    return [[d for d, *_ in pairs], [len(t) for _, t, *_ in pairs], [hashlib.sha256(x.encode()).hexdigest() for x in new], [own for _, _, own, _, _ in pairs], prints, *[x.tolist() for x in near]]


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            yield batch.slice(at, 1000)


def compare(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are dealt over ranges of ids (equal ids: of the beginnings of their texts), each in order in one task, which
    sees every row beside the next one but for its last. Each range's first and last texts are kept, and the last of each
    meets the first of the next range that has rows. Ranges come from Spark's bounded sample of ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_FIRST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(n_tasks(spark, text_bytes(rows)), "key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def out(found: list[list], edges: list[tuple[bool, int | None, str]]) -> pa.RecordBatch:
            n, m = len(found[0]), len(edges)
            columns = [pa.array([*c, *([None] * m)], t) for c, t in zip(found, _TYPES)]
            columns[0] = pa.array([*found[0], *[d for _, d, _ in edges]], pa.int64())
            columns += [pa.array([part] * (n + m), pa.int32()), pa.array([None] * n + [is_last for is_last, _, _ in edges], pa.bool_()), pa.array([None] * n + [t for _, _, t in edges], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "part", "is_last", "text"])

        for batch in _slices(batches):
            pairs, first = [], last is None
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                own = fingerprint(text)
                if last is not None:
                    pairs.append((*last, text, own))
                last = (doc, text, own)
            if len(batch):
                yield out(_judged(pairs), [(False, None, batch["text"][0].as_py())] if first else [])
        if last is not None:
            yield out([[] for _ in _TYPES], [(True, last[0], last[1])])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["following"].to_pylist())
            found = _judged([(d, t, fingerprint(t), x, fingerprint(x)) for d, t, x in texts])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, _TYPES)], names=list(_NAMES))

    done = cut_table(ranged.mapInArrow(run, f"{FOUND}, part int, is_last boolean, text string"))
    edges = done.where(F.col("is_last").isNotNull())
    # One small number a range: each range's successor, the first one's for the last.
    parts = edges.where(~F.col("is_last")).select("part")
    after = parts.select("part", F.lead("part").over(W.orderBy("part")).alias("next")).crossJoin(F.broadcast(parts.agg(F.min("part").alias("least"))))
    after = after.select("part", F.coalesce("next", "least").alias("next"))
    firsts = edges.where(~F.col("is_last")).select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = edges.where("is_last").select("doc_id", "part", "text").join(after, "part").join(firsts, "next")
    return done.where(F.col("is_last").isNull()).select(*_NAMES).unionByName(lasts.select("doc_id", "text", "following").mapInArrow(meet, FOUND))
