"""Removal of recurring passages by repeated-phrase automata.

A phrase is a run of 35 words. Documents are dealt over buckets of a few MB.

1. Each bucket sends the hashes of its distinct phrases, packed into one block for each
   range of hash values, to the task of that range. A phrase that a third of all
   documents share is sent once by each bucket, not once by each document.
2. Each range confirms the phrases that several buckets sent and returns them to these.
   What is returned is confirmed a second time in the same way, by an independent hash
   of the words: 128 bits together.
3. Each bucket compiles its recurring phrases (confirmed ones, and those that it holds
   twice itself, compared word by word) into Aho-Corasick automata, one for each shard of
   at most a million words, and streams all of its documents through them. A pattern is
   the core that up to 18 neighbouring phrases share; at each hit the phrases around it
   are looked up word by word. So a word goes only where its text recurs.

All uses of the documents read the same exchange: texts are shuffled once.

Defined cases: null and empty texts have no words, nothing is removed; texts under 35
words stay; a row repeated whole is a document of its own, so its phrases recur; rows
without id are kept and told apart by their text; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import hashed, run_hashes, text_buffer, word_bounds, word_codes
from ._shared import BUCKET_BYTES, grown, in_buckets, n_tasks, text_bytes

WORDS = 35
#: Neighbouring phrases under one pattern: their common core has WORDS + 1 less this many words.
TOGETHER = 18
#: Words that one automaton's patterns cover at most, so that each distinct word gets a character of its own.
SHARD_WORDS = 1_000_000
#: Bytes of text whose phrase hashes one range confirms on average.
RANGE_BYTES = 16 << 20


@dataclass
class Phrases:
    """A bucket's texts: a number for each word, distinct words, words before each text, places where a phrase starts."""

    codes: np.ndarray
    words: list[bytes]
    before: np.ndarray
    at: np.ndarray
    size: int

    def hashes(self, seed: int) -> np.ndarray:
        """A hash of each phrase, from the XXH64 of its words."""
        if not len(self.codes):
            return np.zeros(0, dtype=np.uint64)
        return run_hashes(hashed(self.words, seed)[self.codes], self.size)[self.at]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the phrases at places a and b have the same words."""
        equal = np.ones(len(a), dtype=bool)
        for j in range(self.size):
            equal &= self.codes[a + j] == self.codes[b + j]
        return equal

    def first(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first place, whether it stands here again) of each distinct phrase, in order of hash. Equal hashes are
        compared word by word."""
        order = np.argsort(h, kind="stable")
        s, places = h[order], self.at[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=bool)
        again = np.flatnonzero(~new)
        differ = again[~self.same(places[again - 1], places[again])]
        twice = np.append(~new[1:], False)[new] if len(s) else new
        s, places = s[new], places[new]
        if len(differ):
            shared = h[order][differ]
            odd, each, place = np.isin(s, shared), Counter(), {}
            mine = np.isin(h, shared)
            for x, i in zip(h[mine].tolist(), self.at[mine].tolist()):
                key = (x, self.codes[i : i + self.size].tobytes())
                each[key] += 1
                place.setdefault(key, i)
            s = np.concatenate([s[~odd], np.array([k[0] for k in each], dtype=np.uint64)])
            places = np.concatenate([places[~odd], np.array(list(place.values()), dtype=np.int64)])
            twice = np.concatenate([twice[~odd], np.array([n > 1 for n in each.values()], dtype=bool)])
            order = np.argsort(s, kind="stable")
            s, places, twice = s[order], places[order], twice[order]
        return s, places, twice


def read(texts: pa.ChunkedArray, k: int) -> Phrases:
    buf, off = text_buffer(texts)
    starts, ends, before = word_bounds(buf, off)
    codes, words = word_codes(buf, starts, ends)
    own = np.repeat(np.arange(len(before) - 1), np.diff(before))
    at = np.flatnonzero(own[: len(codes) - k + 1] == own[k - 1 :]) if len(codes) >= k else np.zeros(0, np.int64)
    return Phrases(codes, words, before, at, k)


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    """The range of each hash: sorted hashes have rising ranges."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _in_sorted(h: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(h), dtype=bool)
    return found[np.minimum(np.searchsorted(found, h), len(found) - 1)] == h


BLOCK = "bucket int, range int, hashes binary"


def _blocks(bucket: int, h: np.ndarray, n_ranges: int) -> pa.Table:
    """Blocks of sorted, distinct hashes, 8 bytes each, one for each range."""
    at = _ranges(h, n_ranges)
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(h) else np.zeros(0, np.int64)
    blocks = [x.tobytes() for x in np.split(h, cuts[1:])] if len(h) else []
    return pa.table({"bucket": pa.array([bucket] * len(blocks), pa.int32()), "range": pa.array(at[cuts], pa.int32()), "hashes": pa.array(blocks, pa.binary())})


def send(n_ranges: int, k: int):
    """Of a bucket's documents to its blocks of phrase hashes."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        return _blocks(key[0].as_py(), np.unique(read(docs["text"], k).hashes(0)), n_ranges)

    return run


def _returned(rows: pa.Table) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(rows["hashes"].to_pylist()), dtype=np.uint64))


def send_again(n_ranges: int, k: int):
    """Of a bucket's documents and the hashes returned to it to blocks of the second hashes of these phrases."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, returned: pa.Table) -> pa.Table:
        elsewhere = _returned(returned)
        if not len(docs) or not len(elsewhere):
            return _blocks(0, np.zeros(0, np.uint64), n_ranges)
        phrases = read(docs["text"], k)
        known = _in_sorted(phrases.hashes(0), elsewhere)
        return _blocks(docs["bucket"][0].as_py(), np.unique(phrases.hashes(1)[known]), n_ranges)

    return run


def confirm(others: bool):
    """Of a range's blocks to the hashes of each block that another block has too; or, for others, of those that none has."""

    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        return _confirmed(blocks, others)

    return run


def _confirmed(blocks: pa.Table, others: bool) -> pa.Table:
    raw = blocks["hashes"].to_pylist()
    sizes = np.array([len(x) // 8 for x in raw])
    h = np.frombuffer(b"".join(raw), dtype=np.uint64)
    s = np.sort(h)
    again = s[1:][s[1:] == s[:-1]]
    flags = _in_sorted(h, again) != others
    ends = np.cumsum(sizes)
    found = [h[e - n : e][flags[e - n : e]].tobytes() for e, n in zip(ends, sizes)]
    keep = [i for i, x in enumerate(found) if x]
    return pa.table({"bucket": blocks["bucket"].combine_chunks().take(pa.array(keep, pa.int64())), "hashes": pa.array([found[i] for i in keep], pa.binary())})


def recurring_words(codes: np.ndarray, before: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """For each word of a bucket whether a recurring phrase covers it. codes: a number for each word; first: sorted places
    where each distinct recurring phrase starts first; automata find all its occurrences."""
    import ahocorasick

    n, docs = len(codes), len(before) - 1
    covered = np.zeros(n + 1, dtype=np.int64)
    own = np.repeat(np.arange(docs), np.diff(before))
    # Shards by the words that phrases cover: one that overlaps the phrase before it adds only what is new.
    added = np.minimum(np.diff(first, prepend=first[0] - k), k)
    shards = np.cumsum(added) // SHARD_WORDS
    for places in np.split(first, np.flatnonzero(np.diff(shards)) + 1):
        inside = np.zeros(n + 1, dtype=np.int64)
        np.add.at(inside, places, 1)
        np.add.at(inside, places + k, -1)
        vocabulary = np.unique(codes[np.cumsum(inside)[:-1] > 0])
        # One character for each word of the vocabulary, one for all others, and one between documents.
        letters = np.ones(int(codes.max()) + 1, dtype=np.uint32)
        letters[vocabulary] = np.arange(3, len(vocabulary) + 3)
        letter = letters[codes]
        letter[letter >= 0xD800] += 0x800
        spread = np.full(n + docs, 2, dtype=np.uint32)
        spread[np.arange(n) + own] = letter
        text = spread.astype("<u4").tobytes().decode("utf-32-le")
        places = (places + own[places]).tolist()
        phrases = {text[i : i + k] for i in places}
        automaton = ahocorasick.Automaton()
        run = 0
        while run < len(places):
            to = run + 1
            while to < len(places) and to - run < TOGETHER and places[to] == places[to - 1] + 1:
                to += 1
            core = text[places[to - 1] : places[run] + k]
            automaton.add_word(core, len(core))
            run = to
        automaton.make_automaton()
        hit = bytearray(len(text))
        # A phrase has vocabulary words only, so stretches of fewer than k of these hold none.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], spread >= 3, [False]])))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a < k:
                continue
            for end, size in automaton.iter(text, a, b):
                for i in range(max(a, end + 1 - k), end + 2 - size):
                    if not hit[i] and text[i : i + k] in phrases:
                        hit[i] = 1
        hits = np.flatnonzero(np.frombuffer(hit, dtype=np.uint8))
        hits -= np.searchsorted(before[1:] + np.arange(docs), hits, side="right")
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + k, -1)
    return np.cumsum(covered)[:-1] > 0


OUT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def remove(k: int):
    """Of a bucket's documents and the hashes returned to it to the documents without recurring phrases."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, returned: pa.Table) -> pa.Table:
        phrases = read(docs["text"], k)
        before, codes = phrases.before, phrases.codes
        kind = returned["kind"].to_numpy() if len(returned) else np.zeros(0, np.int32)
        elsewhere, alone = (_returned(returned.filter(pa.array(kind == i))) for i in (0, 1))
        h, places, twice = phrases.first(phrases.hashes(0))
        there = _in_sorted(h, elsewhere)
        if len(alone):
            second = np.zeros(len(codes), dtype=np.uint64)
            second[phrases.at] = phrases.hashes(1)
            there &= ~_in_sorted(second[places], alone)
        first = np.sort(places[twice | there])
        gone = recurring_words(codes, before, first, k) if len(first) else np.zeros(len(codes), dtype=bool)
        texts, kept, removed, n_removed = docs["text"].to_pylist(), [], [], []
        for d, text in enumerate(texts):
            words, out = (text or "").encode().split(), gone[before[d] : before[d + 1]]
            n = int(out.sum())
            n_removed.append(n)
            if n:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                removed.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                words = [words[i] for i in np.flatnonzero(~out)]
            else:
                removed.append([])
            kept.append(b" ".join(words).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "n_words": pa.array(np.diff(before), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()), "removed": pa.array(removed, span)})

    return run


def remove_repeats(docs: DataFrame, words: int = WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by blanks), removed (spans of words) for each row of docs."""
    total = text_bytes(docs)
    bucket_bytes = grown(bucket_bytes, total, 64 << 20)
    dealt = in_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), total, "doc_id", "text", bucket_bytes=bucket_bytes)
    n_ranges, n = max(1, math.ceil(total / grown(RANGE_BYTES, total, 256 << 20))), n_tasks(docs.sparkSession, total)
    by_range = lambda blocks: blocks.repartition(min(n_ranges, n), "range").groupBy("range")
    blocks = dealt.groupBy("bucket").applyInArrow(send(n_ranges, words), BLOCK)
    returned = by_range(blocks).applyInArrow(confirm(False), "bucket int, hashes binary").repartition(n, "bucket")
    again = dealt.groupBy("bucket").cogroup(returned.groupBy("bucket")).applyInArrow(send_again(n_ranges, words), BLOCK)
    alone = by_range(again).applyInArrow(confirm(True), "bucket int, hashes binary").repartition(n, "bucket")
    # Both are dealt alike, so their union needs no exchange of its own, and that of returned serves twice.
    back = returned.withColumn("kind", F.lit(0)).unionByName(alone.withColumn("kind", F.lit(1)))
    return dealt.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(remove(words), OUT)
