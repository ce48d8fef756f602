"""Packing by power-of-two decomposition.

A document's token ids (and the closing id) are cut into pieces whose lengths are
powers of two, the largest being the sequence length; each piece is a sequence of
its own, so no sequence crosses documents and nothing is padded. Equal lengths form
a bucket: sequence ids are dealt by bucket, so that those of one length stand together,
and ``write_buckets`` gives each bucket a folder from which a trainer draws batches of
one shape.

All ids come from the ``tokenizers`` library and the file it is given. A byte-level
tokenizer that cuts texts by the usual pattern never joins a character with a single blank
that follows it, nor a letter with a digit or a mark, so texts are taken apart there, and each
distinct piece is encoded once; with any other tokenizer, and for texts that
hold an added token's content, whole texts are encoded.

Row by row over the scan: no shuffle. Null text counts as empty and yields the
closing id alone; null or repeated ids keep one set of pieces for each row; further
columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import SPACE, text_buffer

SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, ids binary"
#: Encoded pieces beyond which a worker starts a new set and keeps the last one, from which it takes over what comes again.
#: Bounds memory, not results.
KEPT = 200_000
#: Bytes of text that are taken apart together, and strings that the tokenizer gets at once: what it returns takes a kilobyte for each.
SLICE, AT_ONCE = 2 << 20, 4096
#: Kinds of bytes: none of these, letter, digit, mark, apostrophe, control character, first byte of a character of two that is no white space.
_FIRST, _CONTROL, _PAIR = 1, 5, 6


def _kind(c: int) -> int:
    if c >= 0x80:
        return _PAIR if 0xC3 <= c <= 0xDF else 0
    if 0x20 < c < 0x7F:
        return 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if chr(c) == "'" else 3
    return 0 if c == 0x20 or 0x09 <= c <= 0x0D or 0x1C <= c <= 0x1F else _CONTROL


_KIND = np.array([_kind(c) for c in range(256)], dtype=np.int8)
#: Whether the pattern never joins a byte of kind a and a following one of kind b, at 8 a + b.
_APART = np.zeros(64, dtype=bool)
_APART[[8 * a + b for a, b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (4, 2))]] = True


class Ids:
    """Ids (little-endian uint32 bytes) of texts by the tokenizer in a file."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            raw = json.load(f)
        cuts = raw.get("pre_tokenizer") or {}
        self.apart = cuts.get("type") == "ByteLevel" and not cuts.get("add_prefix_space") and cuts.get("use_regex", True) and not raw.get("normalizer") and not raw["model"].get("dropout")
        added = [t["content"] for t in raw.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.kept: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        parts = (texts[at : at + AT_ONCE] for at in range(0, len(texts), AT_ONCE))
        return [array("I", e.ids).tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, taken apart before each single blank between two characters that are no white space, and between
        an ASCII letter, digit and mark, save after an apostrophe, which the pattern may join with a letter."""
        buf, off = text_buffer(pa.array(texts, pa.large_string()))
        # Other white space than ASCII's takes three bytes or starts with 0xC2; characters of two bytes from 0xC3 on are none.
        kind = _KIND[buf]
        starts = (kind >= _FIRST) & (kind <= _PAIR)
        ends = (kind >= _FIRST) & (kind < _PAIR)
        ends[1:] |= kind[:-1] == _PAIR
        cut = np.zeros(len(buf), dtype=bool)
        cut[1:-1] = (buf[1:-1] == 0x20) & ends[:-2] & starts[2:]
        # Nor does the pattern join letters, digits and marks.
        cut[1:] |= _APART[kind[:-1].astype(np.int8) * 8 + kind[1:]]
        cut[off[:-1][off[:-1] < len(buf)]] = True
        # A document's first piece starts with it, and one of no text has none.
        starts = np.flatnonzero(cut)
        if not len(starts):
            return [b""] * len(texts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.kept) > KEPT:
            self.before, self.kept = self.kept, {}
        new = [x for x in distinct if x not in self.kept]
        if self.before:
            self.kept.update((x, self.before[x]) for x in new if x in self.before)
            new = [x for x in new if x not in self.before]
        self.kept.update(zip(new, self.whole([x.decode() for x in new])))
        ids = [self.kept[x] for x in distinct]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        which = pieces.indices.to_numpy()
        own, flat, at = sizes[which], np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
        ends = np.cumsum(own)
        out = flat[np.repeat(at[which] - (ends - own), own) + np.arange(ends[-1])]
        bounds = np.append(0, ends)[np.searchsorted(starts, off)]
        return [out[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]

    def of(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return self.whole(texts)
        plain = [self.added is None or not self.added.search(t) for t in texts]
        apart = iter(self._pieces([t for t, p in zip(texts, plain) if p]))
        whole = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        return [next(apart if p else whole) for p in plain]


@cache
def _ids(tokenizer_path: str) -> Ids:
    """One for all tasks of a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(tokenizer_path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i + 1 == len(texts):
            yield lo, i + 1
            lo, size = i + 1, 0


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to n, none above longest, in falling order."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, sequence_tokens: int = 1024, closing_id: int = 0) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, bucket (log2 of length), ids (little-endian uint32),
    sequence_id and offset (always 0: a piece fills its sequence)."""
    if sequence_tokens < 1 or sequence_tokens & (sequence_tokens - 1):
        raise ValueError("sequence_tokens must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, closing = _ids(tokenizer_path), np.array([closing_id], dtype="<u4").tobytes()
        for batch in batches:
            texts, docs_of = [x or "" for x in batch["text"].to_pylist()], batch["doc_id"].to_pylist()
            for lo, hi in _slices(texts):
                rows: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(docs_of[lo:hi], ids_of.of(texts[lo:hi])):
                    ids += closing
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, sequence_tokens):
                        for column, x in zip(rows, (doc, start, length, n, length.bit_length() - 1, ids[4 * start : 4 * (start + length)])):
                            column.append(x)
                        start += length
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids"])

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    # The bucket in the highest bits: all sequences of one length stand together in the order of their ids.
    number = F.col("bucket").cast("long") * F.lit(1 << 58) + F.monotonically_increasing_id()
    return pieces.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet with a folder for each bucket: all sequences of a folder have one length, so any of them make a batch."""
    pieces.write.partitionBy("bucket").parquet(path)
