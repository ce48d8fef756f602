"""Language-model scores by a weighted backoff automaton.

The model is a trigram model over words and one end token, smoothed by interpolation:
P(w|uv) = a c(uvw)/c(uv) + (1 - a) P(w|v) where c(uv) is 2 or more, else P(w|v);
P(w|v) = b c(vw)/c(v) + (1 - b) P(w) where v was seen in training, else P(w);
P(w) = (1 - u) c(w)/N for known words and u for all others together, u being the share of
training tokens that occur once (Good-Turing). The weights a and b depend on the power of
two that the context's count reaches and are learnt from all training tokens by deleted
interpolation: the share of tokens that the longer context foretells better, each token
being taken out of the counts first.

As an automaton: a state for each context, an arc for each seen n-gram that carries its
whole probability, a failure arc to the next shorter context that carries 1 - a or 1 - b;
the root has an arc for each word. A text is read once from left to right from the state
of the end token; where the state has no arc for a word, failure arcs are followed until
one has; the arc leads to the longest context that is a state.

Documents are dealt over buckets of a few MB. Each bucket sends its distinct words (as
they are) and bigrams (hashed) with their counts in its training documents, packed into
one block for each range of hash values; each range sums them and returns to each bucket
the totals of what it sent. Trigrams whose first two words have a state follow in a second
round, the weights in a third. So each bucket compiles the part of the automaton that its
own documents can reach, and reads them through it. Nothing grows with the corpus on any
one machine; texts are shuffled once, since all uses read the same exchange.

Counts of words are exact. Of two different n-grams of two or three words one in about
twenty million shares its hash with another, at any size of input.

Defined cases: null and empty texts hold the end token alone; a null id is held out;
without training documents every token is unknown; repeated rows count each time; equal
forecasts vote for the shorter context; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import hashed, joined, text_buffer, word_bounds, word_codes
from ._shared import BUCKET_BYTES, grown, in_buckets, n_tasks, text_bytes

RANGE_BYTES = 16 << 20
#: Least count of a context of two words that makes a state.
STATE = 2
#: Powers of two that contexts' counts are told apart by.
BINS = 48
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The end token's name among words: no word holds a tab.
_END = b"\t"
WORDS, PAIRS, TRIPLES, MODEL = 0, 1, 2, 3


def hash_bits(total: int) -> int:
    """Bits of an n-gram's hash: 22 more than a number for each byte of text takes."""
    return min(62, max(total, 1 << 16).bit_length() + 22)


class Tokens:
    """A bucket's tokens: a number for each (0 is the end token), the distinct words, and where each text starts."""

    def __init__(self, docs: pa.Table, n_ranges: int, bits: int):
        buf, off = text_buffer(docs["text"])
        buf = _LOWER[buf]
        starts, ends, before = word_bounds(buf, off)
        codes, words = word_codes(buf, starts, ends)
        self.n_ranges, self.bits, self.words = n_ranges, bits, [_END, *words]
        self.ids = np.insert(codes + 1, before[1:], 0)
        self.bounds = before + np.arange(len(before))
        self.train = np.repeat(docs["train"].to_numpy().astype(bool), np.diff(self.bounds))
        self.hashes = hashed(self.words)
        self.last = np.concatenate([[0], self.ids[:-1]]).astype(np.int64)
        self.full = joined(self.hashes[self.last], self.hashes[self.ids])
        #: Whether a token has two tokens before it that can be its context: all but the first of each text.
        self.inner = np.ones(len(self.ids), dtype=bool)
        self.inner[self.bounds[:-1]] = False

    def pairs(self) -> np.ndarray:
        return self.full >> _U(64 - self.bits)

    def triples(self, at: np.ndarray) -> np.ndarray:
        return joined(self.full[at - 1], self.hashes[self.ids[at]]) >> _U(64 - self.bits)

    def ranges(self, h: np.ndarray, bits: int) -> np.ndarray:
        return ((h >> _U(bits - 32)) * _U(self.n_ranges) >> _U(32)).astype(np.int64)

    def word_blocks(self) -> list[tuple[int, np.ndarray]]:
        """(range, numbers of its words) in a set order: of the range, then of the word's hash."""
        order = np.argsort(self.hashes, kind="stable")
        at = self.ranges(self.hashes[order], 64)
        cuts = _distinct(at)
        return list(zip(at[cuts].tolist(), np.split(order, cuts[1:])))


def _distinct(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct entry, the number of its distinct entry for each), distinct entries in rising order."""
    order = np.argsort(x)
    first = _distinct(x[order])
    numbers = np.empty(len(x), dtype=np.int64)
    numbers[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
    return order[first], numbers


def _packed(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _planes(c: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, lowest first: the higher ones are mostly zeros, which compress away."""
    return _packed(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(raw), dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


BLOCK = "bucket int, range int, kind int, keys binary, counts binary"
_BLOCK = pa.schema([("bucket", pa.int32()), ("range", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _gram_blocks(bucket: int, tokens: Tokens, kind: int, h: np.ndarray, train: np.ndarray) -> list[dict]:
    """Blocks of distinct n-grams, sorted, as differences, with their counts in training documents."""
    s = np.sort(h << _U(1) | train.astype(_U))
    first = _distinct(s >> _U(1))
    h, counts = s[first] >> _U(1), np.add.reduceat((s & _U(1)).astype(np.int64), first) if len(s) else np.zeros(0, np.int64)
    at = tokens.ranges(h, tokens.bits)
    cuts = _distinct(at)
    return [{"bucket": bucket, "range": r, "kind": kind, "keys": _planes(np.diff(own, prepend=_U(0))), "counts": _planes(n)} for r, own, n in zip(at[cuts].tolist(), np.split(h, cuts[1:]), np.split(counts, cuts[1:]))] if len(h) else []


def send(n_ranges: int, bits: int):
    """Of a bucket's documents to blocks of its distinct words and bigrams with their counts in training documents."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        tokens, bucket = Tokens(docs, n_ranges, bits), key[0].as_py()
        counts = np.bincount(tokens.ids[tokens.train], minlength=len(tokens.words))
        rows = [{"bucket": bucket, "range": r, "kind": WORDS, "keys": _packed(b" ".join([tokens.words[i] for i in own.tolist()])), "counts": _planes(counts[own])} for r, own in tokens.word_blocks()]
        return pa.Table.from_pylist(rows + _gram_blocks(bucket, tokens, PAIRS, tokens.pairs(), tokens.train), _BLOCK)

    return run


def _sums(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the totals for each block's entries, the totals of distinct entries) of blocks of one kind."""
    if not rows:
        return [], np.zeros(0, np.int64)
    counts = [_numbers(r["counts"]) for r in rows]
    if rows[0]["kind"] == WORDS:
        keys = pa.array([w for r in rows for w in _unpacked(r["keys"]).split(b" ")], pa.binary()).dictionary_encode().indices.to_numpy()
    else:
        keys = np.unique(np.concatenate([np.cumsum(_numbers(r["keys"])) for r in rows]), return_inverse=True)[1]
    totals = np.zeros(int(keys.max()) + 1, dtype=np.int64)
    np.add.at(totals, keys, np.concatenate(counts))
    return np.split(totals[keys], np.cumsum([len(c) for c in counts])[:-1]), totals


BACK = "bucket int, range int, kind int, counts binary, numbers array<double>"
_BACK = pa.schema([("bucket", pa.int32()), ("range", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("numbers", pa.list_(pa.float64()))])


def give_back(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    every, out = blocks.to_pylist(), []
    for kind in (WORDS, PAIRS, TRIPLES):
        rows = [r for r in every if r["kind"] == kind]
        out += [{"bucket": r["bucket"], "range": r["range"], "kind": kind, "counts": _planes(own)} for r, own in zip(rows, _sums(rows)[0])]
    return pa.Table.from_pylist(out, _BACK)


def sizes(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
    """A range's training tokens, distinct ones, and those that occur once."""
    totals = _sums([r for r in blocks.to_pylist() if r["kind"] == WORDS])[1]
    return pa.table({"n": [int(totals.sum())], "v": [int((totals > 0).sum())], "once": [int((totals == 1).sum())]})


class Counts:
    """A bucket's tokens with the totals over all training documents that came back: of each distinct word, and of the
    bigram and trigram that end at each token (trigrams: nought where their context has no state)."""

    def __init__(self, docs: pa.Table, back: pa.Table, n_ranges: int, bits: int):
        rows = back.to_pylist()
        self.tokens = tokens = Tokens(docs, n_ranges, bits)
        own = lambda kind: {r["range"]: r["counts"] for r in rows if r["kind"] == kind}
        self.words = np.zeros(len(tokens.words), dtype=np.int64)
        got = own(WORDS)
        for r, which in tokens.word_blocks():
            self.words[which] = _numbers(got[r])
        self.pairs = self._grams(tokens.pairs(), own(PAIRS))
        self.context = np.where(tokens.inner, np.concatenate([[0], self.pairs[:-1]]), 0)
        self.asked = np.flatnonzero((self.context >= STATE) & (self.pairs > 0))
        self.triples = np.zeros(len(tokens.ids), dtype=np.int64)
        got = own(TRIPLES)
        if got:
            self.triples[self.asked] = self._grams(tokens.triples(self.asked), got)
        numbers = next((r["numbers"] for r in rows if r["kind"] == MODEL), None) or [0.0] * 3
        #: Training tokens, distinct ones, those that occur once; the weights of both contexts by bin, once they are learnt.
        self.model, self.weights = numbers[:3], np.array(numbers[3:]).reshape(-1, BINS)

    @staticmethod
    def _grams(h: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
        _, which = np.unique(h, return_inverse=True)
        return np.concatenate([np.zeros(0, np.int64), *[_numbers(got[r]) for r in sorted(got)]])[which]


def ask(n_ranges: int, bits: int):
    """Of a bucket's documents and their bigrams' totals to blocks of the trigrams whose context has a state."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.Table.from_pylist([], _BLOCK)
        c = Counts(docs, back, n_ranges, bits)
        return pa.Table.from_pylist(_gram_blocks(docs["bucket"][0].as_py(), c.tokens, TRIPLES, c.tokens.triples(c.asked), c.tokens.train[c.asked]), _BLOCK)

    return run


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], BINS - 1)


def votes(n_ranges: int, bits: int):
    """Of a bucket's training tokens: how many of each bin the context of two words or of one (order) foretells best, and how many there are."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, back: pa.Table) -> pa.Table:
        out: list[dict] = []
        if len(docs):
            c = Counts(docs, back, n_ranges, bits)
            t, n = c.tokens, c.model[0]
            own = np.flatnonzero(t.train)
            before = c.words[t.last[own]]
            one = (c.words[t.ids[own]] - 1) / max(n - 1, 1)
            two = np.where(before > 1, (c.pairs[own] - 1) / np.maximum(before - 1, 1), 0.0)
            three = np.where(c.context[own] >= STATE, (c.triples[own] - 1) / np.maximum(c.context[own] - 1, 1), 0.0)
            for order, counts, won in ((2, before, two > one), (3, c.context[own], three > np.maximum(two, one))):
                bins = _bin(counts)
                total, hits = np.bincount(bins, minlength=BINS), np.bincount(bins[won], minlength=BINS)
                out += [{"order": order, "bin": int(b), "won": int(hits[b]), "total": int(total[b])} for b in np.flatnonzero(total)]
        return pa.Table.from_pylist(out, pa.schema([("order", pa.int32()), ("bin", pa.int32()), ("won", pa.int64()), ("total", pa.int64())]))

    return run


#: Tokens of the documents that one automaton is compiled for, beyond which the next one begins. Bounds memory, not results.
TOGETHER = 10_000


class Automaton:
    """The states and arcs that the documents from token lo to token hi can reach. State 0 is the root; then one for each
    of their words; then one for each context of two words."""

    def __init__(self, c: Counts, lo: int, hi: int):
        every, part = c.tokens, slice(lo, hi)
        names, ids = np.unique(np.append(every.ids[part], 0), return_inverse=True)
        #: Tokens as numbers of this automaton's words; the end token, 0, is among them.
        self.ids = ids = ids[:-1]
        words, full, inner = c.words[names], every.full[part], every.inner[part]
        pairs, triples, context = c.pairs[part], c.triples[part], c.context[part]
        last = np.concatenate([[0], ids[:-1]])
        n, _, once = c.model
        weight = lambda order, counts: c.weights[order - 2][_bin(counts)]
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        unknown = (once + 1) / (n + 2)
        one = np.where(words > 0, (1 - unknown) * words / max(n, 1), unknown)
        self.width = size = len(names)
        # Contexts of two words, STATE times or more: before is where their second word stands.
        stated = inner & (context >= STATE)
        before = np.flatnonzero(stated) - 1
        place, number = _numbered(full[before])
        two_state = np.zeros(len(ids), dtype=np.int64)
        two_state[before] = 1 + size + number
        # The longest context that is a state, after each token. Words never seen in training lead to the root.
        word_state = np.where(words > 0, np.arange(1, size + 1), 0)
        after = np.where(two_state > 0, two_state, word_state[ids])
        self.start = int(word_state[0]) * size
        b, a = weight(2, words), weight(3, pairs[before[place]])
        self.fail_weight = np.concatenate([[0.0], log(1 - b), log(1 - a)]).tolist()
        self.fail = (np.concatenate([[0], np.zeros(size, np.int64), word_state[ids[before[place]]]]) * size).tolist()
        # Arcs of the root, of words and of contexts, by their places: an arc is the same at each, so any of them serves.
        roots = np.unique(ids)
        two = np.where(words[last] > 0, b[last] * pairs / np.maximum(words[last], 1) + (1 - b[last]) * one[ids], one[ids])
        pair_at = np.flatnonzero((pairs > 0) & (words[last] > 0))
        triple_at = np.flatnonzero(stated & (triples > 0))
        w = weight(3, context[triple_at])
        three = w * triples[triple_at] / context[triple_at] + (1 - w) * two[triple_at]
        arcs = np.concatenate([roots, word_state[last[pair_at]] * size + ids[pair_at], two_state[triple_at - 1] * size + ids[triple_at]])
        self.arcs = dict(zip(arcs.tolist(), range(len(arcs))))
        self.weights = log(np.concatenate([one[roots], two[pair_at], three])).tolist()
        #: States that arcs and failure arcs lead to, times the width: a word added gives the arc from there.
        self.next = (np.concatenate([word_state[roots], after[pair_at], after[triple_at]]) * size).tolist()

    def read(self, ids: list[int]) -> float:
        """The log10 probability of a text: one traversal from left to right."""
        arc_at, weights, following, fail, fail_weight, width = self.arcs.get, self.weights, self.next, self.fail, self.fail_weight, self.width
        state, total = self.start, 0.0
        for w in ids:
            arc = arc_at(state + w)
            while arc is None:
                number = state // width
                total += fail_weight[number]
                state = fail[number]
                arc = arc_at(state + w)
            total += weights[arc]
            state = following[arc]
        return total


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def read(n_ranges: int, bits: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{k: pa.array([], pa.int64()) for k in ("n_tokens", "n_known", "train_tokens")}, **{k: pa.array([], pa.float64()) for k in ("base_score", "score")}})
        c = Counts(docs, back, n_ranges, bits)
        t, (n, v, _) = c.tokens, c.model
        scores: list[float] = []
        runs = np.flatnonzero(np.diff(t.bounds[:-1] // TOGETHER, prepend=-1))
        for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(docs)]):
            bounds = t.bounds[a : b + 1]
            automaton = Automaton(c, int(bounds[0]), int(bounds[-1]))
            ids, at = automaton.ids.tolist(), (bounds - bounds[0]).tolist()
            scores += [automaton.read(ids[i:j]) for i, j in zip(at, at[1:])]
        total = lambda x: np.add.reduceat(x[t.ids], t.bounds[:-1])
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": pa.array(~docs["train"].to_numpy().astype(bool)), "n_tokens": pa.array(np.diff(t.bounds), pa.int64()), "n_known": pa.array(total((c.words > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array([int(n)] * len(docs), pa.int64()), "base_score": pa.array(total(np.log10((c.words + 0.1) / (n + 0.1 * (v + 1)))), pa.float64()), "score": pa.array(scores, pa.float64()),
        })

    return run


def score(docs: DataFrame, train: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score for each row of docs;
    train: whether a row is learnt from."""
    total = text_bytes(docs)
    bucket_bytes = grown(bucket_bytes, total, 64 << 20)
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    n_ranges, bits = max(1, math.ceil(total / grown(RANGE_BYTES, total, 256 << 20))), hash_bits(total)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    dealt = in_buckets(rows, total, "doc_id", "text", "train", bucket_bytes=bucket_bytes)
    n = n_tasks(docs.sparkSession, total)
    by_range = lambda blocks: blocks.repartition(min(n_ranges, n), "range").groupBy("range")
    with_docs = lambda back: dealt.groupBy("bucket").cogroup(back.groupBy("bucket"))
    blocks = dealt.groupBy("bucket").applyInArrow(send(n_ranges, bits), BLOCK)
    back = by_range(blocks).applyInArrow(give_back, BACK).repartition(n, "bucket")
    triples = by_range(with_docs(back).applyInArrow(ask(n_ranges, bits), BLOCK)).applyInArrow(give_back, BACK)
    whole = by_range(blocks).applyInArrow(sizes, "n long, v long, once long").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("n", "v", "once")])
    # One row for each bucket with the numbers that all need.
    each = F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))).alias("bucket")
    model = whole.select(each, F.lit(0).alias("range"), F.lit(MODEL).alias("kind"), F.lit(None).cast("binary").alias("counts"), F.array("n", "v", "once").alias("numbers"))
    # All three are dealt alike, so their union needs no exchange of its own, and that of back serves twice.
    known = back.unionByName(triples.repartition(n, "bucket")).unionByName(model.repartition(n, "bucket"))
    cells = with_docs(known).applyInArrow(votes(n_ranges, bits), "order int, bin int, won long, total long").groupBy("order", "bin").agg(((F.sum("won") + 1) / (F.sum("total") + 2)).alias("share"))
    shares = cells.agg(F.map_from_entries(F.collect_list(F.struct((F.col("order") - 2) * BINS + F.col("bin"), "share"))).alias("shares"))
    weights = shares.select(F.array(*[F.coalesce(F.try_element_at("shares", F.lit(i)), F.lit(0.0)) for i in range(2 * BINS)]).alias("weights"))
    learnt = known.crossJoin(F.broadcast(weights)).withColumn("numbers", F.when(F.col("kind") == MODEL, F.concat("numbers", "weights"))).drop("weights")
    return with_docs(learnt).applyInArrow(read(n_ranges, bits), OUT)
