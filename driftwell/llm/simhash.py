"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint is the bitwise majority over the XXH64 (seed 42) of all 3-word shingles.
Distinct fingerprints link at two or fewer differing bits. Candidates come from keys:
64 bits fall into segments of 22, 21 and 21 bits. With two errors one segment has none,
and the one after it at most two. Decoding a 23-bit word and its 23 neighbours with the
perfect (23,12) Golay code gives one or six codeword indices, and words within two bits
share one. So the key (an exact segment, a codeword index of the next) misses no link.
Fingerprints that share a key are joined and verified. Keys that very many distinct
fingerprints share are not paired: there each fingerprint meets its links at the words
one bit away, of which any two links share one, and all that meet at a word are linked.
Components come from alternating large-star and small-star rounds.

``deduplicate`` can also link near copies: texts whose sets of five-word shingles (of ASCII
lower case) have a Jaccard index of 0.8 or more. Candidates share one of 32 bands of five
minima, which misses a pair at exactly 0.8 three times in a million; each candidate is
verified on the whole sets. Texts under a key that very many share are first paired in small
random blocks, other ones for each of their keys; then those that different components still
share are compared across components by prefix filtering, which misses none.

Defined cases: fewer than three words: the whole sequence is one shingle; no words or
null text: fingerprint zero, linked like any other; null ids count last for the smallest
id, and a component of null ids only has a null id; repeated rows share a component; an
empty table gives no rows; further columns are dropped by ``classes``, kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import nullcontext
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays
from ._shared import cut, cut_table, join_hot, small_batches, whole_row

SHINGLE_WORDS, SEED, MOST_BITS = 3, 42, 2
#: Offset and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23,12) Golay code.
GENERATOR = 0b110001110101
#: Distinct fingerprints under one key above which they meet at words one bit away instead of in pairs. Both ways are exact.
PAIRED_KEY = 32
#: Words of a shingle and Jaccard index from which texts are near copies; bands and minima in each.
NEAR_WORDS, NEAR_SHARE, BANDS, MINIMA = 5, 0.8, 32, 5
#: Texts in a block on average, where more than PAIRED_KEY share a band's key; in one of those that exact comparison deals them over.
BLOCK, COMPARED = 4, 256
#: Bytes of text whose shingles are made together.
SLICE = 1 << 20
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * MINIMA, 1), dtype=np.uint64)
_MULTIPLY |= np.uint64(1)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.zeros(len(words), dtype=np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    bounds = zip(starts[: len(words) - k + 1].tolist(), (starts + lens)[k - 1 :].tolist())
    h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in bounds], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, at (hash of the text, to tell rows of one id apart), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), dtype=np.uint64, count=len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["at"], pa.array(fps)], names=["doc_id", "at", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("at"), "text")
    return rows.mapInArrow(run, "doc_id long, at long, fp long")


@cache
def golay_index() -> np.ndarray:
    """For each 23-bit word the index of the codeword within three bits of it."""
    words = np.arange(4096, dtype=np.uint32)
    codes = np.zeros(4096, dtype=np.uint32)
    for bit in range(12):
        codes ^= np.where(words >> bit & 1, GENERATOR << bit, 0).astype(np.uint32)
    single = [1 << i for i in range(23)]
    errors = [0, *single]
    errors += [single[i] | single[j] for i in range(23) for j in range(i)]
    errors += [single[i] | single[j] | single[k] for i in range(23) for j in range(i) for k in range(j)]
    table = np.empty(1 << 23, dtype=np.int16)
    for e in errors:
        table[codes ^ np.uint32(e)] = words
    return table


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place in fps) for every key of unsigned fingerprints, each once."""
    table, keys, places = golay_index(), [], []
    ball = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    part = [(fps >> np.uint64(o) & np.uint64((1 << w) - 1)).astype(np.uint32) for o, w in SEGMENTS]
    for i in range(3):
        near = np.sort(table[part[(i + 1) % 3][:, None] ^ ball], axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        at, which = np.nonzero(new)
        keys.append((i << 40) | (part[i][at].astype(np.int64) << 12) | near[at, which].astype(np.int64))
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that give the components of all links; distinct: fp."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False)
            key, at = keys_of(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at])], names=["key", "fp"])

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = cut(keys.join(sizes, "key"))
    few = shared.where(F.col("n") <= PAIRED_KEY)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    many = shared.where(F.col("n") > PAIRED_KEY).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    meets = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    least = meets.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("word", "a")
    met = meets.join(least, "word").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for each node of an edge (a, b), with a < b."""
    spark = edges.sparkSession
    edges = cut(edges.select("a", "b"))
    if edges.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    print_ = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = print_(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y"))).where("x < y").distinct()
        edges = cut(small.select(F.col("x").alias("a"), F.col("y").alias("b")))
        now = print_(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct hashes, in rising order, of each text's five-word shingles; fewer words are one shingle, none give none."""
    buf, off = _arrays.text_buffer(texts)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends, before = _arrays.word_bounds(buf, off)
    words = _arrays.word_hashes(buf, starts, ends)
    runs = _arrays.run_hashes(words, NEAR_WORDS)
    own = lambda s, e: np.unique(runs[s : e - NEAR_WORDS + 1]) if e - s >= NEAR_WORDS else _arrays.run_hashes(words[s:e], e - s) if e > s else runs[:0]
    return [own(s, e) for s, e in zip(before[:-1].tolist(), before[1:].tolist())]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima."""
    least = np.full(BANDS * MINIMA, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 1 << 10):
        np.minimum(least, (shingles[at : at + (1 << 10)] * _MULTIPLY + _ADD).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        keys = _arrays.mix(keys + column)
    return keys


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes: the arrays made of them are many times as large."""
    sizes, lo, size = pc.binary_length(texts).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= SLICE or i + 1 == len(sizes):
            yield lo, i + 1
            lo, size = i + 1, 0


def _sets_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """at, shingles (their hashes in rising order, eight bytes each) of each distinct text whose hash is in asked."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch["text"]):
                sets = shingle_sets(batch["text"][lo:hi])
                yield pa.RecordBatch.from_arrays([batch["at"][lo:hi], pa.array([x.tobytes() for x in sets], pa.binary())], names=["at", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("at"), "text")
    return cut(texts.join(asked, "at", "left_semi").dropDuplicates(["at"]).mapInArrow(whole, "at long, shingles binary"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints for those pairs of texts that are near copies; pairs: a, b, fa, fb."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= NEAR_SHARE * max(len(x), len(y)) else 0
                near.append(both >= NEAR_SHARE * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    full = pairs.join(sets.select(F.col("at").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("at").alias("b"), F.col("shingles").alias("y")), "b")
    found = full.select(F.col("fa").alias("a"), F.col("fb").alias("b"), "x", "y").mapInArrow(verified, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts in different components, with their fingerprints fa and fb. Of others nothing more is to be learnt."""
    side = lambda c, fp, of: prints.select(F.col("at").alias(c), F.col("fp").alias(fp), F.col("component").alias(of))
    return cut(pairs.join(side("a", "fa", "ca"), "a").join(side("b", "fb", "cb"), "b").where("ca <> cb").drop("ca", "cb"))


def _mixed(keys: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows (key, at) of those keys whose texts lie in several components."""
    of = keys.join(prints.select("at", "component"), "at").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return keys.join(of.where("lo <> hi").select("key"), "key", "left_semi")


def near_links(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (a, b) between the fingerprints of texts that are near copies, without those that only crowded keys give; these
    keys (key, at), where they hold several components; and the shingles (at, shingles) of all texts compared or under
    such a key. prints: at, fp, component, a row for each text."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch["text"]):
                at = batch["at"][lo:hi].to_numpy()
                sets = shingle_sets(batch["text"][lo:hi])
                some = [i for i, x in enumerate(sets) if len(x)]
                keys = np.concatenate([np.zeros(0, np.uint64), *[band_keys(sets[i]) for i in some]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(at[some], BANDS))], names=["key", "at"])

    texts = docs.select(F.xxhash64("text").alias("at"), "text")
    keys = cut_table(texts.mapInArrow(keyed, "key long, at long").distinct())
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    block = F.when(F.col("n") > PAIRED_KEY, F.pmod(F.xxhash64("key", "at"), F.ceil(F.col("n") / BLOCK))).otherwise(0)
    blocks = keys.join(sizes, "key").groupBy("key", block.alias("block")).agg(F.collect_list("at").alias("ats"))
    each = F.flatten(F.transform("ats", lambda a: F.transform(F.filter("ats", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = blocks.where(F.size("ats") > 1).select(F.explode(each).alias("p")).select("p.a", "p.b").distinct()
    pairs = _apart(pairs, prints)
    crowded = keys.join(sizes.where(F.col("n") > PAIRED_KEY).select("key"), "key", "left_semi")
    crowded = cut_table(_mixed(crowded, prints))
    # Texts are shuffled once for both comparisons.
    asked = pairs.select(F.col("a").alias("at")).unionByName(pairs.select(F.col("b").alias("at"))).unionByName(crowded.select("at")).distinct()
    sets = _sets_of(docs, asked)
    return _verified(pairs, sets), crowded, sets


def crowded_links(prints: DataFrame, crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the fingerprints of all near copies that share a crowded key and lie in different components.

    Exact, by prefixes: in one order of all shingles, rare ones first, the first shingle that two near copies share is among
    the first fifth of either, and after it either has as many left as they must share. Texts that share such a shingle are
    compared across components: those of its largest component with the others, these with each other, in blocks.
    prints: at, fp, component, a row for each text; crowded: key, at; sets: at, shingles.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part["shingles"]]
                n = np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["at"].to_numpy(), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets))], names=["at", "size", "shingle"])

    asked = cut(_mixed(crowded, prints).select("at").distinct())
    if asked.isEmpty():
        return prints.sparkSession.createDataFrame([], "a long, b long")
    sets = cut(sets.join(asked, "at", "left_semi"))
    shingles = sets.mapInArrow(flat, "at long, size long, shingle long")
    # A shingle of one text gives no pair: it only takes a place before all others.
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("f")).where(F.col("f") > 1)
    ordered = shingles.join(counts, "shingle").groupBy("at", "size").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("s"))
    first = F.col("size") - F.ceil(F.col("size") * NEAR_SHARE - 1e-6) + 1 - (F.col("size") - F.size("s"))
    prefix = ordered.withColumn("first", first.cast("int")).where(F.col("first") > 0)
    prefix = prefix.select("at", "size", F.size("s").alias("common"), F.posexplode(F.slice("s", F.lit(1), F.col("first"))).alias("i", "s"))
    # What a text has from this shingle on, alone or shared.
    prefix = prefix.select("at", "size", (F.col("common") - F.col("i")).alias("left"), F.col("s.shingle").alias("shingle"))
    members = cut(prefix.join(prints.select("at", "component"), "at"))
    parts = members.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    groups = parts.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    groups = groups.where(F.col("parts") > 1).select("shingle", "main", F.ceil(F.col("n") / COMPARED).alias("blocks"))
    members = cut(members.join(groups, "shingle"))
    own = members.withColumn("block", F.pmod(F.xxhash64("at"), "blocks"))
    others = members.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x, y = own.alias("x"), others.alias("y")
    must = (F.col("x.size") + F.col("y.size")) * (NEAR_SHARE / (1 + NEAR_SHARE)) - 1e-6
    met = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
    once = (F.col("x.component") == F.col("x.main")) | (F.col("x.at") < F.col("y.at"))
    pairs = x.join(y, met & once & (F.least("x.left", "y.left") >= must)).select(F.col("x.at").alias("a"), F.col("y.at").alias("b")).distinct()
    return _verified(_apart(pairs, prints), sets)


def classes(docs: DataFrame, near: bool = False) -> DataFrame:
    """doc_id, at, fp, component (its root fingerprint), component_id (smallest doc_id) for each row of docs; near: whether near copies link too."""
    with small_batches(docs.sparkSession) if near else nullcontext():
        prints = cut(fingerprints(docs))
        distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
        edges = cut(links(distinct)) if near else links(distinct)
        roots = components(edges).withColumnRenamed("node", "fp")
        if near:
            texts = cut(prints.select("at", "fp").distinct())
            in_parts = lambda of: texts.join(of, "fp", "left").select("at", "fp", F.coalesce("root", "fp").alias("component"))
            close, crowded, sets = near_links(docs, cut(in_parts(roots)))
            edges = cut(edges.unionByName(close))
            roots = components(edges).withColumnRenamed("node", "fp")
            more = cut(crowded_links(cut(in_parts(roots)), crowded, sets))
            if not more.isEmpty():
                roots = components(edges.unionByName(more)).withColumnRenamed("node", "fp")
        own = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("component"))
        own = cut(own)
        ids = own.groupBy("component").agg(F.min("first").alias("component_id"))
        by_print = own.select("fp", "component").join(ids, "component")
    # A fingerprint may belong to a large part of all rows.
    return join_hot(prints, by_print, "fp").select("doc_id", "at", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, near: bool = False) -> DataFrame:
    """One row of docs for each component, the one with the smallest id; all columns as they are. near: as in classes."""
    kept = classes(docs, near).groupBy("component", "doc_id", "at").agg(F.count("*").alias("n"))
    kept = kept.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "n")).alias("k"))
    least = F.lit(-(1 << 63)).cast("long")
    kept = cut(kept.select(F.coalesce("k.doc_id", least).alias("id"), F.col("k.at").alias("at"), F.col("k.n").alias("n")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("id"), F.xxhash64("text").alias("at"), whole_row(docs))
    joined = rows.join(kept.hint("shuffle_hash"), ["id", "at"])
    once = joined.where(F.col("n") == 1).select("row.*")
    again = joined.where(F.col("n") > 1).dropDuplicates(["id", "at"]).select("row.*")
    return once.unionByName(again)
