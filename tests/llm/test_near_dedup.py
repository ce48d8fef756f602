"""The pipeline's near_dedup against five-word shingles of all pairs."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from driftwell.llm import simhash  # noqa: E402


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def near_texts():
    """Some texts with copies in which one to nine words are changed, and short ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = ["one two", "One  two", "one", "", "word " * 40]
    for n in (30, 60, 120, 400, 3000):
        base = [word() for _ in range(n)]
        for changed in (0, 0, 1, 2, 4, 9):
            new = list(base)
            for i in rng.sample(range(n), changed):
                new[i] = word()
            texts.append(" ".join(new))
    return texts


@pytest.mark.parametrize("paired", [32, 2])
def test_near_copies_are_removed(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_KEY", paired)
    texts = near_texts()
    sets, fps = [shingles(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    up = list(range(len(texts)))
    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            bits = (fps[i] ^ fps[j]).bit_count()
            near = jaccard(sets[i], sets[j]) >= 0.8
            wide += near and bits > 2
            if near or bits <= 2:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert wide > 5
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x"), (None, texts[9], "x")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(up))


def test_near_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 0


def test_near_copies_in_a_crowd_are_removed(spark):
    """Texts around one template, of which only a few are near copies of each other: a band's key holds far more than PAIRED_KEY."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, near = [], []
    for _ in range(4):
        template = [word() for _ in range(300)]
        for own in (34, 34, *[60] * 200):
            texts.append(" ".join(template + [word() for _ in range(own)]))
        near.append((len(texts) - 202, len(texts) - 201))
    fps = [simhash.fingerprint(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or (j, i) in near:
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    sets = [shingles(t) for t in texts]
    assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in near)
    assert max(jaccard(sets[a], s) for a, b in near for i, s in enumerate(sets) if i not in (a, b)) < 0.8
    assert max(jaccard(sets[i], sets[i - 1]) for i in range(len(texts)) if i % 202 > 3) < 0.75
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(docs, near=True).collect()) == sorted(set(up))
