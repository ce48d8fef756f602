import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from driftwell.llm import decontamination, langid, packing, secrets, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage on what its predecessor wrote; the last one's rows against token ids of the texts that are left."""
    import zlib

    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
            counts.append(docs.count())
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert len(ids) == counts[-1]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4]
    texts = {r.doc_id: r.text for r in before.collect()}
    ids = packing.Ids(corpus_pipeline.TOKENIZER)
    want = set()
    for d, t in texts.items():
        own = np.append(np.frombuffer(ids.of([t])[0], "<u4"), np.uint32(0)).astype("<u4")
        at = 0
        for n in packing.piece_lengths(len(own), 1024):
            want.add((d, at, n, zlib.crc32(own[at : at + n].tobytes()), len(own)))
            at += n
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs.collect()} == want
    assert secrets.scan(before)[0].where("size(spans) > 0").count() == 0
    assert decontamination.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    found = simhash.classes(before)
    assert found.count() - found.select("component").distinct().count() <= 2  # masks may bring texts together
    assert langid.keep_known(before).count() == before.count()
    assert {tuple(r[:5]) for r in corpus_pipeline.run(spark, SF).collect()} == want
