"""The pipeline's stages against brute-force versions on the smallest tables."""

import pytest

pytest.importorskip("tessera.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import pieces, quality, simhash  # noqa: E402
from tessera.llm.common import materialize, prepare, read  # noqa: E402


def test_stages(spark, sf):
    prepare(spark)
    docs = read(spark, sf, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf))
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["quality"]
    scores = {r.id: r.score for r in quality.classify(before, read(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, s in scores.items() if s >= 0.5}
    before, after = seen["simhash"]
    found = simhash.near_duplicates(before).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in found}
    before, after = seen["repeats"]
    texts = {r.doc_id: r.text.encode() for r in before.collect()}
    windows = set()
    for r in after.orderBy("doc_id").collect():
        b = texts[r.doc_id]
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in windows:
                gone[p : p + 100] = b"\1" * 100
            windows.add(b[p : p + 100])
        assert r.text == bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") and r.n_chars == len(r.text)
    before, after = seen["mix"]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    model = pieces.Model.load(pieces.MODEL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(last) == len(texts) and all(r.exact for r in last)
    for r in last[:20]:
        assert bytes(model.encode([texts[r.doc_id].encode()])[0]) == b"".join(int(i).to_bytes(4, "little") for i in r.ids)
