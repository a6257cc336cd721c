import random
import re
from collections import Counter

import corpus_pipeline
from helpers import documents, rows, words

from oddsmith.llm import linededup, quality, simhash
from oddsmith.llm.common import materialize

SF = "/root/testdata/sf0.001"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark):
    """Each stage held against a plainer account of its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    inputs = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        docs = materialize(stage(spark, docs, SF), f"t{i}")
        if i < 4:
            assert docs.columns == inputs[0].columns
    assert Counter(r.doc_id for r in quality.quality_verdicts(inputs[0], labels).where("kept").collect()) == Counter(r.doc_id for r in inputs[1].collect())
    verdicts = {r.doc_id: set(r.removed) for r in linededup.line_verdicts(inputs[1]).collect()}
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in verdicts[r.doc_id]) for r in inputs[1].collect()}
    assert {r.doc_id: r.text for r in inputs[2].collect()} == {d: t for d, t in want.items() if t.strip()}
    groups = simhash.near_duplicate_groups(inputs[2], shingle=5).collect()
    assert {r.doc_id for r in inputs[3].collect()} == {r.component_id for r in groups}
    total = sum(size(r.text) for r in inputs[3].collect())
    assert abs(sum(size(r.text) for r in inputs[4].collect()) - total) <= 20
    packed = docs.collect()
    assert sum(r.piece == 0 for r in packed) == inputs[4].count() and max(r.offset + r.length for r in packed) <= 4096


def test_run_bears_odd_rows(spark, tmp_path):
    """Null, empty and long texts, repeated rows and ids, columns with clashing names, no labels: through the whole chain."""
    rng = random.Random(9)
    good = [(200 + i, words(rng, 60), "en", "a", 1) for i in range(4)]
    documents(spark, rows() + good + [(200, words(rng, 50), "en", None, 1), (300, good[1][1] + " more", "en", "b", 1)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids >= {201, 202, 203} and not ids & {100, 101, 102, 106, 300}
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
