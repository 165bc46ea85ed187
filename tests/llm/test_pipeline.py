"""The pipeline's stages against brute force on what each one was given."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_operators import check_packing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline
    from tokenloom.session import materialise

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "packing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialise(stage(spark, docs, SF), name)
        after = docs.collect()
        ids = {r.doc_id for r in after}
        seen[name] = len(ids)
        if name != "packing":
            assert docs.columns == start.columns
        if name == "quality":
            judged = [(labels[d], d in ids) for d, _ in before if d in labels]
            assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
        elif name == "near_duplicates":
            groups = brute.op6(before, 5, 80)
            assert ids == {g for _, n, g in groups if n} | {d for d, n, _ in groups if not n}
        elif name == "decontaminate":
            assert ids == {r[0] for r in brute.op10(before, items) if not r[5]}
        elif name == "secrets":
            texts = dict(before)
            assert ids == set(texts)
            for r in after:
                spans = brute.op2_base(texts[r.doc_id])
                assert not brute.op2_base(r.text) and ("[secret]" in (r.text or "")) >= bool(spans) and r.n_chars == len(r.text)
        else:
            used, least = check_packing(after, before)
            assert used <= least + 2
    assert seen["packing"] == seen["secrets"] <= seen["decontaminate"] <= seen["near_duplicates"] <= seen["quality"]


def test_run(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
