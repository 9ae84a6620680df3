"""The stages one after another against brute-force versions of each."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sparkveil.llm.queries import tokenizer
from tests.llm import test_decontaminate, test_lines_and_shards, test_quality_rules, test_setsketch


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {i: t for i, t in rows.items() if test_quality_rules.plain(t)[-1]}
    cut = {i: t for i, t in test_lines_and_shards.plain(list(good.items())).items() if t == good[i] or t.split()}
    groups = test_setsketch.plain(list(cut.items()), 5)
    alone = {i: t for i, t in cut.items() if groups[i][1] == i}
    wins = test_decontaminate.windows(bench)
    clean = {i: t for i, t in alone.items() if not test_decontaminate.plain(t, wins)[1]}
    assert len(rows) > len(good) > len(cut) > len(alone) > len(clean) > 0
    steps, now = [good, cut, alone, clean], docs
    for (_, stage), want in zip(corpus_pipeline.STAGES, steps):
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {i: (t, len(t)) for i, t in want.items()}
    library, ids = Tokenizer.from_file(tokenizer()), {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in clean.items()}


def test_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
