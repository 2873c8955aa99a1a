"""The pipeline on planted cases, each stage against brute force on its own input."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from turfline.llm import packing
from turfline.llm.shingles import shingle_set
from turfline.llm.text_stats import text_stats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n=80: " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(3, 8))) for _ in range(n))
    docs, labels, kinds = [], [], {}

    def add(text, kind, toxic=0):
        i = len(docs)
        docs.append((i, text, "en", f"s{i % 3}", len(text or "")))
        labels.append((i, 1, toxic))
        kinds[i] = kind

    for _ in range(150):
        add(prose(), "clean")
    for _ in range(60):
        words = prose().split()
        words[rng.randrange(80)] = rng.choice(["vileword", "gruntfool"])
        add(" ".join(words), "toxic", 1)
    for _ in range(20):
        add(" ".join(w + "###" for w in prose().split()), "junk")
    add(None, "junk")
    add(prose(10), "junk")
    base = prose(120).split()
    for _ in range(12):
        copy = list(base)
        copy[rng.randrange(120)] = "edited"
        add(" ".join(copy), "near")
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{root}/labels.parquet")
    return f"file://{root}", kinds


def test_stages_in_order(spark, planted):
    sf_dir, kinds = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = step(spark, docs, sf_dir).cache()
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS
    kept = {r.doc_id for r in seen["quality"][1]}
    assert kept == {i for i, k in kinds.items() if k != "junk"}
    assert all(text_stats(r.text)[0] >= 50 for r in seen["quality"][1])
    civil = {r.doc_id for r in seen["toxicity"][1]}
    assert {i for i, k in kinds.items() if k in ("clean", "near")} <= civil
    assert len([i for i in civil if kinds[i] == "toxic"]) <= 2
    single = {r.doc_id for r in seen["near_duplicates"][1]}
    sets = {r.doc_id: set(shingle_set(r.text).tolist()) for r in seen["near_duplicates"][0]}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert single == {i for i in sets if not any(j < i and linked(i, j) for j in sets)}
    mixed = Counter(r.doc_id for r in seen["mixing"][1])
    assert set(mixed) <= single and max(mixed.values()) <= 4
    ids_of = packing.word_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).ids
    want = Counter()
    for r in seen["mixing"][1]:
        ids = ids_of(r.text) + np.array([1], "<u4").tobytes()
        for s in range(0, len(ids), 8192):
            want[(r.doc_id, s // 4, zlib.crc32(ids[s : s + 8192]))] += 1
    assert Counter((p.doc_id, p.start, p.ids_crc32) for p in seen["packing"][1]) == want
    run = Counter((p.doc_id, p.start, p.ids_crc32) for p in corpus_pipeline.run(spark, sf_dir).collect())
    assert run == want


def test_awkward_and_empty_documents_pass_all_stages(spark, tmp_path):
    """Null ids, texts, languages and sources, repeated rows and a blank label table; then no rows at all."""
    prose = " ".join(f"wort{(i * 37) % 101}x{i}" for i in range(90))
    rows = [(None, prose, None, None, 1), (None, prose, None, None, 1), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, prose + " tail", None, "a", 9), (3, prose + " tail", None, "a", 9), (4, " ".join(f"q{i}" for i in range(400)), "en", "b", 7)]
    for name, some in (("few", rows), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert {p.doc_id for p in pieces} <= {None, 3, 4} and bool(pieces) == bool(some)
