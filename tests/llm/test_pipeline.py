"""The corpus pipeline on documents made for it, and its stages against plain versions."""

import pytest

import corpus_pipeline
from tests.conftest import SF
from wheeltrace.llm.common import table

PASSAGE = " ".join(f"passage{i % 7}word{i}" for i in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents and a few made ones: (id, what for)."""
    root = tmp_path_factory.mktemp("corpus")
    docs = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark")
    base = docs.orderBy("doc_id").first().text.replace("\n", " ")
    words = base.split()
    near = " ".join([*words[:30], "changed", *words[31:]])
    item = bench.orderBy("item_id").first().text
    made = [(10**6, "12345 --- 678"), (10**6 + 1, None), (10**6 + 2, f"{words[0]} {words[1]}\n{PASSAGE}"), (10**6 + 3, f"{words[2]} {words[3]} {words[4]}\n{PASSAGE}"),
            (10**6 + 4, base), (10**6 + 5, near), (10**6 + 6, f"{words[5]} {words[7]}: {item} {words[9]}")]
    extra = spark.createDataFrame([(i, t, None, "made", len(t or "")) for i, t in made], docs.schema)
    docs.unionByName(extra).write.parquet(f"{root}/documents.parquet")
    bench.write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs, seen = table(spark, folder, "documents"), {}
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/after_{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            assert docs.where("text is not null and n_chars <> length(text)").count() == 0
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    made = 10**6
    assert made not in seen["language_id"] and made + 1 not in seen["language_id"]
    assert len(seen["language_id"]) >= n - 2 - 1  # at most one clean document is lost
    assert PASSAGE in seen["line_dedup"][made + 2] and PASSAGE not in seen["line_dedup"][made + 3]
    assert len(seen["line_dedup"]) == len(seen["language_id"])
    assert made + 5 not in seen["near_duplicates"] and made + 2 in seen["near_duplicates"]
    assert made + 6 in seen["near_duplicates"] and made + 6 not in seen["decontamination"]
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(seen["decontamination"])


def test_run_equals_the_stages(spark, folder):
    want = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in spark.read.parquet(f"{folder}/after_packing").collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
