"""Each stage of the pipeline against plain Python on its own input, at sf0.001."""

import zlib

import corpus_pipeline
import numpy as np
import pytest

from plumbgrid.llm import mixing
from plumbgrid.llm.tokenizing import VOCABULARY, tokenizer

from .test_corpus import one_fingerprint, plain, reach, words


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "12 34", "en", None, 5), (None, "the and of it was there", None, "src1", 3), (10_003, "", None, "src1", 0)], docs.schema)
    docs, out = docs.union(odd), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(steps):
    assert all(after.columns == before.columns for before, after in steps[:-1])


def test_language(steps):
    before, after = (x.collect() for x in steps[0])
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {10_001, 10_002, 10_003}
    assert len(before) == len(after) + 3


def test_near_duplicates(steps):
    before, after = (x.collect() for x in steps[1])
    fps = {r.doc_id: one_fingerprint(r.text) for r in before}
    distinct = sorted(set(fps.values()))
    root = reach(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in fps.items():
        least[root[f]] = min((x for x in (least.get(root[f], i), i)), key=lambda x: (x is not None, x))
    assert plain(map(tuple, after)) == plain(tuple(r) for r in before if least[root[fps[r.doc_id]]] == r.doc_id)
    assert len(after) < len(before)


def test_decontamination(spark, sf, steps):
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    before, after = (x.collect() for x in steps[2])
    kept = []
    for r in before:
        w, hit = words(r.text), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(tuple(r))
    assert plain(map(tuple, after)) == plain(kept) and len(kept) < len(before)


def test_mixture(steps):
    before, after = (x.collect() for x in steps[3])
    sizes, got = {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in after:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert got == {s: int(t) for s, t in mixing.targets(sizes).items()}
    texts = {r.text for r in before}
    assert sum(r.text not in texts for r in after) <= len(sizes)


def test_tokens(steps):
    before, after = (x.collect() for x in steps[4])
    tok = tokenizer(open(VOCABULARY, encoding="utf-8").read())
    expected = [(r.doc_id, len(e := [*tok.encode(r.text, add_special_tokens=False).ids, 2]), zlib.crc32(np.array(e, "<u4").tobytes())) for r in before]
    assert plain((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == plain(expected)
    ends = sorted((r.start, r.start + r.n_tokens) for r in after)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0, name
        assert name == "tokens" or out.columns == docs.columns


def test_stages_keep_odd_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    docs = docs.selectExpr("*", "source AS `source url`", "map(lang, n_chars) AS `a.b`", "array(struct(lang AS `l l`)) AS row", "1 AS doc", "2 AS __n", "3 AS h", "'x' AS lang_pred", "0.5 AS score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0 and (name == "tokens" or out.schema.simpleString() == docs.schema.simpleString()), name


def test_run_leaves_only_what_its_result_reads(spark, sf):
    from plumbgrid import lineage

    lineage.release_all(spark)
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and {p.rsplit("/", 1)[1].split("-")[1] for p in lineage._made} <= {"mixture", "tokens", "manifest"}
    lineage.release_all(spark)
