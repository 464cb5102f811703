"""Language labels against brute-force marginals and held-out rows; embedding groups against all pairs."""

import itertools

import numpy as np
import pandas as pd
import pytest

from plumbgrid.llm import embeddings, langid


def test_marginals_are_exact():
    r = np.random.default_rng(1)
    moves = r.normal(size=(3, 3))
    lengths = np.array([1, 5, 2])
    e = r.normal(size=(8, 3)).astype(np.float32)
    got, at = langid.marginals(e, lengths, moves), 0
    for n in lengths:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            start = np.log(np.exp(moves).sum(0) / 3)[path[0]]
            w = np.exp(start + sum(e[at + t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for t, y in enumerate(path):
                total[t, y] += w
        assert got[at : at + n] == pytest.approx(total / total.sum(1, keepdims=True), abs=1e-5)
        at += n
    long = r.normal(size=(1000, 3)).astype(np.float32)
    blocks = langid.marginals(np.concatenate([long, e[:3]]), np.array([1000, 3]), moves)[:1000]
    assert blocks == pytest.approx(langid._expected(long[None].astype(float), moves)[0][0], abs=1e-4)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    model = langid.learned(documents)
    got = langid.label(documents, model).join(documents, "doc_id").where(langid.held_out("doc_id")).toPandas()
    assert len(got) > 250 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    mixed = " ".join(documents.where("lang = 'de'").first().text.split()[:30] + documents.where("lang = 'en'").first().text.split()[:30])
    odd = spark.createDataFrame([(1, mixed, "x"), (2, None, "x"), (3, "", None), (4, "12 ... 3", None), (None, "the and of", None), (1, "!", None), (5, "\n" + "the of " * 20_000, "")], "doc_id long, text string, score string")
    rows = langid.label(odd, model, runs=True).collect()
    assert [r.lang_pred for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.lang_pred))] == ["en", *[{"de", "en"}.intersection(r.lang_pred for r in rows if len(r.runs) > 1).pop()], "und", "und", "und", "und", "en"]
    runs = next(r.runs for r in rows if len(r.runs) > 1)
    assert {x.lang for x in runs} >= {"de", "en"} and sum(x.words for x in runs) == len(langid.words(mixed.encode()))


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learned(none) is None and langid.label(none, None).count() == 0
    some = spark.createDataFrame([(1, "a b", None)], none.schema)
    assert langid.label(some, langid.learned(some)).first().lang_pred == "und"


def groups(rows, cosine=0.9):
    n, up = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    fine = [v is not None and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if fine[i] and fine[j] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (np.array(rows[k][1], float) for k in (i, j))
            if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = [min(rows[j][0] for j in range(len(rows)) if top(j) == top(i)) for i in range(len(rows))]
    return sorted((rows[i][0], n[i], least[i], least[i] == rows[i][0]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [40, 8192])
def test_embedding_groups(spark, tile):
    r = np.random.default_rng(3)
    base = r.normal(size=(120, 16))
    vectors = np.concatenate([base, np.repeat(base[:20], 5, 0) + r.normal(size=(100, 16)) * 0.25, base[:5] * 3])
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [1.0, None] * 8), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, []), (509, [float("inf")] * 16)]
    table = spark.createDataFrame([(*x, 0, "") for x in rows], "vec_id long, embedding array<float>, label int, lead string")
    got = sorted(map(tuple, embeddings.embedding_groups(table, tile=tile).collect()))
    assert got == groups(rows)


@pytest.mark.parametrize("tile", [16, 64])
def test_dense_groups(spark, tile):
    """Hundreds of near copies, none equal, some at the limit, beside vectors alone: more than a tile of one class."""
    r = np.random.default_rng(9)
    one = r.normal(size=12)
    vectors = np.concatenate([one + r.normal(size=(300, 12)) * 0.15, one + r.normal(size=(60, 12)) * 0.4, r.normal(size=(100, 12)), np.eye(12), np.full((3, 12), 1.0)])
    rows = [(1000 - k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    got = sorted(map(tuple, embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=tile).collect()))
    assert got == groups(rows) and max(x[1] for x in got) > 250


def test_bounds_leave_only_pairs_beyond_the_share_out():
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = r.normal(size=(5, 16)) * 0.1 + r.normal(size=16) * 0.2, r.normal(size=(5, 16)) * 0.1
        x, y = embeddings.rotated(a), embeddings.rotated(b)
        near = embeddings.reachable(x.min(0), x.max(0), y.min(0), y.max(0), 0.9, 4)
        for k, ((lo, hi), share) in enumerate(zip(embeddings.splits(16, 4), embeddings.shares(16, 0.9, 4), strict=True)):
            if (((x[:, None, lo:hi] - y[None, :, lo:hi]) ** 2).sum(2) <= share).any():
                assert k in near


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.embedding_groups(spark.createDataFrame([], schema)).count() == 0
    got = embeddings.embedding_groups(spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], schema)).toPandas()
    assert got.n_links.tolist() == [1, 1] and got.component_id.tolist() == [1, 1] and pd.isna(got.vec_id).sum() == 1
