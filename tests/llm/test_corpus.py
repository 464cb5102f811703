"""SimHash groups, decontamination, mixing and tokens against plain Python over whole texts."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash

from plumbgrid import lineage
from plumbgrid.llm import decontaminate, mixing, pfor, simhash, token_counts, token_files
from plumbgrid.llm.components import components
from plumbgrid.llm.tokenizing import VOCABULARY, Cuts, tokenizer

TEXTS = [None, "", " \n\t ", "one", "Two  words\there", "a b c d", "a b c d e", "x y z w é É", "the " * 5000, "<|endoftext|> a  <|endoftext|> b\n\n  c", "a  b   c \n d\r\n e 　f  ", "12 34 5,6 a-b 'll I'll  don't"]


@pytest.fixture(scope="module")
def real(spark, sf):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def docs(spark, real):
    rows = [(1000 + k, t, "s") for k, t in enumerate(TEXTS)] + [(4007, "a b c d", None), (4007, "a b c d", None), (None, "again and again and again", "é")]
    rows += [(2000 + k, t + " tail", "src0") for k, (_, t, _) in enumerate(real[:40])]
    return spark.createDataFrame([(*r, 5, "x") for r in rows + real], "doc_id long, text string, source string, h int, key string").repartition(5)


def plain(rows):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in rows), key=repr)


def reach(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = reach({n for e in edges for n in e}, edges)
    assert got == {n: expected[n] for e in edges if e[0] != e[1] for n in e}


def one_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = docs.collect()
    fps = {r.text: one_fingerprint(r.text) for r in rows}
    distinct = sorted(set(fps.values()))
    root = reach(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            k = root[fps[r.text]]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    expected = [(r.doc_id, f"{fps[r.text]:016x}", least.get(root[fps[r.text]])) for r in rows]
    assert plain(simhash.simhash_groups(docs).collect()) == plain(expected)


@pytest.mark.parametrize("most", [20, 4096])
def test_covering_finds_every_pair(spark, most):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(300)]
    fps = {b ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 7))) for b in base[:60] for _ in range(6)} | set(base)
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), most=most).collect()
    assert all((signed[x.a] ^ signed[x.b]).bit_count() <= 64 for x in links)
    got = reach(signed, [(x.a, x.b) for x in links])
    expected = reach(signed, [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 4])
    assert got == expected


def test_masks_cover():
    from itertools import combinations

    m = [x & (1 << 64) - 1 for x in simhash.masks(4)]
    r = random.Random(1)
    some = r.sample(list(combinations(range(64), 4)), 20_000)
    assert all(any(not any(x >> i & 1 for i in d) for x in m) for d in some)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block_bytes", [1 << 25, 1500])
def test_decontaminate(spark, sf, docs, block_bytes):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "words HERE"), (901, None), (902, "A-b!"), (903, "the " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    planted = spark.createDataFrame([(5000 + k, "pre " + t.upper() + " post", None, 1, "") for k, (_, t) in enumerate(items[:10])] + [(6000, " ".join(items[0][1].split()[:12]), None, 1, "")], docs.schema)
    docs = docs.union(planted)
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    expected = []
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        expected.append((r.doc_id, len(w), len(hit), sorted(found)))
    got = decontaminate.verbatim_matches(docs, bench, block_bytes=block_bytes, shard_words=3000)
    assert plain((r.doc, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == plain((*e[:3], tuple(e[3])) for e in expected)
    bad = {e[0] for e in expected if e[2] and 20 * e[2] >= e[1]}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {e[0] for e in expected} - bad and bad


def test_longest_matches(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x y " + item + " z"), (2, " ".join(f"w{k}" for k in range(3, 20)) + " q " + " ".join(f"w{k}" for k in range(12)))], "doc_id long, text string")
    got = decontaminate.verbatim_matches(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).orderBy("doc").collect()
    assert [[tuple(m) for m in r.matches] for r in got] == [[("i", 0, 2, 30)], [("i", 3, 0, 17)]]


def test_repeated_words_make_no_product(spark):
    """400 windows of one word over and over, against a text of 20,000 of it."""
    items = spark.createDataFrame([("a", "the " * 400), ("b", "the " * 13), ("c", "the of " * 200), (None, "x y z")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "the " * 20_000), (2, "of the " * 5000), (3, "the " * 12), (4, "x y z")], "doc_id long, text string")
    got = {r.doc: r for r in decontaminate.verbatim_matches(docs, items, shard_words=1 << 30).collect()}
    assert [tuple(m) for m in got[1].matches] == [("a", 0, 0, 20_000), ("b", 0, 0, 20_000)]
    assert [tuple(m) for m in got[2].matches] == [("c", 1, 0, 10_000)] and got[3].n_hit == 0
    assert got[4].n_hit == 3 and got[4]["items"] == [] and got[4].matches[0].item is None
    bench = decontaminate.Benchmark([("a", "the " * 400), ("b", "the " * 13), ("c", "the of " * 200)])
    ids = np.array([bench.vocabulary[b"the"]] * 500 + [0] + [bench.vocabulary[w] for w in (b"of", b"the")] * 30 + [0])
    assert all((a == b).all() for k in (1, 2, 7, 100) for a, b in zip(bench.matches(ids, k), bench.matches(ids), strict=True))


def test_odd_columns(spark):
    """Names that no DDL spells, nested columns and maps go through the row-keeping forms."""
    rows = [(1, "the words of it " * 9, "en", {"k": 1}, "u"), (2, None, "en", None, None), (1, "the words of it " * 9, "en", {}, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b map` map<string,int>, `source url` string")
    items = spark.createDataFrame([("i", "words of it the")], "item_id string, text string")
    for block_bytes in (1 << 20, 1):
        assert decontaminate.decontaminate(docs, items.union(items.selectExpr("'j'", "'no such'")), block_bytes=block_bytes).columns == docs.columns
    left = decontaminate.decontaminate(docs, items).collect()
    assert [r.doc_id for r in left] == [2]
    assert simhash.one_of_each_group(docs).count() == 2 and simhash.one_of_each_group(docs).columns == docs.columns
    mixed = mixing.mixed_texts(docs, source_col="source url")
    assert mixed.columns == docs.columns and mixed.count() > 0
    other = docs.withColumnsRenamed({"doc_id": "the id", "text": "a.text"})
    assert token_counts.token_counts(other, "the id", "a.text").columns == ["the id", "n_bytes", "n_tokens", "over_limit"]
    assert token_files.token_output(other, "the id", "a.text").count() == simhash.simhash_groups(other, "the id", "a.text").count() == mixing.mix(other, "the id", "a.text", "source url").count() == 3
    assert decontaminate.verbatim_matches(other, items, "the id", "a.text").count() == 3


def test_mix(spark, docs):
    got = mixing.mix(docs, bucket_rows=20).collect()
    again = mixing.mix(docs.repartition(3), bucket_rows=20).collect()
    assert plain(got) == plain(again)
    size = {}
    for r in docs.collect():
        n = len([x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x])
        size.setdefault(r.source, []).append((r.doc_id, n))
    total = sum(n for rows in size.values() for _, n in rows)
    assert plain((r.doc_id, r["size"]) for r in got) == plain(x for rows in size.values() for x in rows)
    goal = mixing.targets({s: sum(n for _, n in rows) for s, rows in size.items()})
    assert sum(goal.values()) == pytest.approx(1.5 * total)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(goal[s]) and all(r.taken <= 2 * r["size"] for r in mine)
        assert {(r.source_size, r.target) for r in mine} == {(sum(n for _, n in size[s]), goal[s])}
    texts = mixing.mixed_texts(docs, bucket_rows=20).collect()
    assert sum(len(r.text.split()) if r.doc_id != 1007 else 4 for r in texts) == pytest.approx(sum(r.taken for r in got), abs=8)


def targets_by_bisection(sizes):
    """The share of a unit of weight at which all targets, cut at twice their source, make up the whole."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    whole, lo, hi = 1.5 * sum(sizes.values()), 0.0, 2.0 * sum(sizes.values()) + 1
    for _ in range(200):
        unit = (lo + hi) / 2
        lo, hi = (unit, hi) if sum(min(2 * sizes[s], unit * weight[s]) for s in names) < whole else (lo, unit)
    return {s: min(2.0 * sizes[s], hi * weight[s]) for s in names}


def test_mix_by_hand(spark, docs):
    """Every row's `taken` from a plain walk along each source."""
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    size = lambda t: len([x for x in re.split(r"[\x20\x09-\x0D]+", t) if x])
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal, expected = targets_by_bisection(sizes), []
    for s in sizes:
        left = int(goal[s] + 1e-6)
        mine = [(hashlib.md5((t if i is None else f"{i}:{t}").encode()).hexdigest()[:8], i if i is not None else -1, size(t)) for i, t, o in rows if o == s]
        taken = [0] * len(mine)
        while left > 0:  # epoch after epoch
            for k, (_, _, n) in sorted(enumerate(mine), key=lambda x: x[1]):
                step = min(n, left)
                taken[k], left = taken[k] + step, left - step
        expected += [(i if i >= 0 else None, n, sizes[s], round(goal[s], 6), t) for (_, i, n), t in zip(mine, taken, strict=True)]
    for bucket_rows in (3, 2000):
        got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
        assert plain((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == plain(expected)


def test_targets():
    assert mixing.targets({"a": 10, "b": 100, "c": 100}) == pytest.approx({"a": 20, "b": 295 / 3, "c": 2 * 295 / 3})
    assert mixing.targets({"a": 0}) == {"a": 0} and mixing.targets({}) == {}


@pytest.mark.parametrize("kind", ["random", "small", "one", "outliers"])
def test_pfor_round_trip(kind):
    r = np.random.default_rng(2)
    for n in (0, 1, 63, 1024, 1025, 5000):
        ids = {"random": r.integers(0, 50_257, n), "small": r.integers(7, 10, n), "one": np.full(n, 9), "outliers": np.where(r.random(n) < 0.05, 2**32 - 1, r.integers(100, 140, n))}[kind].astype(np.uint32)
        assert (pfor.decode_blocks(b"".join(blocks := pfor.encode_blocks(ids)), np.cumsum([0, *map(len, blocks)])[:-1]) == ids).all()
        sink, cuts = io.BytesIO(), sorted(r.integers(0, n + 1, 4))
        w = pfor.Writer(sink, 2048)
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n])):
            w.add(k, ids[a:b])
        w.close(pa.int64())
        back = pfor.Reader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
        assert (back.ids(0, n) == ids).all() and back.names.to_pylist() == [0, 1, 2, 3, 4] and back.lengths.sum() == n
        assert (back.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    if kind == "outliers":
        assert sum(map(len, blocks)) < 5000 * 2


@pytest.fixture(scope="module")
def tok():
    with open(VOCABULARY, encoding="utf-8") as f:
        return tokenizer(f.read())


def test_token_counts(spark, docs, tok):
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()]
    assert plain(token_counts.token_counts(docs, batch_bytes=3000, piece_chars=100).collect()) == plain(expected)


def test_token_files(spark, docs, tok):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, expected = 0, []
    for r in rows:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert plain(token_files.token_output(docs).collect()) == plain(expected)


def test_long_texts_are_encoded_few_at_once(tok):
    """What a worker holds at once is bounded by bytes, not by a number of texts: 3,000 of 10 kB went 20 MB at a time."""

    class Watched(token_files.Encoder):
        most = 0

        def encode(self, texts):
            self.most = max(self.most, pa.compute.sum(pa.compute.binary_length(texts)).as_py())
            return super().encode(texts)

    enc, text = Watched(tok, ("<|endoftext|>",)), "words of one text " * 560
    texts = [f"{k} {text}" for k in range(3000)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"id": range(3002), "text": pa.array(texts, pa.string())})
    lengths = [(name, len(ids)) for name, ids in token_files.encoded(enc, [batch, batch.slice(0, 0)])]
    assert 0 < enc.most <= token_files.AT_ONCE + 11_000
    each = {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts) if k % 100 == 0 or k >= 3000}
    assert [name for name, _ in lengths] == list(range(3002)) and all(n == each.get(k, n) for k, n in lengths)


def test_manifest_needs_no_table(spark, docs, tmp_path):
    """Files are written once, by the call; their manifest is no table of one-row files in the shared folder."""
    made, folder = set(lineage._made), tmp_path / "tokens"
    manifest = token_files.write_token_files(docs, f"file://{folder}")
    assert set(lineage._made) == made
    written = {p.name: p.stat().st_mtime_ns for p in folder.iterdir()}
    rows = manifest.collect()
    assert {r.name for r in rows} == set(written) and sum(r.n_docs for r in rows) == docs.count() == token_files.read_token_files(manifest, f"file://{folder}").count()
    assert {p.name: p.stat().st_mtime_ns for p in folder.iterdir()} == written


def test_pieces(tok):
    r, cuts = random.Random(4), Cuts(tok)
    for k in range(300):
        text = "".join(r.choices("ab Z1.,'\n\t  é中" if k % 2 else "的人。，日本Aa0+/=é٣", k=80))
        if k % 3 == 0:
            text = text[:37] + "<|endoftext|>" + text[37:]
        assert "".join(parts := list(cuts.pieces(text, 5))) == text
        assert [i for p in parts for i in tok.encode(p, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids
        texts = [text, "", None, text[40:] + "<|endoftext|>", "plain words, and marks."]
        enc = token_files.Encoder(tok, ("<|endoftext|>",))
        expected = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [g.tolist() for g in enc.encode(pa.array(texts, pa.string()))] == expected
        assert enc.count(pa.array(texts, pa.string())).tolist() == list(map(len, expected))


@pytest.mark.parametrize("shown", [True, False])
def test_words_learned_in_lines(tok, monkeypatch, shown):
    """Words met again, with other marks or after the cache was cleared, by a vocabulary that shows spaces and by one that doesn't."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_files, "TOGETHER", 3)
    r, enc = random.Random(12), token_files.Encoder(tok, ("<|endoftext|>",))
    enc.begins &= shown
    words = ["".join(r.choices("abcdeéß中1'-\n", k=r.randint(1, 9))).strip() + r.choice(["", ".", ",", "!?", "'", ".a"]) for _ in range(120)]
    for _ in range(12):
        texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(6)] + ["...", " ", "?! ?!"]
        expected = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert [g.tolist() for g in enc.encode(pa.array(texts))] == expected
        assert enc.count(pa.array(texts)).tolist() == list(map(len, expected))


def test_texts_without_blanks_are_cut(spark, tok):
    r = random.Random(8)
    texts = ["".join(r.choices("的一是不了人我在有他这为之大来以个中上们", k=80_000)), "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=80_000)), "a" * 30_000, "中，" * 20_000]
    longest = [max(map(len, Cuts(tok).pieces(t, 1000))) for t in texts]
    assert longest[0] < 2000 and longest[1] < 2000 and longest[3] < 2000
    docs = spark.createDataFrame([(k, t + (" and words" * 3000 if k % 2 else "")) for k, t in enumerate(texts)], "doc_id long, text string")
    expected = [(r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids)) for r in docs.collect()]
    got = token_counts.token_counts(docs, batch_bytes=50_000, piece_chars=1000).select("doc_id", "n_tokens").collect()
    assert plain(got) == plain(expected)


def test_batches_by_bytes():
    for sizes in ([], [0, 0], [5, 1, 1, 100, 1, 1], list(range(50))):
        runs = list(token_counts.byte_batches(np.array(sizes, np.int64), 10))
        assert [k for a, b in runs for k in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a : b - 1]) < 10 for a, b in runs)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.simhash_groups(none).count() == mixing.mix(none).count() == token_counts.token_counts(none).count() == token_files.token_output(none).count() == 0
    assert decontaminate.verbatim_matches(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b", None)], none.schema)
    assert decontaminate.verbatim_matches(some, bench).first().n_hit == 0
