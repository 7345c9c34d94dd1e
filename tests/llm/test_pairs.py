"""Deduplication operators against brute force on small tables, with hot groups and edge cases."""

import hashlib
import random

import numpy as np
import pytest

from lotlens.llm import exact_dedup, queries
from lotlens.llm.components import connected_components
from lotlens.llm.exact_dedup import tree_exact_dedup
from lotlens.llm.gray import GrayIndex, gray_rank
from lotlens.llm.simhash import hamming_edges, jaccard, near_duplicate_edges, near_duplicates, shingle_hashes, simhash, simhash_components, simhash_fingerprints
from lotlens.llm.spotsigs import Signer, edited, likeness, repeated, spot_neighbours, spotsigs_components
from tests.conftest import DATA

DOCS = "doc_id long, text string, source string, keep_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "x") for i, t in texts], DOCS)


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def prose(rng, n):
    return " ".join(rng.choice(["the", "and", "of"]) if rng.random() < 0.3 else "w%d" % rng.randrange(3000) for _ in range(n))


def copies(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "w%d" % rng.randrange(3000)
    return " ".join(words)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    df = spark.createDataFrame([*links, (5, 5), (None, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    want = roots(300, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert connected_components(df.limit(0)).count() == 0


def test_exact_dedup(spark):
    texts = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "a"), (5, "a"), (6, "b"), (7, "B"), (None, "c"), (None, None), *[(100 + i, "hot") for i in range(60)]]
    for fan_in, levels in ((4, 1), (2, 3)):
        rows = tree_exact_dedup(docs(spark, texts), fan_in=fan_in, levels=levels).collect()
        assert len(rows) == len(texts)
        for r in rows:
            same = [i for i, t in texts if (t or "") == (r["text"] or "")]
            assert r["group_size"] == len(same) and r["keep_id"] == max((i for i in same if i is not None), default=None)
        kept = [(r["doc_id"], r["text"] or "") for r in rows if r["kept"]]
        assert sorted(kept, key=str) == sorted([(5, "a"), (4, ""), (6, "b"), (7, "B"), (None, "c"), (159, "hot")], key=str)
    least = {r["doc_id"] for r in tree_exact_dedup(docs(spark, texts), keep="min").collect() if r["kept"]}
    assert least == {1, 3, 6, 7, None, 100}
    assert tree_exact_dedup(docs(spark, [])).count() == 0


def test_sorted_runs_fold_across_batches():
    import pyarrow as pa

    rows = [(0, b"a", 1, 1, 9, 2), (0, b"a", 1, 1, 7, 1), (0, b"a", 1, 2, 5, 1), (0, b"b", 1, 1, None, 3), (0, b"b", 1, 1, None, 1), (4, b"b", 1, 1, 3, 1)]
    names = ["__run", *exact_dedup.KEY, "__best", "__n"]
    for size in (1, 2, 4, 6):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + size]], schema=pa.schema(list(zip(names, [pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)))) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in exact_dedup.fold(iter(batches)) for r in b.to_pylist()]
        assert got == [(0, b"a", 1, 1, 9, 3), (0, b"a", 1, 2, 5, 1), (0, b"b", 1, 1, None, 4), (4, b"b", 1, 1, 3, 1)]
    assert list(exact_dedup.fold(iter([]))) == []


def test_gray_order_is_a_gray_order():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(ordered, ordered[1:], strict=False))


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 12), (4, 40)])
def test_gray_index_finds_all_links(words, radius):
    rng = np.random.default_rng(words + radius)
    base = rng.integers(0, 1 << 63, (12, words), dtype=np.uint64)
    codes = base[rng.integers(0, 12, 400)]
    for _ in range(radius):
        at = rng.integers(0, words, 400)
        codes[np.arange(400), at] ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64) * (rng.random(400) < 0.4)
    run = np.sort(rng.integers(0, 5, 400))
    order = np.lexsort((gray_rank(codes), run))
    codes, run = codes[order], run[order]
    starts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), 400)
    index = GrayIndex(codes, starts)
    a, b, d = index.pairs(radius, np.arange(400), run - run.min() if len(set(run)) == 5 else np.unique(run, return_inverse=True)[1])
    want = {(i, j) for i in range(400) for j in range(i) if run[i] == run[j] and np.bitwise_count(codes[i] ^ codes[j]).sum() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    edges = index.tree_edges(radius, block=64)
    assert roots(400, edges[:, :2].tolist()) == roots(400, want) and len(edges) < 400


def test_shingles_and_fingerprints(spark):
    import xxhash

    assert shingle_hashes("A b\tC\x0bd", 3).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in ("a b c", "b c d")]
    assert shingle_hashes("É b", 3).tolist() == [xxhash.xxh64_intdigest("É b", 42)]
    assert simhash(shingle_hashes(None, 3)) == simhash(shingle_hashes(" \n", 3)) == 0
    h = shingle_hashes(" ".join(map(str, range(70001))), 3)
    assert simhash(h) == sum(1 << i for i in range(64) if int(((h >> np.uint64(i)) & np.uint64(1)).sum()) * 2 > len(h))
    d = docs(spark, [(1, "x y z"), (2, None)])
    assert [r[0] & (1 << 64) - 1 for r in d.orderBy("doc_id").select(simhash_fingerprints(d)).collect()] == [int(xxhash.xxh64_intdigest("x y z", 42)), 0]


@pytest.mark.parametrize("hot", [30, 4096])
def test_hamming_components(spark, hot):
    rng = random.Random(5)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64) if rng.random() < 0.7 else 0b111 << rng.randrange(60)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = hamming_edges(spark.createDataFrame(signed, "fp long"), hot=hot).collect()
    place = {s[0]: i for i, s in enumerate(signed)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert roots(len(fps), [(place[r["a"]], place[r["b"]]) for r in edges]) == roots(len(fps), links)


def test_simhash_components_edges(spark):
    rows = simhash_components(docs(spark, [(4, ""), (3, None), (9, "a b c"), (9, "a b c"), (8, "a b c"), (None, "q r s")])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted([(4, 3), (3, 3), (9, 8), (9, 8), (8, 8), (None, None)], key=str)
    assert simhash_components(docs(spark, [])).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(rng, 150)
        texts += [base, *(copies(rng, base, e) for e in (1, 2, 3, 8, 20))]
    texts += [prose(rng, 60) for _ in range(30)] + ["a b", "a b c", "", None]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = {i: r for i, r in enumerate(roots(len(texts), links)) if any(i in x for x in links)}
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, [*enumerate(texts), (None, texts[0])])).collect()}
    assert got == want


def test_near_duplicates_in_blocks(spark):
    rng = random.Random(12)
    base = prose(rng, 120)
    texts = [copies(rng, base, e % 5) for e in range(40)] + [prose(rng, 50) for _ in range(10)]
    texts = list(dict.fromkeys(texts))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    edges = [(r["a"], r["b"]) for r in near_duplicate_edges(docs(spark, list(enumerate(texts))), "doc_id", "text", hot=6).collect()]
    assert set(edges) <= set(links) and roots(len(texts), edges) == roots(len(texts), links)


def test_spot_neighbours(spark):
    rng = random.Random(2)
    texts = {i: prose(rng, rng.randrange(0, 200)) for i in range(0, 90, 3)} | {1: None, 2: "😀é" * 50, 4: " ", 7: "one"}
    texts |= {200: copies(rng, texts[60], 1), 201: texts[60], 300: texts[30] + " w1"}
    df = docs(spark, list(texts.items()))
    rows = {r["doc_id"]: r for r in spot_neighbours(df, components=spotsigs_components(df)).collect()}
    assert len(rows) == len(texts)
    order = sorted(texts, reverse=True)
    signer = Signer()
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, n = texts[i] or "", texts[j] or ""
        e, r = edited(t, n), rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
        assert r["fingerprint"] == "".join("%08x" % x for x in sorted(signer.signatures(t).tolist()))
        s, es, ns = (set(signer.signatures(x).tolist()) for x in (t, e, n))
        assert r["near_edited"] == pytest.approx(len(s & es) / len(s | es)) and r["near_next"] == pytest.approx(len(s & ns) / len(s | ns))
    ids = sorted(texts)
    sets = [signer.signatures(texts[i] or "") for i in ids]
    want = roots(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if likeness(sets[i], sets[j]) >= 0.8])
    assert [rows[i]["component_id"] for i in ids] == [ids[w] for w in want] and len(set(want)) < len(ids) - 1
    one = spot_neighbours(docs(spark, [(5, "the a b c of d e f")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    df = docs(spark, [(5, "x"), (5, "x"), (None, "x"), (9, "x")])
    same = spot_neighbours(df, components=spotsigs_components(df)).collect()
    assert len(same) == 4 and len({r["fingerprint"] for r in same}) == 1 and {r["component_id"] for r in same} == {5, None}
    assert spot_neighbours(docs(spark, [])).count() == 0


def test_signatures_change_little_with_one_chain_more():
    rng, signer = random.Random(9), Signer()
    for _ in range(20):
        words = [w for _ in range(60) for w in ("the", *("".join(rng.choice("bcdfgk") for _ in range(6)) for _ in range(4)))]
        sets = {n: signer.signatures(" ".join(words[: 5 * n])) for n in range(8, 60)}
        for n in range(8, 59):  # n chains, one of them the text's last words
            assert likeness(sets[n], sets[n + 1]) > 0.8
        at = {n: signer.signatures(" ".join(words[: 5 * n - 1])) for n in (11, 12, 13)}
        for n in at:  # a word less at the end
            assert likeness(at[n], sets[n]) > 0.9
        one = sets[11]
        assert likeness(one, signer.signatures(" ".join(words[:55] + ["the"] + words[55:60]))) > 0.8


def test_repeated_rows_across_batches():
    import pyarrow as pa

    rows = [(0, 1, 5), (0, 2, 6), (0, 2, 7), (0, 2, 8), (1, 2, 9), (1, 3, 4), (1, 3, 5)]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size], strict=True)], names=["part", "sig", "id"]) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in repeated(iter(batches)) for r in b.to_pylist()] == [*rows[1:4], *rows[5:]]
    assert list(repeated(iter([]))) == []


@pytest.mark.parametrize("hot", [4, 2000])
def test_spotsigs_components(spark, hot):
    rng = random.Random(4)
    texts = []
    for _ in range(8):
        base = prose(rng, 150)
        texts += [base, base, *(copies(rng, base, e) for e in (1, 2, 4, 30))]
    texts += ["the same words here now and here again then"] * 10 + ["", None]
    signer = Signer()
    sets = [signer.signatures(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if likeness(sets[i], sets[j]) >= 0.8]
    want = {i: r for i, r in enumerate(roots(len(texts), links)) if any(i in x for x in links)}
    got = {r["doc_id"]: r["component_id"] for r in spotsigs_components(docs(spark, list(enumerate(texts))), hot=hot).collect()}
    assert got == want


def test_written_state_is_released(spark):
    from lotlens.llm import common

    df = common.materialise(spark.range(3), "test")
    assert df._lotlens_path in common._written(spark) and df.count() == 3
    common.discard(df)
    common.discard(None)
    other = common.materialise(spark.range(3), "test")
    common.release(spark)
    assert not common._written(spark)
    with pytest.raises(Exception):  # noqa: B017
        other.count()


def _documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_simhash_query_against_all_pairs(spark):
    """op3 against the contract in plain Python, over all documents."""
    import re

    import xxhash

    texts, prints = _documents(spark), {}
    for i, t in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        shingles = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    links = [(x, y) for x in range(len(ids)) for y in range(x) if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 2]
    want = {i: ids[r] for i, r in zip(ids, roots(len(ids), links), strict=True)}
    rows = queries.op3_simhash_gray_index(spark, DATA).collect()
    assert len(rows) == len(ids) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: ("%016x" % prints[i], want[i]) for i in ids}
    assert len(set(want.values())) < len(ids)


def test_spotsigs_query_against_all_pairs(spark):
    """op5's columns and components in plain Python, over all documents: every matching pair is connected."""
    texts, signer = _documents(spark), Signer()
    ids = sorted(texts)
    sets = {i: set(signer.signatures(texts[i]).tolist()) for i in ids}
    like = lambda a, b: len(a & b) / len(a | b)
    links = [(x, y) for x in range(len(ids)) for y in range(x) if like(sets[ids[x]], sets[ids[y]]) >= 0.8]
    want = {i: ids[r] for i, r in zip(ids, roots(len(ids), links), strict=True)}
    rows = {r["doc_id"]: r for r in queries.op5_spotsigs(spark, DATA).collect()}
    joined = {r["doc_id"]: r["component_id"] for r in spotsigs_components(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert set(rows) == set(ids)
    for i, j in zip(ids, ids[-1:] + ids[:-1], strict=True):
        r, t = rows[i], texts[i]
        n = len(t) // 3
        e = t[: len(t) - n] + texts[j][:n]
        es = set(signer.signatures(e).tolist())
        assert (r["n_chars"], r["edited_sha256"], joined.get(i, i)) == (len(t), hashlib.sha256(e.encode()).hexdigest(), want[i])
        assert r["fingerprint"] == "".join("%08x" % x for x in sorted(sets[i])) and r["edited_fingerprint"] == "".join("%08x" % x for x in sorted(es))
        assert r["near_edited"] == pytest.approx(like(sets[i], es)) and r["near_next"] == pytest.approx(like(sets[i], sets[j]))
    assert links


def test_work_grows_with_the_copies(spark, monkeypatch):
    """Five times the near copies give about five times the rows at every step, not their square; identifiers may be large."""
    from lotlens.llm import simhash as module

    rng = random.Random(21)
    base, seen, write = prose(rng, 200), {}, module.materialise
    big = (1 << 60) + 1

    def counted(df, name):
        out = write(df, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(module, "materialise", counted)
    rows = {}
    for n in (40, 200):
        texts = [(big + i, copies(rng, base, i % 4)) for i in range(n)] + [(big + 1000 + i, prose(rng, 40)) for i in range(5)]
        seen.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, texts)).collect()}
        assert got == dict.fromkeys([big + i for i in range(n)], big)
        rows[n] = dict(seen)
    assert all(rows[200][k] <= 8 * max(v, 40) for k, v in rows[40].items())
