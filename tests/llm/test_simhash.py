import random
import re

import numpy as np
import pytest
import xxhash
from helpers import DOCUMENTS, corpus, stored_tables

from paperloom.llm import simhash as D
from paperloom.llm import vantage as V
from paperloom.llm.components import connected_components, local_components, spanning_links

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(ids, values, radius=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 8)
    rows = [*corpus(9, 60), corpus(9, 60)[0], (None, "a b c", None, None, 1), (600, "A b\tC", None, None, 1)]
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS))
    values = [fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{v:016x}" for v in values], groups([r[0] for r in rows], values)), key=str)
    assert sorted(map(tuple, D.op4_simhash_near_dedup(spark, d).collect()), key=str) == want


@pytest.mark.parametrize("leaves", [1, 4, 32])
def test_shards_find_every_pair(leaves):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(0, 64, 7) for b in range(0, 64, 9)]))
    tree = V.VantageTree(values[::3], leaves)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    homes = np.zeros(len(values), np.int64)
    for _, rows, home in tree.deal(values, 2):
        homes[rows] += home
        x, y = spanning_links(V.near_pairs(values[rows], home, 2))
        a.append(rows[x])
        b.append(rows[y])
    label = local_components(len(values), np.concatenate(a), np.concatenate(b))
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    x, y = np.nonzero(close)
    assert (homes == 1).all() and (label == local_components(len(values), x, y)).all()


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(200, 200)]
    r.shuffle(links)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 61 + 50 and len({got[k] for k in range(61)}) == 1 and len({got[k] for k in range(100, 150)}) == 1 and got[0] != got[100]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d", 1), (1, "A b c d", 2), (2, None, 3), (5, "", 4), (4, "x y z", 5), (4, "x y z", 5), (None, "x y z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group int")
    kept = D.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert D.drop_near_duplicates(docs.limit(0)).count() == 0


def test_unrelated_texts_without_ids_stay(spark):
    rows = [(None, "a b c d"), (None, "p q r s t"), (None, "p q r s t"), (None, "x y z"), (7, "k l m n"), (None, "K l m n")]
    kept = D.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, "a b c d"), (None, "p q r s t"), (None, "x y z"), (7, "k l m n")], key=str)


def test_rounds_of_components_grow_with_the_logarithm(spark, monkeypatch):
    from paperloom.llm import components as C

    written = []
    monkeypatch.setattr(C, "stored", lambda df: written.append(0) or C_stored(df))
    rows = [(k, k + 1) for k in range(1000)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert len(written) <= 1 + 3 * 20
    roots = {r.node: r.root for r in got}
    assert len(roots) == 1201 and len({roots[k] for k in range(1001)}) == 1 and len({roots[5000 + k] for k in range(200)}) == 1
    assert roots[0] != roots[5000] and roots[0] in roots and roots[5000] in roots
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


from paperloom.llm._spark import stored as C_stored  # noqa: E402
