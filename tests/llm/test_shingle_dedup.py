import random
import re

import corpus_pipeline
import pytest
from helpers import corpus, documents

from paperloom.llm import shingle_dedup as D
from paperloom.llm.vantage import fingerprint

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(x, y):
    return 1.0 if x == y else len(x & y) / len(x | y)


def brute(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return {frozenset(k for k in range(len(label)) if label[k] == x) for x in label}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("most", [1, 8])
def test_groups_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "NEXT", most)
    r = random.Random(5)
    texts = [x[1] for x in corpus(6, 30)] + ["a b c", "A b\tC", "a b"]
    for size, n in ((100, 40), (60, 12), (300, 12)):  # dense and sparse families round the limit
        base = [f"v{r.randrange(500)}" for _ in range(size)]
        texts += [edited(r, base, r.randrange(1 + size // 30)) for _ in range(n)]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    found = {}
    for x in D.similar_groups(documents(spark, rows)).collect():
        found.setdefault(x.root, set()).add(x.id)
    assert {frozenset(x) for x in found.values()} == brute(texts)


def test_the_stage_drops_near_copies_that_fingerprints_miss(spark):
    r = random.Random(8)
    base = [f"v{r.randrange(900)}" for _ in range(200)]
    near = next(t for t in (edited(r, base, 3) for _ in range(99)) if jaccard(shingles(t), shingles(" ".join(base))) >= 0.8 and bin(fingerprint(t.encode()) ^ fingerprint(" ".join(base).encode())).count("1") > 2)
    docs = documents(spark, [(1, " ".join(base), "en", "s", 1), (2, near, "en", "s", 1), (3, edited(r, base, 30), "en", "s", 1), (None, "q w e r t y u", "en", "s", 1), (None, "z x c v b n m", "en", "s", 1), (None, "z x c v b n m", "en", "s", 1)])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted([(x.doc_id, x.text[:9]) for x in kept.collect()], key=str) == sorted([(1, " ".join(base)[:9]), (3, docs.where("doc_id = 3").first().text[:9]), (None, "q w e r t"), (None, "z x c v b")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
