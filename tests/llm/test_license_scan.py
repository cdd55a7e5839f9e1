import random
import re

from helpers import documents

from paperloom.llm import license_scan as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_notices_are_found_where_they_stand(spark):
    rows = []
    for k, (_, text) in enumerate(D.TEMPLATES):
        rows += [(2 * k, f"{'x ' * k}{text} y é z", "", "", 0), (2 * k + 1, text.upper().replace(" ", "\n"), "", "", 0)]
    got = {r.doc_id: r["__matches"] for r in D.scan_licenses(documents(spark, rows)).collect()}
    for k, (name, text) in enumerate(D.TEMPLATES):
        n = len(WORD.findall(text.lower()))
        for doc, at in ((2 * k, k), (2 * k + 1, 0)):
            assert any(m.license == name and (m.start, m.end) == (at, at + n) and m.containment == 1 for m in got[doc]), (name, doc, got[doc])


def test_partial_copies_by_containment(spark):
    text = D.TEMPLATES[5][1]
    words = text.split()
    near = " ".join("changed" if k == 30 else w for k, w in enumerate(words))
    far = " ".join("changed" if k % 6 == 0 else w for k, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    got = {r.doc_id: [m.license for m in r["__matches"]] for r in D.scan_licenses(documents(spark, [(1, near, "", "", 0), (2, far, "", "", 0), (3, half, "", "", 0), (4, f"{'q ' * 5000}{text}{' q' * 5000}{text}", "", "", 0)])).collect()}
    assert got == {1: ["MIT"], 2: [], 3: [], 4: ["MIT", "MIT"]}


def test_nulls_short_texts_own_templates_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "one two three", 5), (3, "a b c d e f", 6), (3, "a b c d e f", 6)], "doc_id long, text string, license int")
    done = D.scan_licenses(docs, templates=[("own", "b c d e f"), ("short", "a b")])
    assert done.columns == [*docs.columns, "__matches"]
    assert sorted([len(r["__matches"]) for r in done.collect()]) == [0, 0, 0, 1, 1]
    assert D.scan_licenses(docs.limit(0)).count() == 0 and D.scan_licenses(docs, templates=[]).count() == 5


def test_inserted_words_against_windowed_containment(spark):
    r = random.Random(2)
    isc = dict(D.TEMPLATES)["ISC"]
    shingles = lambda t: [tuple(w[k : k + 5]) for w in [WORD.findall(t.lower())] for k in range(len(w) - 4)]
    names, rows = [("ISC", isc), ("MIT", D.TEMPLATES[5][1]), ("BSD-3-Clause", dict(D.TEMPLATES)["BSD-3-Clause"])], [(0, isc.replace("this software", "this software and its documentation"), "", "", 0)]
    for k in range(1, 90):
        words = names[k % 3][1].split()
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(words))
            words[at:at] = [f"i{r.randrange(99)}" for _ in range(r.randrange(1, 9))]
        rows.append((k, f"{'x ' * r.randrange(60)}{' '.join(words)}{' z' * r.randrange(60)}", "", "", 0))
    got = {x.doc_id: {m.license for m in x["__matches"]} for x in D.scan_licenses(documents(spark, rows), templates=names).collect()}
    assert got[0] == {"ISC"}
    inside = 0
    for doc, text, *_ in rows:
        own = shingles(text)
        for name, template in names:
            want, n = set(shingles(template)), len(shingles(template))
            if any(5 * len(want & set(own[k : k + n + n // 2])) >= 4 * len(want) for k in range(len(own))):
                inside += 1
                assert name in got[doc], (doc, name)
            elif name in got[doc]:
                assert 5 * len(want & set(own)) >= 4 * len(want)
    assert inside > 30


def test_recall_by_containment(spark):
    """Of notices with changed words, those that hold 0.8 of a template's shingles are found: at least nine of ten at every containment."""
    r = random.Random(6)
    shingles = lambda t: [tuple(w[k : k + 5]) for w in [WORD.findall(t.lower())] for k in range(len(w) - 4)]
    own, rows = [x for x in D.TEMPLATES if len(shingles(x[1])) >= 12], []
    for k in range(500):
        name, text = own[k % len(own)]
        words = text.split()
        for _ in range(r.randrange(1 + len(words) // 18)):
            words[r.randrange(len(words))] = f"ch{r.randrange(99)}"
        if r.random() < 0.4:
            words = words[: -r.randrange(1, 1 + len(words) // 5)]
        rows.append((k, " ".join([f"p{r.randrange(9)}" for _ in range(r.randrange(40))] + words + [f"s{r.randrange(9)}" for _ in range(r.randrange(40))]), "", "", 0))
    got = {x.doc_id: {m.license for m in x["__matches"]} for x in D.scan_licenses(documents(spark, rows), templates=own).collect()}
    hits, all_ = {}, {}
    for k, text, *_ in rows:
        have = set(shingles(text))
        for name, template in own:
            want = set(shingles(template))
            share = len(want & have) / len(want)
            if share >= 0.8:
                band = int(share * 20)
                all_[band] = all_.get(band, 0) + 1
                hits[band] = hits.get(band, 0) + (name in got[k])
            elif not any(n == name and len(set(shingles(t)) & have) >= 0.8 * len(set(shingles(t))) for n, t in own):
                assert name not in got[k], (k, name, share)
    assert sum(all_.values()) > 250 and all(hits[b] >= 0.9 * all_[b] for b in all_), (hits, all_)
