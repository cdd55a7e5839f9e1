import random

import corpus_pipeline
from helpers import DOCUMENTS, stored_tables


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    import random

    r = random.Random(4)
    good = lambda: "\n".join(" ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(12)) for _ in range(8))
    rows = [(k, good(), "en", "s", 1) for k in range(40)]
    rows += [(100 + k, "JUNK!! THING!! " * 20 + str(k), "en", "s", 1) for k in range(20)]
    bench = " ".join(f"q{k}" for k in range(30))
    rows += [(200, rows[3][1], "en", "s", 1), (201, bench, "en", "s", 1)]
    labels = [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(20)]
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=([(1, bench)], "item_id long, text string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, d)
        assert done.columns == docs.columns, name
    assert {x.doc_id for x in corpus_pipeline.quality(spark, docs, d).collect()} >= set(range(40))
    assert not {x.doc_id for x in corpus_pipeline.quality(spark, docs, d).collect()} & set(range(100, 120))
    assert {x.doc_id: x.text for x in corpus_pipeline.lines(spark, docs, d).collect()}[200] == ""
    assert 200 not in {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, d).collect()}
    assert {x.doc_id for x in docs.collect()} - {x.doc_id for x in corpus_pipeline.decontamination(spark, docs, d).collect()} == {201}
    out = {x.doc_id for x in corpus_pipeline.run(spark, d).collect()}
    assert set(range(40)) <= out and not out & {*range(100, 120), 201}


def documents_of_all_kinds():
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(8, 15))) for _ in range(n))
    rows = [(k, text(r.randrange(6, 9)), "en", "s", 1) for k in range(40)]
    rows += [(100 + k, "JUNK!! THING!! " * 20 + str(k), None, "s", 1) for k in range(20)]
    for k in range(12):  # near copies, some below the similarity
        w = rows[k][1].split(" ")
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"n{r.randrange(99)}"
        rows.append((200 + k, " ".join(w), "en", "t", 1))
    bench = " ".join(f"q{k}" for k in range(30))
    rows += [(300, rows[5][1], "en", "s", 1), (301, bench, "en", "s", 1), (302, rows[7][1] + "\n" + bench, "en", "s", 1), (303, None, None, None, None), (304, "", "", "", 0), (None, text(5), "en", "s", 1), (None, text(6), "en", "s", 1), (305, "\n \t", "en", "s", 2), rows[1], rows[1]]
    labels = [(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(20)]
    return rows, labels, [(1, bench), (2, None), (3, "")]


def as_rows(df):
    return sorted([(x.doc_id, x.text) for x in df.collect()], key=str)


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on nulls, empty and blank texts, repeated rows, ties, missing ids and near copies."""
    from test_decontamination import brute as brute_windows
    from test_line_dedup import brute as brute_lines
    from test_quality_classifier import brute_score
    from test_shingle_dedup import brute as brute_groups
    from tokenizers import Tokenizer

    import public_tokenizers
    from paperloom.llm.quality_classifier import is_held_out, train_quality

    rows, labels, bench = documents_of_all_kinds()
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS), labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(bench, "item_id long, text string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    plain = [r[:2] for r in rows]
    model = train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where(~is_held_out("doc_id")))
    assert as_rows(corpus_pipeline.quality(spark, docs, d)) == sorted([r for r in plain if brute_score(model, r[1]) >= 0.5], key=str)
    once = list(dict.fromkeys(plain))
    gone = brute_lines(once)
    cut = lambda i, t: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))
    assert as_rows(corpus_pipeline.lines(spark, docs, d)) == sorted([(i, cut(i, t)) for i, t in plain], key=str)
    first = lambda g: min((plain[k] for k in g), key=lambda x: (x[0] is None, x[0] or 0))[0]
    groups = brute_groups([t for _, t in plain])
    kept = as_rows(corpus_pipeline.near_duplicates(spark, docs, d))
    assert sorted([k for k, _ in kept], key=str) == sorted([first(g) for g in groups], key=str) and set(kept) <= set(plain)
    judged = {x[0]: x[-1] for x in brute_windows([(k, t) for k, (_, t) in enumerate(plain)], bench)}
    assert as_rows(corpus_pipeline.decontamination(spark, docs, d)) == sorted([r for k, r in enumerate(plain) if not judged[k]], key=str)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = {(x.doc_id, tuple(x.ids), x.n_tokens) for x in corpus_pipeline.tokens(spark, docs, d).collect()}
    assert coded == {(i, tuple(ids := library.encode(t or "", add_special_tokens=False).ids), len(ids)) for i, t in plain}


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    rows, labels, bench = documents_of_all_kinds()
    tables = dict(labels=(labels, "doc_id long, quality int, toxic int"), benchmark=(bench, "item_id long, text string"))
    d = stored_tables(spark, tmp_path, documents=(rows, DOCUMENTS), **tables)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    more = docs.selectExpr("*", "1 AS __score", "2 AS __found", "3 AS __key", "4 AS id", "5 AS text_key", "6 AS c0", "7 AS root")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, more, d)
        assert done.columns == more.columns and as_rows(done) == as_rows(stage(spark, docs, d)), name
        assert stage(spark, docs.limit(0), d).count() == 0
    assert corpus_pipeline.tokens(spark, more, d).count() == docs.count() and corpus_pipeline.tokens(spark, docs.limit(0), d).count() == 0
