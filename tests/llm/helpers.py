"""Small corpora with nulls, empty and long texts, ties, repeats and clashing columns, and brute-force versions."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60, words=90):
    """Documents that share passages, with repeats, near copies, blank and null texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "İx", "…", "Straße", "A", "a"]
    shared = [[r.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    rows = []
    for k in range(n):
        own = [r.choice(vocabulary) for _ in range(r.randrange(words))]
        if r.random() < 0.5:
            at, part = r.randrange(len(own) + 1), r.choice(shared)
            own[at:at] = part[r.randrange(5) :]
        text = "".join(w + r.choice([" ", " ", "\n", "\t", "  "]) for w in own)
        rows.append((n - k, text, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(text)))
    rows += [(500, None, "en", "s0", None), (501, "", "en", "s0", 0), (502, rows[3][1], "en", "s1", 1), (503, rows[3][1] + " more", "en", "s1", 1), (504, " \n\t ", None, None, 4), (505, "a " * 3000, "en", "s1", 6000), (506, "a " * 3000, "en", "s1", 6000)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCUMENTS).repartition(3)


def stored_tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
