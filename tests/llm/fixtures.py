"""Invented documents for the corpus operators: copies, near copies, nulls, empty, long and odd texts, clashing extra columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, key int, component string, n int"


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


def documents(seed=1, n=60):
    r = random.Random(seed)
    rows = [words(r, r.randint(1, 120)) for _ in range(n)]
    for i in range(12):  # copies and near copies
        base = r.choice(rows[:20]).split()
        for _ in range(r.choice((0, 1, 2, 6))):
            base[r.randrange(len(base))] = "changed"
        rows.append(" ".join(base))
    rows += [None, "", "   \n\t", "ONE", "one", "one", "x" * 30_000, words(r, 4000), "äöü ß 東京 🙂 " * 5]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), 7, "x", 1, None, 2) for i, t in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, COLUMNS).repartition(3)
