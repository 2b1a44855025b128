"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, id long, key string"


def words(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "in", "ed"]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def documents(seed=1):
    rnd = random.Random(seed)
    passage = words(rnd, 40)
    base = words(rnd, 120)
    texts = [words(rnd, rnd.randint(5, 80)) for _ in range(25)]
    texts += [base] * 4 + [base.replace(" ", "  ", 1), " ".join(base.split()[:-1] + ["zz"]), base.upper(), base + " tail", "head " + base]
    texts += [words(rnd, 20) + "\n" + passage + "\n" + words(rnd, 20) for _ in range(6)]
    texts += [None, None, "", "", " \t\n ", "a", "a b", "a b", "É É", "x" * 5000, "ab " * 3000, "Übung ÄÖ " * 50, passage, "1 2 3", "\x00 \x7f", "🙂 🙂 🙂", words(rnd, 8000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [rows[0], rows[0], (None, base), (None, None), (-5, passage), (2**62, base)]
    return [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", None if t is None else len(t), 0.5, 1, 99, "k") for i, t in rows]


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
