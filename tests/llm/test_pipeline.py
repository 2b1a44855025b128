"""The pipeline's stages against plain Python on a small corpus with planted cases."""

import random

import pytest
from cases import words
from pyspark.sql import functions as F

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(5)
    folder = str(tmp_path_factory.mktemp("corpus"))
    bench = [(i, words(rnd, 30)) for i in range(5)]
    texts = [words(rnd, rnd.randint(60, 200)) for _ in range(60)]
    base = texts[0].split()
    near = list(base)
    near[10] = "changed"
    texts += [texts[1], texts[1], " ".join(near), words(rnd, 60) + " " + bench[2][1], "12 34 56", "", None, words(rnd, 80) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + words(rnd, 20)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[3], (None, words(rnd, 70), "en", "s", 5)], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    ids = lambda df: sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
    one = cp.language_id(spark, docs, corpus)
    assert one.columns == docs.columns and ids(one) == sorted([*(i for i in before if i is not None and i not in (64, 65, 66)), 3])
    two = cp.near_duplicates(spark, one, corpus)
    assert two.columns == docs.columns and ids(two) == [i for i in range(60)] + [63, 67] and two.where(F.col("doc_id").isNull()).count() == 1
    three = cp.decontamination(spark, two, corpus)
    assert three.columns == docs.columns and ids(three) == [*range(60), 67]
    four = cp.secret_scan(spark, three, corpus)
    after = {r["doc_id"]: r for r in four.collect()}
    assert four.columns == docs.columns and all(after[i] == before[i] for i in range(60))
    assert "24be64439e3e" not in after[67]["text"] and "[SECRET]" in after[67]["text"] and after[67]["n_chars"] == len(after[67]["text"])
    five = cp.packed(spark, four, corpus)
    assert {r["doc_id"] for r in five.collect()} == set(after)


def test_run(spark, corpus):
    got = cp.run(spark, corpus)
    assert got.count() == 62 and [n for n, _ in cp.STAGES] == ["language_id", "ngram_join", "decontamination", "secret_scans", "packing"]


def test_stages_take_empty_tables(spark, corpus):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_language_stage_rejects_what_was_not_learned(spark):
    """Gibberish in Latin letters and languages without a profile go, whether labelled or not; the corpus stays."""
    rnd = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    letters = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    base64 = "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2000))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw"
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"
    planted = [(-1 - i, t, lang, "s", len(t)) for i, (t, lang) in enumerate((t, lang) for t in (letters(100), letters(400), base64, polish, finnish) for lang in ("en", None))]
    kept = {r["doc_id"] for r in cp.language_id(spark, docs.unionByName(spark.createDataFrame(planted, SCHEMA)), "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_language_stage_learns_from_all_rows(spark):
    """With more rows a language than a sample would take, profiles and least scores are those of all labelled rows, by plain Python."""
    from collections import Counter

    from test_langid import distances, grams, words_of

    from tessella.llm import langid

    rnd = random.Random(9)
    syllables = {"aa": ["th", "er", "on", "an", "re", "in"], "bb": ["ku", "mi", "to", "sa", "yo", "ne"]}

    def text(lang):
        noise = rnd.random() ** 2
        word = lambda: "".join(chr(rnd.randint(0x4E00, 0x9FA5)) if rnd.random() < noise else rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3)))
        return " ".join(word() for _ in range(rnd.randint(2, 6)))

    rows = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * (2 * langid.TRAIN_ROWS))]
    rows += [(len(rows) + i, text(lang), None) for i, lang in enumerate(["aa", "bb"] * 100)] + [(-1, None, "aa"), (-2, "12", "bb")]
    counts = {}
    for _, t, lang in rows:
        if t and lang:
            counts.setdefault(lang, Counter()).update(g for w in words_of(t) for g in grams(w))
    profiles = {k: sorted(c, key=lambda g: (-c[g], g))[: langid.PROFILE] for k, c in counts.items()}
    found = {i: distances(t or "", profiles) or ("und", 0.0) for i, t, _ in rows}
    least = {}
    for lang in profiles:
        own = sorted(found[i][1] for i, _, known in rows if known == lang == found[i][0])
        least[lang] = cp.LEAST_LANGUAGE_SHARE * own[(len(own) - 1) // 2]
    want = {i for i, (lang, score) in found.items() if lang in least and score >= least[lang]}
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA)
    assert 0.5 * len(rows) < len(want) < 0.99 * len(rows)
    assert {r["doc_id"] for r in cp.language_id(spark, docs, "").select("doc_id").collect()} == want


def test_medians_are_exact(spark):
    """The lower median of each language, however often its scores repeat."""
    rnd = random.Random(10)
    rows = [("aa", rnd.random()) for _ in range(30_000)] + [("bb", rnd.randint(0, 3) / 4) for _ in range(1001)] + [("cc", 0.25)] + [("dd", x) for x in (0.5, 0.75)]
    by = {}
    for lang, x in rows:
        by.setdefault(lang, []).append(x)
    assert cp.medians(spark.createDataFrame(rows, "lang string, score double").repartition(3)) == {k: sorted(v)[(len(v) - 1) // 2] for k, v in by.items()}
    assert cp.medians(spark.createDataFrame([], "lang string, score double")) == {}


def test_decontamination_drops_any_window(spark, tmp_path):
    """13 words of an item in a document of 2,000 are enough; 12 are not."""
    rnd = random.Random(7)
    items = [words(rnd, 40).split() for _ in range(3)]
    long = words(rnd, 2000).split()
    rows = [(1, long), (2, [*long[:900], *items[1][5:18], *long[900:]]), (3, [*long[:900], *items[1][5:17], *long[900:]]), (4, [*items[2], *long]), (5, [*long, *items[0][27:]])]
    folder = str(tmp_path)
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in cp.decontamination(spark, docs, folder).collect()) == [1, 3]


def test_near_duplicates_of_awkward_rows(spark):
    """Unrelated texts that share a doc_id stay, copies without a doc_id go, equal rows are one, and of rows that differ in other columns alone one stays."""
    rnd = random.Random(8)
    one, two, three, four = (words(rnd, 80) for _ in range(4))
    rows = [(7, one, "en", "s", 1), (7, two, "en", "s", 1), (None, one + " more", "en", "s", 1), (9, two, "en", "s", 1), (None, three, "en", "s", 1), (None, three, "en", "s", 1), (None, three + " x", "en", "s", 1), (5, four, "en", "a", 1), (5, four, "en", "b", 1), (None, None, "en", "s", 1), (None, "", "en", "s", 1), (3, None, "en", "s", 1)]
    got = [tuple(r) for r in cp.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    texts = sorted((r[1] for r in got), key=repr)
    assert texts == sorted([one, two, four, None, None, "", next(r[1] for r in got if r[1] and r[1].startswith(three))], key=repr)
    assert {(r[0], r[1]) for r in got if r[0] is not None} == {(7, one), (7, two), (5, four), (3, None)}
