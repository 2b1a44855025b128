import random
import zlib

import pytest
from cases import empty
from pyspark.sql import functions as F

from tessella.llm import langid
from tessella.llm.queries import op8_language_id


def test_held_out_accuracy(spark, sf_dir):
    got = op8_language_id(spark, sf_dir).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]][0] for r in got if r["held_out"]]
    assert len(held) > 20 and sum(held) >= 0.95 * len(held)


def words_of(text):
    import unicodedata

    return "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower()).split()


def grams(word):
    padded = f" {word} "
    return [g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " "]


def distances(text, profiles):
    """The nearest language and the score, or None for a text without a letter."""
    counts = {}
    for w in words_of(text):
        for g in grams(w):
            counts[g] = counts.get(g, 0) + 1
    if not counts:
        return None
    known = {g for p in profiles.values() for g in p}
    ranked = sorted(counts, key=lambda g: (-counts[g], g not in known, g))[: langid.PROFILE]
    out = {k: sum(min(abs(p.index(g) - i), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(ranked)) for k, p in profiles.items()}
    best = min(sorted(out), key=out.get)
    return best, 1 - out[best] / (langid.PROFILE * len(ranked))


def brute(text, profiles):
    return distances(text, profiles)[0]


def test_learn_against_plain_python(spark, docs):
    """The most frequent n-grams of each language's rows, ties by text; repeated rows count as often as they stand."""
    from collections import Counter

    want = {}
    for r in docs.collect():
        if r["lang"] is not None and r["text"] is not None:
            for w in words_of(r["text"]):
                want.setdefault(r["lang"], Counter()).update(grams(w))
    want = {k: sorted(c, key=lambda g: (-c[g], g))[: langid.PROFILE] for k, c in want.items()}
    assert langid.learn(docs) == want


def test_against_plain_python():
    rnd = random.Random(0)
    profiles = {"aa": grams("theringand"), "bb": grams("schuenberg"), "cc": grams("theberguen")}
    profiles = {k: list(dict.fromkeys(v)) for k, v in profiles.items()}
    model = langid.Profiles(profiles)
    for _ in range(200):
        text = " ".join("".join(rnd.choice("theringandschube") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 30)))
        assert model.predict(text)[0] == brute(text, profiles)


def test_only_letters_are_letters():
    """Numbers of any kind, marks and signs are no letters; letters that count as numbers are."""
    import unicodedata

    model = langid.Profiles({"aa": grams("abc"), "zh": grams("一二三")})
    for text in ("½ ² 12", "Ⅷ ①", "٣ ४", "_", "́", "🙂", "1²_½"):
        assert model.predict(text) == ("und", 0.0), text
    assert model.predict("½ 一二三")[0] == "zh" and model.predict("a½b")[0] == "aa"
    rnd = random.Random(1)
    for c in map(chr, [*range(0x3000), *(rnd.randrange(0x3000, 0x110000) for _ in range(20_000))]):
        lower = any(unicodedata.category(x).startswith("L") for x in c.lower())
        assert (len(langid.count(c)[0]) > 0) == lower, hex(ord(c))


def test_counts_of_pieces(monkeypatch):
    """Long texts are looked at in pieces; n-grams at the seams count."""
    from collections import Counter

    rnd = random.Random(3)
    for piece in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(langid, "PIECE", piece)
        for text in ("", "a", "a b", " a", "ab", "abc", "1", "İI ß", *("".join(rnd.choice("abcé 1²中.") for _ in range(rnd.randint(1, 60))) for _ in range(30))):
            want = Counter(g for w in words_of(text) for g in grams(w))
            keys, counts = langid.count(text)
            assert {langid.gram_of(k): n for k, n in zip(keys.tolist(), counts.tolist(), strict=True)} == want, (piece, text)
            assert [langid.gram_of(k) for k in keys.tolist()] == sorted(want) and [langid.key_of(g) for g in sorted(want)] == keys.tolist()


def test_awkward_rows(spark, docs):
    profiles = langid.learn(docs)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in langid.identify(docs, profiles).collect()}
    assert got[None, None] == ("und", 0.0)
    for (_, t), (lang, _) in got.items():
        assert (lang == "und") == (not t or not any(c.isalpha() for c in t))
    for t, (lang, score) in ((t, x) for (_, t), x in got.items() if t):
        want = distances(t, profiles)
        assert (lang, score) == (("und", 0.0) if want is None else (want[0], pytest.approx(want[1])))
    assert langid.identify(empty(spark), profiles).count() == 0
    nothing = langid.learn(docs.where("false"))
    assert nothing == {} and langid.identify(docs, nothing).where(F.col("lang_pred") != "und").count() == 0


@pytest.mark.parametrize("bound", [5, 10**9])
def test_sample_is_bounded(spark, sf_dir, bound):
    assert set(langid.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), bound)) <= {"en", "fr", "de", "es"}


def test_counts_are_passed_on_in_parts(monkeypatch):
    """Tasks that meet many n-grams pass their counts on before the end; together they are those of all texts."""
    from collections import Counter

    import pyarrow as pa

    rnd = random.Random(4)
    rows = [(rnd.choice(["aa", "bb"]), "".join(rnd.choice("abcdé  中") for _ in range(rnd.randint(0, 80)))) for _ in range(1500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[at : at + 700], strict=True)], names=["lang", "text"]) for at in range(0, 1500, 700)]
    want = Counter((lang, g) for lang, t in rows for w in words_of(t) for g in grams(w))
    monkeypatch.setattr(langid, "HELD_GRAMS", 50)
    monkeypatch.setattr(langid, "OUT_ROWS", 30)
    out = list(langid._batch_counts(iter(batches)))
    got = Counter()
    for b in out:
        for r in b.to_pylist():
            got[r["lang"], r["gram"]] += r["n"]
    assert got == want and max(b.num_rows for b in out) <= 30 and sum(b.num_rows for b in out) > len(want)
