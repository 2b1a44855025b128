"""Quality rules with thresholds that follow the corpus.

The measures of a document come from its whole text by projections alone. Their distributions are kept as KLL sketches per language and
source; sketches merge, so those of a language and of the corpus are merged from those of its sources without reading the documents again.

A fence lies ``REACH`` spreads beyond the quartile. The spread is the interquartile range or, where that is more, the distance of the median from an outer percentile: the 90th (below: the 10th), so that up to a tenth of a
group may be junk, or the 99th for repeated lines and windows, which clean texts have too. Groups are of any size: quartile and spread of a source are averaged with those of its language, which weigh as much as
``WEIGHT`` documents, those of a language with the corpus's, and the corpus's spread with a prior one.
A document in which a measure comes from a single event (one symbol, one line or 3-word window seen twice) is not rejected for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

WORDS = r"[ \t\n\x0B\f\r]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Spreads beyond the quartiles.
REACH = 3.0
#: Documents that the next wider group's values, or the prior spread, weigh as much as.
WEIGHT = 20
#: measure: outer percentile, prior spread, and whether low values are rejected too.
MEASURES = {"symbols": (0.9, 0.02, False), "dup_lines": (0.99, 0.1, False), "repeats": (0.99, 0.1, False), "word_length": (0.9, 0.25, True)}
#: measure: its count, and what a single event adds to it.
EVENTS = {"symbols": ("n_symbols", 1), "dup_lines": ("n_dup_lines", 1), "repeats": ("n_repeat_words", 6)}
K = 256


def words(text: Column) -> Column:
    return F.filter(F.split(text, WORDS, -1), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in ``ws``."""

    def covered(starts: Column) -> Column:
        nexts = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(2**31 - 1)))
        return F.aggregate(F.zip_with(starts, nexts, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0).cast("long"), lambda acc, x: acc + x)

    def of(windows: Column) -> Column:
        """windows: their hashes in order of place. Equal ones become neighbours by sorting (hash, place)."""
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            here = F.slice(s, 1, F.size(s) - 1)
            after = F.slice(s, F.lit(2), F.size(s) - 1)
            pairs = F.filter(F.zip_with(here, after, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())
            return F.sort_array(F.array_distinct(F.flatten(pairs)))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(placed, twins), covered))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    three = lambda h: F.zip_with(
        F.zip_with(F.slice(h, F.lit(1), F.size(h) - 2), F.slice(h, F.lit(2), F.size(h) - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(h, F.lit(3), F.size(h) - 2), lambda p, c: F.xxhash64(p["a"], p["b"], c)
    )
    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(let(hashes, three), of))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document; a null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.char_length(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    base = docs.select(
        "doc_id", "lang", "source",
        (size - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("w"),
    )
    return base.select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"), F.col("lines.n").alias("n_lines"),
    )


def _values() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return {"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words")}


def fences(rows: DataFrame) -> DataFrame:
    """lang, source, n and the fences of each group, from sketches (level 0); source or both are null for the wider groups (levels 1 and 2)."""
    names = list(MEASURES)
    sketches = staged(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(v, F.lit(K)).alias(m) for m, v in _values().items()]), "quality-sketches")
    merged = lambda keys: sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(K)).alias(m) for m in names])

    def own(groups: DataFrame, keys: list[str]) -> DataFrame:
        """n, and for each measure the quartiles and the spreads to either side."""
        columns = []
        for m, (tail, _, _) in MEASURES.items():
            inner, low, mid, high, outer = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (round(1 - tail, 4), 0.25, 0.5, 0.75, tail))
            columns += [high.alias(f"{m}_q3"), low.alias(f"{m}_q1"), F.greatest(high - low, outer - mid).alias(f"{m}_up"), F.greatest(high - low, mid - inner).alias(f"{m}_down")]
        return groups.where(F.col("n") > 0).select(*keys, "n", *columns)

    parts = [f"{m}_{x}" for m in names for x in ("q3", "q1", "up", "down")]

    def shrunk(mine: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
        """Each value averaged with the wider group's."""
        other = wider.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in parts])
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        joined = mine.join(other, same) if same else mine.join(F.broadcast(other))  # one row
        return joined.select(*[c for c in mine.columns if c not in parts], *[((F.col("n") * F.col(c) + WEIGHT * F.col(f"__{c}")) / (F.col("n") + WEIGHT)).alias(c) for c in parts])

    every = own(merged([]), [])
    prior = {f"{m}_{x}": spread for m, (_, spread, _) in MEASURES.items() for x in ("up", "down")}
    corpus = every.withColumns({c: (F.col("n") * F.col(c) + WEIGHT * v) / (F.col("n") + WEIGHT) for c, v in prior.items()})
    language = shrunk(own(merged(["lang"]), ["lang"]), corpus, [])
    source = shrunk(own(sketches, ["lang", "source"]), language, ["lang"])
    bounds = []
    for m, (_, _, both) in MEASURES.items():
        bounds += [(F.col(f"{m}_q3") + REACH * F.col(f"{m}_up")).alias(f"{m}_high"), (F.col(f"{m}_q1") - REACH * F.col(f"{m}_down") if both else F.lit(-1.0)).alias(f"{m}_low")]
    none = F.lit(None).cast("string")
    levels = [source, language.withColumn("source", none), corpus.withColumn("lang", none).withColumn("source", none)]
    out = [x.select(F.lit(k).alias("level"), "lang", "source", "n", *bounds) for k, x in enumerate(levels)]
    return out[0].unionByName(out[1]).unionByName(out[2])


#: Up to so many groups the table of fences (about 100 bytes a row) is broadcast.
MAX_BROADCAST_GROUPS = 20_000


def judge(docs: DataFrame) -> DataFrame:
    """The counts of every document with ``base_failed`` and ``kept``.

    base_failed: under 50 words, or over half of the words in repeated windows. The fences come from the documents that pass the base rules. A null language or
    source is a group of its own. Ties at a fence are kept. Equal rows are judged alike; an empty table gives an empty result; columns other than doc_id, text, lang and source are ignored.
    """
    rows = staged(measured(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "quality-measures")
    limits = staged(fences(rows.where(~F.col("base_failed"))), "quality-fences")
    keys = [f"{m}_{side}" for m in MEASURES for side in ("high", "low")]
    mine = limits.where(F.col("level") == 0).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct(*keys).alias("f"))
    # Every document that passes the base rules has a group.
    out = rows.join(F.broadcast(mine) if limits.count() <= MAX_BROADCAST_GROUPS else mine, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for m, v in _values().items():
        within = F.coalesce(v.between(F.col(f"f.{m}_low"), F.col(f"f.{m}_high")), F.lit(True))
        inside = inside & (within | (F.col(EVENTS[m][0]) <= EVENTS[m][1]) if m in EVENTS else within)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"))
