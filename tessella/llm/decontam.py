"""Benchmark decontamination with a positional inverted index.

Words are known by a 64-bit hash. A window (13 consecutive words of an item, or a shorter item as a whole) is looked up from its rarest words, its anchors:

1. The words of the benchmark are counted in the corpus; counts are combined before the shuffle.
2. The index has a posting (term, doc, place) for every occurrence of an anchor, and of no other word.
3. The postings of a window's rarest word, shifted by its offset, are places where the text may be aligned; they are intersected with the shifted postings of its next rarest ones. Windows that have the same
   anchors at the same places of their text share the look-up, and windows of equal words are one.
4. What is left is compared word by word: candidates meet the words of their document in pieces of ``PIECE`` words, so the work is linear in words and candidates.

Proximity matches, where all words of a window stand in any order within ``SLOP`` more words than it has, come from the same index: the postings of the rarest word are kept that have postings of the next rarest ones near
enough (an equi-join on stretches of a document), and what is left is compared with the words around it.

Nothing is grouped by term but counts, and the look-up table is broadcast if it is small, so a frequent word doesn't gather in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, id_filter, let, parallelism, picked, staged

# Fixed value: what separates words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms whose shifted postings are intersected before words are compared.
RAREST = 3
#: Words that a proximity match may have besides the window's.
SLOP = 5
#: Words of a document that candidates are compared with at a time.
PIECE = 4096
#: Rows of a look-up table that is broadcast (under 200 bytes each), and of the table with the windows themselves (under 2 KB each); larger ones are shuffled, where adaptive execution splits skewed terms.
MAX_BROADCAST_ROWS, MAX_BROADCAST_WINDOWS = 200_000, 20_000


def words(text: Column) -> Column:
    """Words of the text, A-Z not yet in lower case."""
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def _small(df: DataFrame, rows: int, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """text_key, item, first (place of the window in its text) and terms (hashes) of every window; texts without words have none. text_key tells apart the texts that share an item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.transform(words(F.col("text")), lambda w: F.xxhash64(ascii_lower(w))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("text_key", F.xxhash64("item", "w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    return items.select("text_key", "item", "w", F.explode(starts).alias("first")).select("text_key", "item", "first", F.slice("w", F.col("first") + 1, F.lit(size)).alias("terms")).distinct()


def hashed(text: Column) -> Column:
    """The words of the text as terms."""
    return F.transform(words(text), lambda w: F.xxhash64(ascii_lower(w)))


def frequencies(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term and n: how often each of the given terms stands in whole texts."""
    # The outer explode: for the other one the planner would filter by the number of words first, and so take every text apart twice.
    tokens = docs.select(F.explode_outer(words(F.col("text"))).alias("word")).where(F.col("word").isNotNull()).select(F.xxhash64(ascii_lower(F.col("word"))).alias("term"))
    count = lambda df: df.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return count(tokens.join(F.broadcast(terms), "term", "left_semi")) if n_terms <= MAX_BROADCAST_ROWS else count(tokens).join(terms, "term", "left_semi")


def index(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings (term, doc, place) of the given terms in whole texts; place counts words from 0."""
    tokens = docs.select(F.col("doc_id").alias("doc"), F.posexplode_outer(words(F.col("text"))).alias("place", "word")).where(F.col("word").isNotNull())
    postings = tokens.select(F.xxhash64(ascii_lower(F.col("word"))).alias("term"), "doc", "place")
    if n_terms > MAX_BROADCAST_ROWS:
        postings = picked(postings, "term", id_filter(terms))
    return postings.join(_small(terms, n_terms), "term", "left_semi")


def lookups(wins: DataFrame, counts: DataFrame, n_terms: int) -> DataFrame:
    """``wins`` with ``anchors``: the RAREST rarest terms (term, its place in the text), rarest first. Windows with a term that the corpus lacks are gone."""
    terms = wins.select("text_key", "first", F.posexplode("terms").alias("offset", "term")).join(_small(counts, n_terms), "term", "left")
    by_window = terms.groupBy("text_key", "first").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"),
        F.slice(F.sort_array(F.collect_list(F.struct("n", (F.col("first") + F.col("offset")).alias("at"), "term"))), 1, RAREST).alias("anchors"),
    )
    anchors = F.transform("anchors", lambda a: F.struct(a["term"].alias("term"), a["at"].alias("at")))
    return wins.join(by_window.where(F.col("least") > 0), ["text_key", "first"]).drop("least").withColumn("anchors", anchors)


def alignments(postings: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """anchor_id, doc and delta (the place of the benchmark text's word 0) where the shifted postings of all anchors meet. ``groups``: n rows of anchor_id and anchors."""
    met = None
    for k in range(RAREST):
        asked = groups.where(F.size("anchors") > k).select("anchor_id", F.col("anchors")[k]["term"].alias("term"), F.col("anchors")[k]["at"].alias("at"))
        shifted = postings.join(_small(asked, n), "term").select("anchor_id", "doc", (F.col("place") - F.col("at")).alias("delta"))
        if met is None:
            met = shifted
        else:
            key = ["anchor_id", "delta"]
            same = [met[c] == shifted[c] for c in key] + [met["doc"].eqNullSafe(shifted["doc"])]
            there = met.join(shifted, same, "left_semi")
            # Windows of fewer words have fewer anchors.
            met = there.unionByName(met.join(_small(groups.where(F.size("anchors") <= k).select("anchor_id"), n), "anchor_id", "left_semi").select(met.columns))
    return met.distinct()


@dataclass
class LookUp:
    """What windows are looked up with: ``asked`` (anchor_id, text_key, first, terms), ``groups`` (anchor_id, anchors) and the postings of their anchors."""

    asked: DataFrame
    groups: DataFrame
    n_groups: int
    postings: DataFrame


def look_up(docs: DataFrame, wins: DataFrame, scratch: Scratch) -> LookUp:
    """``wins``: text_key, first and terms, no two of the same terms."""
    terms = wins.select(F.explode("terms").alias("term")).distinct()
    n_terms = terms.count()
    counts = scratch(frequencies(docs, terms, n_terms), "decontam-counts")
    looked = scratch(lookups(wins, counts, n_terms).withColumn("anchor_id", F.xxhash64("text_key", "anchors")), "decontam-lookups")
    rare = scratch(looked.select(F.explode("anchors").alias("a")).select("a.term").distinct(), "decontam-terms")
    postings = scratch(index(docs, rare, rare.count()), "decontam-postings")
    groups = scratch(looked.select("anchor_id", "anchors").distinct(), "decontam-anchors")
    return LookUp(looked.select("anchor_id", "text_key", "first", "terms"), groups, groups.count(), postings)


def _texts_of(docs: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and text of the documents (and few others) that have candidates, as a table, so that no filter on their words moves before the choice."""
    return scratch(picked(docs.select("doc_id", "text"), "doc_id", id_filter(candidates.select("doc"))), "decontam-texts")


def _meet_words(near: DataFrame, candidates: DataFrame, asked: DataFrame, place: Column, margin: int, fits) -> DataFrame:
    """doc, text_hash and the candidates (with text_key, first, terms and place) for which ``fits(words, c, at)`` holds; ``at`` is the place's index among the words. ``candidates``: anchor_id, doc and what ``place`` needs; ``near``: the texts that they may be in.
    A document's words come in pieces with ``margin`` words of their neighbours on either side."""
    found = candidates.join(_small(asked, asked.count(), MAX_BROADCAST_WINDOWS), "anchor_id").where(place >= 0)
    found = found.select(F.col("doc").alias("__doc"), F.floor(place / PIECE).alias("piece"), F.struct(place.alias("place"), "text_key", "first", "terms").alias("c"))
    grouped = found.groupBy("__doc", "piece").agg(F.collect_set("c").alias("candidates"))

    def pieces(w: Column) -> Column:
        begin = lambda i: F.greatest(i * PIECE - margin, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PIECE).cast("int")),
            lambda i: F.struct(i.cast("long").alias("piece"), begin(i).alias("begin"), F.slice(w, begin(i) + 1, (i + 1) * PIECE + margin - begin(i)).alias("w")),
        )

    parts = near.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), hashed(F.col("text")).alias("w")).where(F.size("w") > 0).select("doc", "text_hash", F.explode(pieces(F.col("w"))).alias("p"))
    pairs = parts.select("doc", "text_hash", F.col("p.piece").alias("__piece"), "p.begin", "p.w").join(grouped, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("__piece") == F.col("piece")))
    # Little data and much work.
    pairs = pairs.repartition(parallelism(near.sparkSession))
    hits = F.filter("candidates", lambda c: fits(F.col("w"), c, (c["place"] - F.col("begin")).cast("int")))
    return pairs.select("doc", "text_hash", F.explode(hits).alias("c")).select("doc", "text_hash", "c.*")


def places(docs: DataFrame, found: LookUp, scratch: Scratch, size: int = WINDOW) -> DataFrame:
    """doc, text_hash, text_key, first, start and length (words) of each place in ``docs`` where one of the windows stands."""
    met = scratch(alignments(found.postings, found.groups, found.n_groups), "decontam-candidates")
    same = lambda w, c, at: F.slice(w, at + 1, F.size(c["terms"])) == c["terms"]
    hits = _meet_words(_texts_of(docs, met, scratch), met, found.asked, F.col("delta") + F.col("first"), size - 1, same)
    return hits.select("doc", "text_hash", "text_key", "first", F.col("place").alias("start"), F.size("terms").alias("length")).distinct()


def near_candidates(found: LookUp, scratch: Scratch, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """anchor_id, doc and place of the postings of rarest words that have postings of the window's next rarest ones near enough."""
    reach = size + slop
    met = None
    for k in range(RAREST):
        asked = found.groups.where(F.size("anchors") > k).select("anchor_id", F.col("anchors")[k]["term"].alias("term"))
        mine = found.postings.join(_small(asked, found.n_groups), "term").select("anchor_id", "doc", "place", F.floor(F.col("place") / reach).alias("stretch"))
        if met is None:
            met = mine
        else:
            other = mine.select(F.col("anchor_id").alias("__id"), F.col("doc").alias("__doc"), F.col("place").alias("__place"), F.explode(F.array(F.col("stretch") - 1, F.col("stretch"), F.col("stretch") + 1)).alias("__stretch"))
            close = (met["anchor_id"] == other["__id"]) & met["doc"].eqNullSafe(other["__doc"]) & (met["stretch"] == other["__stretch"]) & (F.abs(met["place"] - other["__place"]) < reach)
            there = met.join(other, close, "left_semi")
            met = there.unionByName(met.join(_small(found.groups.where(F.size("anchors") <= k).select("anchor_id"), found.n_groups), "anchor_id", "left_semi").select(met.columns))
    return scratch(met.select("anchor_id", "doc", "place").distinct(), "decontam-near-candidates")


def near_places(docs: DataFrame, found: LookUp, candidates: DataFrame, scratch: Scratch, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc, text_hash, text_key, first and place (of its rarest word) of the windows whose words all stand, as often as in the window and in any order, among as many words of a document as the window has, plus ``slop``."""

    def fits(w: Column, c: Column, at: Column) -> Column:
        length = F.size(c["terms"]) + slop
        begin = F.greatest(at - length + 1, F.lit(0))
        around = F.slice(w, begin + 1, at + length - begin)

        def within(words_near: Column) -> Column:
            times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
            enough = lambda xs: F.forall(F.array_distinct(c["terms"]), lambda t: times(xs, t) >= times(c["terms"], t))
            return F.exists(F.sequence(F.lit(1), F.greatest(F.size(words_near) - length + 1, F.lit(1))), lambda i: enough(F.slice(words_near, i, length)))

        # Few candidates have all words around them.
        return F.when(F.size(F.array_except(c["terms"], around)) > 0, False).otherwise(let(around, within))

    hits = _meet_words(_texts_of(docs, candidates, scratch), candidates, found.asked, F.col("place").cast("long"), size + slop - 1, fits)
    return hits.select("doc", "text_hash", "text_key", "first", "place").distinct()


def known_windows(benchmark: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The windows of the benchmark, those of equal words once (text_key, first, terms), and the items that have them (text_key, first, item)."""
    every = scratch(windows(benchmark, size), "decontam-windows")
    once = every.groupBy("terms").agg(F.min(F.struct("text_key", "first")).alias("w"))
    wins = scratch(once.select("w.text_key", "w.first", "terms"), "decontam-distinct")
    members = every.select("item", "terms").join(wins, "terms").select("text_key", "first", "item").distinct()
    return wins, scratch(members, "decontam-members")


def exact_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """doc, text_hash, item, start and length (words) of each place in ``docs`` where a window of an item of ``benchmark`` stands.

    Rows that share a doc_id are told apart by text_hash. Null texts and ids: a null text has no words; a null doc_id is an id like others; a null item_id is a null item, whose words count as others' do.
    """
    scratch = scratch or Scratch()
    wins, members = known_windows(benchmark, size, scratch)
    return places(docs, look_up(docs, wins, scratch), scratch, size).join(members, ["text_key", "first"]).select("doc", "text_hash", "item", "start", "length").distinct()


def proximity_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, scratch: Scratch | None = None) -> DataFrame:
    """doc, text_hash, item and place (of the window's rarest word) where all words of a window of an item stand close together in any order (``near_places``)."""
    scratch = scratch or Scratch()
    wins, members = known_windows(benchmark, size, scratch)
    found = look_up(docs, wins, scratch)
    return near_places(docs, found, near_candidates(found, scratch, size, slop), scratch, size, slop).join(members, ["text_key", "first"]).select("doc", "text_hash", "item", "place").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``, and n_near (items with a proximity match, exact ones included) where ``slop`` is given; an empty table gives an empty result.

    Benchmark rows without an item_id count for n_hit and contaminated, and are not among the items.
    """
    scratch = Scratch()
    wins, members = known_windows(benchmark, size, scratch)
    index_of = look_up(docs, wins, scratch)
    keys, near, few = ["doc", "text_hash"], None, docs
    having = lambda rows: rows.select(*keys, "text_key", "first").distinct().join(members, ["text_key", "first"])
    if slop is not None:
        candidates = near_candidates(index_of, scratch, size, slop)
        few = _texts_of(docs, candidates, scratch)  # words that stand side by side are near
        near = staged(having(near_places(few, index_of, candidates, scratch, size, slop)).groupBy(*keys).agg(F.count_distinct("item").alias("n_near")), "decontam-near")
    hits = staged(places(few, index_of, scratch, size), "decontam-hits")
    items = staged(having(hits).groupBy(*keys).agg(F.sort_array(F.collect_set("item")).alias("items")), "decontam-items")
    scratch.clear()
    # A hit counts the words that no earlier one of its text covers.
    longest = hits.groupBy("doc", "text_hash", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("doc", "text_hash").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    n_hit = longest.withColumn("fresh", F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))).groupBy("doc", "text_hash").agg(F.sum("fresh").alias("n_hit"))
    both = n_hit.join(items, [n_hit["doc"].eqNullSafe(items["doc"]), n_hit["text_hash"] == items["text_hash"]]).select(n_hit["doc"].alias("__doc"), n_hit["text_hash"].alias("__hash"), "n_hit", "items")
    n_words = let(F.split(F.coalesce("text", F.lit("")), SEPARATORS, -1), lambda p: F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - ((F.size(p) > 1) & (F.get(p, F.size(p) - 1) == "")).cast("int"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("__text"), n_words.cast("long").alias("n_words"))
    out = rows.join(both, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__text") == F.col("__hash")), "left")
    hit, found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    more = []
    if near is not None:
        near = near.select(F.col("doc").alias("__near_doc"), F.col("text_hash").alias("__near_hash"), "n_near")
        out = out.join(near, F.col("doc_id").eqNullSafe(F.col("__near_doc")) & (F.col("__text") == F.col("__near_hash")), "left")
        more = [F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")]
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), *more,
    )
