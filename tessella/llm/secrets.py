"""Secret scans: fixed patterns, and windows of high entropy in long unbroken strings.

Everything is a projection: no shuffle, no Python. Positions come from splitting a text at a pattern: the pieces between the matches and
the matches themselves alternate, so the lengths of both add up to the places. Running values over the matches of a text are kept in blocks (``scan``), as appending to an array copies it.

The entropy of a window of ``window`` characters is log2(w) - S / w with S the sum of c * log2(c) over the counts c of its characters. Sliding by
one character changes two counts, so S is updated from those two; the counts are packed into a few longs, of which at most two change. A candidate's
class is the smallest of the classes below that holds all its characters; each has its own threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# The patterns, as the contract gives them; those of a least length find what the longest match with that length checked afterwards finds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

#: A string is a candidate if no character of these classes stands before or after it.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class, pattern of the whole candidate, least entropy in bits of a window. A window of 20 characters has 4.32 bits at most.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 2.9), ("alnum", r"^[A-Za-z0-9]+$", 3.7), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9))
WINDOW = 20
#: Candidates that are no secrets: UUIDs, paths and dashed or underscored words, runs of the alphabet, one character repeated.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[/_=+-]*([A-Za-z]+|[0-9]+)([/_=+-]+([A-Za-z]+|[0-9]+))*[/_=+-]*$",
    r"(?i)(abcdefghij|0123456789|example|placeholder|xxxxxx)",
)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
FOUND = "array<struct<start:bigint,end:bigint,text:string>>"
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


#: Elements that a scan appends one by one; blocks of them are put together at once.
BLOCK = 256


def scan(items: Column, zero: Column, step, emit) -> Column:
    """``emit(state, x)`` for each x of an array, with the state before x: ``zero``, then ``step(state, x)`` of the element before. Null for an empty array."""

    def blocks_of(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def appended(xs: Column, state: Column, after, out) -> Column:
        """``out`` of every element; ``after`` makes the next state."""
        kind = F.struct(state.alias("state"), F.filter(F.array(out(state, xs[0])), lambda x: F.lit(False)).alias("out"))
        return F.aggregate(xs, kind, lambda acc, x: F.struct(after(acc["state"], x).alias("state"), F.array_append(acc["out"], out(acc["state"], x)).alias("out")), lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        states = appended(blocks, zero, lambda state, block: F.aggregate(block, state, step), lambda state, block: state)
        return F.flatten(F.zip_with(blocks, states, lambda block, state: appended(block, state, step, emit)))

    return F.when(F.size(items) > 0, let(items, lambda xs: let(blocks_of(xs), over)))


def matches(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of the leftmost non-overlapping matches."""

    def positions(found: Column, pieces: Column) -> Column:
        steps = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(F.char_length(p).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size"), m.alias("text")))
        span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["text"].alias("text"))
        return scan(steps, F.lit(0).cast("long"), lambda at, x: at + x["gap"] + x["size"], span)

    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda pieces: positions(found, pieces)))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast(FOUND))


def has_dense_window(candidate: Column, window: int, least: Column) -> Column:
    """Whether a window of the candidate that holds a letter and a digit has at least that entropy; counts are kept from window to window."""
    bits = window.bit_length()  # of a count
    each = 63 // bits  # counts in a long
    weight = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    is_letter, is_digit = lambda c: c.between(0, 51).cast("int"), lambda c: c.between(52, 61).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c % each * bits)
    word = lambda c: F.floor(c / each).cast("int")
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), c % each * bits).bitwiseAND(F.lit(2**bits - 1))

    def slide(codes: Column) -> Column:
        def step(acc: Column, new: Column, old: Column) -> Column:
            same = new == old
            up, down = count(acc["counts"], new), F.when(old < 0, F.lit(0)).otherwise(count(acc["counts"], old))
            gain = F.when(same, 0.0).otherwise(weight(up + 1) - weight(up))
            loss = F.when(same | (old < 0), 0.0).otherwise(weight(down) - weight(down - 1))
            total = acc["total"] + gain - loss
            digits, letters, n = acc["digits"] + is_digit(new) - is_digit(old), acc["letters"] + is_letter(new) - is_letter(old), acc["n"] + 1
            dense = (n >= window) & (digits > 0) & (letters > 0) & (F.log2(F.lit(float(window))) - total / window >= least)
            change = lambda c, j: c + F.when(j == word(new), one(new)).otherwise(0) - F.when((old >= 0) & (j == word(old)), one(old)).otherwise(0)
            counts = F.when(same, acc["counts"]).otherwise(F.transform(acc["counts"], change))
            return F.struct(counts.alias("counts"), total.alias("total"), digits.alias("digits"), letters.alias("letters"), n.alias("n"), dense.alias("hit"))

        zero = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // each)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("digits"), F.lit(0).alias("letters"), F.lit(0).alias("n"), F.lit(False).alias("hit")
        )
        pairs = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("old")))
        # After the first hit the rest is passed over.
        return F.aggregate(pairs, zero, lambda acc, p: F.when(acc["hit"], acc).otherwise(step(acc, p["new"], p["old"])), lambda acc: acc["hit"])

    return let(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), slide)


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """start, end and text of the candidates that have a window of high entropy for their class and are not allowed."""

    def wanted(c: Column) -> Column:
        least = F.lit(99.0)
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(c.rlike(pattern), bits).otherwise(least)
        allowed = F.lit(False)
        for pattern in ALLOW:
            allowed = allowed | c.rlike(pattern)
        # The allow list comes first: it is cheaper.
        return F.when(allowed | ~c.rlike("[0-9]") | ~c.rlike("[A-Za-z]"), False).otherwise(has_dense_window(c, window, least))

    return F.filter(matches(text, CANDIDATE), lambda m: wanted(m["text"]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the array columns ``base`` and ``spans`` (start, kind, end), each in order of start, then kind.

    kind counts through ``KINDS``. ``spans`` has the base spans and those entropy spans that no base span covers. A null text is an empty one: no spans.
    Equal rows are judged each by itself; there is no grouping, so no case of skew. An empty table gives an empty result; columns named ``base``
    or ``spans`` are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = lambda found, k: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_VALUE)
    base = F.sort_array(F.concat(kind(assign, 0), kind(matches(text, ACCESS), 1), kind(matches(text, HEX), 2)))
    found = docs.withColumn("base", base).withColumn("__dense", kind(entropy_spans(text), 3))
    # In order of start, base spans first, an entropy span is covered if a base span before it ends no sooner.
    reach = scan(F.sort_array(F.concat("base", "__dense")), F.lit(-1).cast("long"), lambda far, s: F.when(s["kind"] < 3, F.greatest(far, s["end"])).otherwise(far), lambda far, s: F.when((s["kind"] < 3) | (s["end"] > far), s))
    spans = F.when(F.size("__dense") == 0, F.col("base")).otherwise(F.filter(reach, lambda s: s.isNotNull()))
    return found.withColumn("spans", spans).drop("__dense")


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans share one mark. Texts without spans, nulls included, stay as they are."""

    def cut(text: Column, spans: Column) -> Column:
        """The text between the spans, with a mark for each span that starts at or after the end of those before it."""
        gaps = scan(spans, F.lit(0).cast("long"), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end"))))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))

        def between(letters: Column) -> Column:
            piece = lambda a, b: F.array_join(F.slice(letters, a.cast("int") + 1, (b - a).cast("int")), "")
            return F.concat(F.array_join(F.transform(F.filter(gaps, lambda g: g.isNotNull()), lambda g: F.concat(piece(g["start"], g["end"]), F.lit(mark))), ""), piece(last, F.size(letters).cast("long")))

        return let(F.split(text, ""), between)

    found = find_secrets(docs)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(cut(F.coalesce(F.col("text"), F.lit("")), F.col("spans")))
    return found.withColumn("text", clean).drop("base", "spans")
