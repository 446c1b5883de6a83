"""Benchmark decontamination by template canonicalisation, in DataFrame
operations only.

Texts become templates: numbers, units that follow a number, and names
(capitalised words) turn into typed placeholders, all else into lower-case
words.  Windows of template tokens are hashed and joined with the
benchmark's, in two readings: with the names as placeholders, and with the
names as words, so that neither new names nor another case hides a copy.

A document is tied to an item when it holds at least ``coverage`` of the
item's windows, either value for value, anywhere, or in one place with slots
that agree: there each value that the item has in a slot is replaced by one
value throughout.  So a question with new numbers or names is caught, as often
as the document holds it, and an accidental template is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Unit words that turn into a placeholder after a number.
UNITS = "%|€|£|cents?|cm|degrees?|dollars?|days?|euros?|feet|ft|g|grams?|h|hours?|inch(?:es)?|kg|kilograms?|kilometers?|kilometres?|km|kmh|l|liters?|litres?|m|meters?|metres?|miles?|min|minutes?|ml|mm|months?|mph|pounds?|s|seconds?|tons?|weeks?|years?|yards?"
WINDOW = 8
LITERALS = 3  # a window with fewer words has to agree in its values
SHORTEST = 5  # items of fewer tokens have to be the whole document
BAND = 16  # places of one copy may be shifted by less, where words were put in or left out

#: Placeholders start with this character, then d, u or n, then the replaced value.
MARK = "\x01"
_SPACE = r"[\x20\t\n\x0b\f\r]+"
_PUNCTUATION = r"[!-/:-@\[-`{-~¡«·»¿]+"
_UPPER = r"A-ZÀ-ÖØ-Þ"
_LEVELS = 2  # bits of the filter that a window must have set


def template(text: Column) -> Column:
    """The text with typed placeholders, in lower case, without punctuation.

    Each pattern starts with the character that it is about and looks back
    from there, so that most positions are passed by at once.
    """
    t = F.regexp_replace(text, rf"([{_UPPER}])(?<![\p{{L}}\p{{N}}].)(\p{{Ll}}+)", f"{MARK}n$1$2")
    numbers = F.regexp_replace(t, rf"([0-9])(?<![\p{{L}}\p{{N}}{MARK}].)([0-9]*(?:[.,][0-9]+)*)", f" {MARK}d$1$2 ")
    units = F.regexp_replace(numbers, rf"([0-9] {{1,2}})({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{MARK}u$2")
    t = F.when(t.rlike("[0-9]"), units).otherwise(t)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), _PUNCTUATION, ""), _SPACE, " "))


def _tokens(df: DataFrame, values: bool) -> DataFrame:
    """The frame without its text, with the hashes of its tokens, names as
    words (``_a``) and names as placeholders (``_b``, null without names),
    the tokens themselves (``_v``, null without placeholders) and, if they are
    asked for, hashes of the tokens' values (``_e``, else null)."""
    keep = [c for c in df.columns if c != "text"]
    plain = df.select(*keep, template(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_s"))
    marked, named = F.contains("_s", F.lit(MARK)), F.contains("_s", F.lit(MARK + "n"))
    counted = F.contains("_s", F.lit(MARK + "d"))
    typed = F.when(counted, F.regexp_replace("_s", f"{MARK}([du])[^ ]*", f"{MARK}$1")).otherwise(F.col("_s"))
    split = lambda c: F.when(F.col("_s") == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    hashes = lambda c: F.transform(split(c), lambda x: F.xxhash64(x))
    words = F.when(named, F.replace(typed, F.lit(MARK + "n"), F.lit(""))).otherwise(typed)
    return plain.select(*keep, hashes(words).alias("_a"), F.when(named, hashes(F.regexp_replace(typed, f"{MARK}n[^ ]*", f"{MARK}n"))).alias("_b"), F.when(marked, split(F.col("_s"))).alias("_v"),
        (hashes(F.regexp_replace("_s", f"{MARK}[dun]", "")) if values else F.lit(None).cast("array<bigint>")).alias("_e"))


def _hash(tokens: str, size: int, salt: int) -> Column:
    """Hash of the window at ``pos``, element by element: generated code
    without a slice.  Only where the window lies inside the text."""
    return F.xxhash64(*(F.get(tokens, F.col("pos") + k) for k in range(size)), F.lit(salt))


def _bits(hashes: list[int]) -> tuple[Column, int]:
    """A bit filter of the benchmark's windows as one literal array of longs,
    of at most 128 KB (plans carry it, as text, too); more windows only make
    it less selective."""
    bits = 1 << 12
    while bits < 16 * len(hashes) and bits < 1 << 20:
        bits <<= 1
    words = [0] * (bits >> 6)
    for h in hashes:
        for k in range(_LEVELS):
            at = ((h & (1 << 64) - 1) >> (32 * k)) & (bits - 1)
            words[at >> 6] |= 1 << (at & 63)
    signed = (w - (1 << 64) if w >> 63 else w for w in words)
    return F.split(F.lit(",".join(map(str, signed))), ",").cast("array<bigint>"), bits


def _may(h: Column, filter_: tuple[Column, int] | None) -> Column:
    out = F.lit(True)
    if filter_ is not None:
        words, bits = filter_
        for k in range(_LEVELS):
            at = F.shiftrightunsigned(h, 32 * k).bitwiseAND(F.lit(bits - 1))
            out &= F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return out


def _slots(size: int, names: bool) -> Column:
    """The window's values in their places, null where it has none."""
    is_slot = (lambda x: x.startswith(MARK)) if names else (lambda x: x.startswith(MARK) & ~x.startswith(MARK + "n"))
    s = F.array_join(F.transform(F.slice("_v", F.col("pos") + 1, size), lambda x: F.when(is_slot(x), x).otherwise("")), "|")
    return F.when(F.contains(s, F.lit(MARK)), s)


def _windows(tokens: DataFrame, sizes: list[int], whole: bool, filter_: tuple[Column, int] | None, exact: bool) -> DataFrame:
    """One row a window and reading that may be the benchmark's: the frame's
    columns, hash ``w``, start ``pos``, ``slots``, ``values`` (whether w is of
    the values) and the window's number of ``words``.

    Every start and reading is a row of generated code that the bit filter
    drops before anything is made of it; the arrays are only looked into.
    The generators are outer ones: for the others Spark infers a filter,
    which would work out the templates once more.
    """
    keep = [c for c in tokens.columns if c not in ("_a", "_b", "_v", "_e")]
    n, pos = F.size("_a"), F.col("pos")
    starts = tokens.select(*tokens.columns, F.explode_outer(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("pos"))
    made = []
    for size in sizes:
        fits = (n == size) & (pos == 0) if size < SHORTEST or whole and size < WINDOW else pos + size <= n
        words, names = _hash("_a", size, size), _hash("_b", size, size)
        # where no name is among its tokens, a window reads the same in both ways
        made += [(F.when(fits, words), size, 0), (F.when(fits & F.col("_b").isNotNull() & (names != words), names), size, 1)]
        if exact:  # the few windows of little but placeholders, by their values
            made.append((F.when(fits, _hash("_e", size, -size)), size, 2))
    each = F.explode_outer(F.array(*(F.struct(w.alias("w"), F.lit(size).alias("size"), F.lit(kind).alias("kind")) for w, size, kind in made))).alias("_r")
    rows = starts.select(*keep, "_v", "pos", each).where(F.col("_r.w").isNotNull() & _may(F.col("_r.w"), filter_)).select(*keep, "_v", "pos", "_r.*")
    slots = F.lit(None).cast("string")
    for size in sizes:
        for names in (0, 1):
            slots = F.when((F.col("size") == size) & (F.col("kind") == names), _slots(size, bool(names))).otherwise(slots)
    rows = rows.select(*keep, "w", "pos", slots.alias("slots"), (F.col("kind") == 2).alias("values"), "size")
    filled = F.coalesce(F.size(F.filter(F.split("slots", r"\|"), lambda x: x != "")), F.lit(0))
    return rows.select(*keep, "w", "pos", "slots", "values", (F.col("size") - F.when(F.col("slots").isNull(), 0).otherwise(filled)).alias("words"))


def item_windows(benchmark: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, w, ipos, item_slots, values) of every item's windows, each
    hash of an item once, at its first place.  Windows of fewer than
    :data:`LITERALS` words go by their values."""
    items = _tokens(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")), True)
    rows = _windows(items, list(range(1, WINDOW + 1)), True, None, True)
    # what goes by its values does so where its words are too few in the reading with names
    least = rows.where("not values").groupBy("item_id", "pos").agg(F.min("words").alias("least"))
    good = rows.join(least, ["item_id", "pos"]).where(F.when(F.col("values"), F.col("least") < LITERALS).otherwise(F.col("words") >= LITERALS))
    first = good.groupBy("item_id", "w").agg(F.min(F.struct("pos", "slots", "values")).alias("f"))
    return first.select("item_id", "w", F.col("f.pos").alias("ipos"), F.col("f.slots").alias("item_slots"), F.col("f.values").alias("values"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.5, broadcast_rows: int = 400_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id,
    item_id, windows (different ones matched), item_windows, position (of
    the first, in template tokens), reparameterised (no copy value for value).

    Items shorter than a window count as one window of their own length,
    and those of fewer than :data:`SHORTEST` template tokens must be the whole
    document.  Null or empty texts match nothing.  Repeated documents are
    judged each by itself and rows that agree in id and finding are returned
    once.  Up to ``broadcast_rows`` benchmark windows are broadcast; more are
    joined by a shuffle, whose hot windows adaptive execution splits.
    """
    bench = written(item_windows(benchmark, item_col=item_col, item_text_col=item_text_col), "benchmark")
    short = _tokens(benchmark.select(F.col(item_text_col).alias("text")), False).select(F.least(F.size("_a"), F.lit(WINDOW)).alias("n")).where("n > 0").distinct().collect()  # at most WINDOW values
    sizes = sorted(r.n for r in short) or [WINDOW]
    totals = bench.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows"))
    known = bench.select("w").distinct().limit(broadcast_rows + 1).collect()
    small = len(known) <= broadcast_rows
    exact = not bench.where("values").isEmpty()
    side = bench.select("item_id", "w", "ipos", "item_slots")
    side = F.broadcast(side) if small else side
    rows = _tokens(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text")), exact)
    hits = _windows(rows, sizes, False, _bits([r.w for r in known]) if small else None, exact).join(side, "w")
    left, right = F.split("item_slots", r"\|"), F.split("slots", r"\|")
    pairs = F.when(F.col("item_slots").isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.zip_with(left, right, lambda a, b: F.when(a != "", F.concat_ws("\x02", a, b))), lambda x: x.isNotNull()))
    shift = F.col("pos") - F.col("ipos")
    # a place: one shift, or a band of shifts in either of two halfway overlapping rows of bands
    places = F.explode_outer(F.array(F.struct(F.lit(0).alias("kind"), shift.alias("at")), *(F.struct(F.lit(k + 1).alias("kind"), F.floor((shift + k * BAND // 2) / BAND).cast("int").alias("at")) for k in (0, 1)), F.struct(F.lit(3).alias("kind"), F.lit(0).alias("at"))))
    same = F.col("item_slots").eqNullSafe(F.col("slots"))
    hits = hits.select("doc_id", "_row", "item_id", "ipos", "pos", pairs.alias("pairs"), same.alias("same"), places.alias("place")).where((F.col("place.kind") < 3) | F.col("same"))
    by = hits.groupBy("doc_id", "_row", "item_id", "place").agg(F.size(F.collect_set("ipos")).alias("windows"), F.min("pos").alias("position"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.transform("pairs", lambda p: F.substring_index(p, "\x02", 1))
    agrees = (F.col("place.kind") == 3) | (F.size(F.array_distinct(values)) == F.size("pairs"))
    joined = by.where(agrees).join(F.broadcast(totals) if small else totals, "item_id")
    enough = joined.where(F.col("windows") >= F.col("item_windows") * F.lit(coverage))
    found = enough.groupBy("doc_id", "_row", "item_id").agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.min("position").cast("long").alias("position"), (F.max("place.kind") < 3).alias("reparameterised"))
    return found.select("doc_id", "item_id", F.col("windows").cast("long").alias("windows"), F.col("item_windows").cast("long").alias("item_windows"), "position", "reparameterised").distinct()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose id was tied to an item; rows with a
    null id stay unless a null-id row was tied.  Extra columns may have any
    name.  The ids found are joined back, by broadcast only where Spark's own
    size check allows it."""
    name = "_found"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    found = find_contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col(options.get("id_col", "doc_id")).cast("long").eqNullSafe(F.col(name)), "left_anti")
