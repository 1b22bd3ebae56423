"""Benchmark decontamination on template windows.

Texts become tokens: words in lower case, and typed slots for numbers, units
after numbers, and names (capitalised words). A window of
`WIDTH` tokens, its slots reduced to their types, is a template; windows of
documents and benchmark items meet by a hash join on 64 bits, each once for a
document and item. A re-parameterised question keeps its template but has other
slot values. So windows with slots are looked at again: within one occurrence
(one distance between the positions in document and item) a value of the item
must always stand for the same value of the document, else the windows with
slots of that occurrence do not count. A document is contaminated by an item if
the windows that count are `share` of the item's distinct windows.

A capitalised word that starts a sentence may be a name or not. In an item it
is none if some item has it in lower case; then its slot admits only the word
itself, and it counts as a word outside slots.

Windows with fewer than `LITERALS` words outside slots are no evidence. Items
shorter than a window are one window. An item none of whose windows is evidence
counts if a document holds its whole template in one occurrence, if it has at
least `WHOLE` tokens and two words outside slots; words that start its sentences
are no names then, and windows of slots alone need not be looked up.

A document is also contaminated by an item of which it holds `RUN` words in a
row (all words of a shorter item), slot values included and case folded,
whatever share of the item that is and however few words stand outside slots.
Runs of an occurrence whose slot values do not agree do not count either. Such
a run holds windows of `KEY` words, of which a document looks up only every
sixth; documents that meet one are looked at again.

Items of equal templates and slot values
count as one, under the smallest id. Null and empty
texts, and rows without id, have no windows. Rows of equal id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut_lineage
from .common import small

#: Tokens of a window, and how many of them must be words.
WIDTH, LITERALS = 8, 5
#: Share of an item's windows that a document must hold.
SHARE = 0.5
#: Tokens that an item without telling windows must have.
WHOLE = 6
#: Words in a row that are a copy whatever the share, and words of the windows that find them.
RUN, KEY = 13, 8

#: Units that may follow a number.
UNITS = ("percent|kilometers|kilometres|kilograms|meters|metres|grams|litres|liters|hours|hour|minutes|minute|seconds|days|day|"
         "weeks|years|miles|feet|inches|dollars|euros|cents|kg|km|cm|mm|mg|ml|lb|oz|ft|mph|kmh|kwh|m|g|l|s|h|%|€|°C|°F")
#: First characters of slot tokens, for numbers, units, names, capitalised words at sentence starts, and those of
#: them that are no names. The last three are one type.
NUMBER, UNIT, NAME, START, WORD = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Tokens from here on are no slots.
LITERAL = "\x06"

#: Capitalised words: all of them, those inside a sentence, and those that are left then. The capital is looked for first, which
#: is quicker than a look back at every character.
_CAPITAL = (r"(\p{Lu})(?<![\p{L}\p{N}]\p{Lu})(\p{Ll}+)", f"{NAME}$1$2")
_INSIDE = (r"(\p{Lu})(?<=[\p{Ll}0-9,;] \p{Lu})(\p{Ll}+)", f"{NAME}$1$2")
_STARTING = ("(\\p{Lu})(?<![\\p{L}\\p{N}\x03]\\p{Lu})(\\p{Ll}+)", f"{START}$1$2")
_CLEAR = [("[\x01-\x05]", " "), (r"([0-9])[.,]([0-9])", "$1$2")]
_NUMBERS = [(rf"([0-9]) ?({UNITS})([^\p{{L}}]|$)", f"$1 {UNIT}$2 $3"), ("([0-9]+)", f" {NUMBER}$1 ")]
#: (pattern, replacement) in turn, for documents and for items; only items tell where a capitalised word stands.
STEPS = [*_CLEAR, _CAPITAL, *_NUMBERS]
ITEM_STEPS = [*_CLEAR, _INSIDE, _STARTING, *_NUMBERS]
SPLIT = "[^\\p{L}\\p{N}\x01-\x04]+"


def tokens(text: Column, steps: list[tuple[str, str]] = STEPS) -> Column:
    """array<string>: words, and slots as a type character and the value."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.array_remove(F.split(F.lower(out), SPLIT), "")


def template(tokens: Column) -> Column:
    """The tokens with slots reduced to their type."""
    return F.transform(tokens, lambda t: F.when(
        t < LITERAL, F.translate(F.substring(t, 1, 1), START + WORD, NAME + NAME)).otherwise(t))


def _bare(token: Column) -> Column:
    """A token without its type."""
    return F.when(token < LITERAL, F.substr(token, F.lit(2))).otherwise(token)


def _said(tokens: Column) -> Column:
    """How many tokens are words outside slots."""
    return F.size(F.filter(tokens, lambda t: t >= WORD))


def _starts(template: Column, width) -> Column:
    """Where windows start, from 1; nowhere if the text is shorter."""
    return F.when(F.size(template) >= width, F.sequence(F.lit(1), F.size(template) - width + 1)).otherwise(
        F.array().cast("array<int>"))


def _windows(width: int, made) -> Column:
    """made(start) of all windows of `template`, in order."""
    return F.transform(_starts(F.col("template"), width), lambda i: made(i))


def _has_slot(window: Column) -> Column:
    return F.exists(window, lambda t: t < LITERAL)


def plain(tokens: Column) -> Column:
    """array<struct<word, at>>: the tokens without slot types, and where they stand, from 1."""
    bare = F.transform(tokens, lambda t, i: F.struct(_bare(t).alias("word"), (i + 1).alias("at")))
    return F.filter(bare, lambda x: x["word"] != "")


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, tokens, template) of the items that count as one, under the smallest id."""
    cut = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), tokens(F.col(text), ITEM_STEPS).alias("tokens"))
    cut = cut.withColumn("template", template(F.col("tokens"))).where(F.size("tokens") > 0)
    return cut.groupBy("template", "tokens").agg(F.min("item_id").alias("item_id"))


def _starts_known(items: DataFrame) -> DataFrame:
    """The items with the words marked that start a sentence and stand in lower case in some item."""
    every = items.select("item_id", F.explode("tokens").alias("t"))
    lower = every.where(F.col("t") >= LITERAL).select(F.col("t").alias("word")).distinct()
    starts = every.where(F.col("t").startswith(START)).select("item_id", _bare(F.col("t")).alias("word")).distinct()
    usual = starts.join(lower, "word", "left_semi").groupBy("item_id").agg(F.collect_list("word").alias("usual"))
    marked = F.transform("tokens", lambda t: F.when(
        t.startswith(START) & F.array_contains("usual", _bare(t)), F.concat(F.lit(WORD), _bare(t))).otherwise(t))
    return items.join(usual, "item_id", "left").withColumn(
        "tokens", F.when(F.col("usual").isNull(), F.col("tokens")).otherwise(marked)).drop("usual")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH,
                 literals: int = LITERALS) -> DataFrame:
    """(item_id, at, width, n, hash, slots, whole, own): the distinct windows of the items that are looked up.

    n counts them per item; whole: the item has no telling window, and all of
    them are needed in one occurrence.
    """
    cut = _starts_known(_items(items, item_id, text)).withColumn("width", F.least(F.size("template"), F.lit(width)))
    size, least = F.col("width"), F.least(F.lit(literals), F.col("width"))

    def windows(own: Column, whole: bool, words) -> Column:
        """The windows that hold so many words outside slots."""
        every = F.transform(_starts(own, size), lambda i: F.struct(
            i.alias("at"), F.lit(whole).alias("whole"), F.slice(own, i, size).alias("own")))
        return F.filter(every, lambda x: _said(x["own"]) >= words)

    def looked(own: Column, telling: Column) -> Column:
        words = F.transform(own, lambda t: F.when(t.startswith(START), F.concat(F.lit(WORD), _bare(t))).otherwise(t))
        others = let(words, lambda w: F.when((F.size(w) >= WHOLE) & (_said(w) >= 2), windows(w, True, F.lit(1))))
        return F.when(F.size(telling) > 0, telling).otherwise(others)

    # The marked words are bound once; an expression inside the windows would be worked out for each of them.
    # Only the windows are exploded: a row that carried the whole item would make long items quadratic.
    chosen = let(F.col("tokens"), lambda own: let(windows(own, False, least), lambda telling: looked(own, telling)))
    rows = cut.select("item_id", "width", F.explode(chosen).alias("x")).select("item_id", "width", "x.*")
    rows = rows.withColumn("window", template(F.col("own")))
    told = rows.groupBy("item_id", "width", "whole", "window").agg(F.min(F.struct("at", "own")).alias("f"))
    n = told.groupBy("item_id").agg(F.count("*").alias("n"))
    return told.join(n, "item_id").select("item_id", "f.at", "width", "n", F.xxhash64("window").alias("hash"),
                                          _has_slot(F.col("window")).alias("slots"), "whole", "f.own")


def _runs(words: Column, width, step: int = 1) -> Column:
    """array<struct<at, run>> of the runs of `width` words, or of every `step`-th."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(
        F.get(words, i - 1)["at"].alias("at"), F.transform(F.slice(words, i, width), lambda x: x["word"]).alias("run")))


def item_runs(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, at, width, size, hash, run): all runs of the items; (width, hash): the windows that find them."""
    cut = _items(items, item_id, text).select("item_id", plain(F.col("tokens")).alias("words")).where(F.size("words") > 0)
    cut = cut.withColumn("size", F.least(F.size("words"), F.lit(RUN)))

    def exploded(width: Column) -> DataFrame:
        rows = cut.select("item_id", "size", width.alias("width"), F.explode(_runs(F.col("words"), width)).alias("x"))
        return rows.select("item_id", "x.at", "width", "size", F.xxhash64("x.run").alias("hash"), "x.run")

    return exploded(F.col("size")), exploded(F.least("size", F.lit(KEY))).select("width", "size", "hash").distinct()


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", share: float = SHARE, width: int = WIDTH, literals: int = LITERALS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered, n_changed): the items that contaminate a document.

    n_windows: telling windows of the item; n_covered: how many of them the
    document holds; n_changed: slot values that differ.
    """
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Only numbers are sent to all executors; the words of a window are fetched for the pairs that met.
    windowed = cut_lineage(item_windows(items, item_id, item_text, width, literals), "items")
    theirs = small(windowed.drop("own"))
    runs, keys = item_runs(items, item_id, item_text)
    runs, keys = cut_lineage(runs, "runs"), small(keys)
    widths = sorted(r["width"] for r in theirs.select("width").distinct().collect()) or [width]  # at most `width` numbers
    whole = own.select("doc_id", tokens(F.col("text")).alias("tokens"))
    # A window that a document repeats meets the items once.
    hashed = whole.select("doc_id", template(F.col("tokens")).alias("template"), plain(F.col("tokens")).alias("words"))
    every = [_windows(w, lambda i, w=w: F.xxhash64(F.slice("template", i, w))) for w in widths]
    # A run of `least` words holds windows of w words at least - w + 1 starts in a row.
    for w, least in sorted(tuple(r) for r in keys.groupBy("width").agg(F.min("size")).collect()):  # at most `KEY` rows
        every.append(F.transform(_runs(F.col("words"), w, least - w + 1), lambda x: F.xxhash64(x["run"])))
    asked = small(theirs.select("hash").unionByName(keys.select("hash")).distinct())
    met = hashed.select("doc_id", F.explode(F.array_distinct(F.concat(*every))).alias("hash")).join(asked, "hash", "left_semi")
    met = cut_lineage(met.distinct(), "windows")
    windows = met.join(theirs.select("item_id", "n", "hash", "slots"), "hash")
    words = windows.where("not slots").select("doc_id", "item_id", "n", "hash", F.lit(0).cast("long").alias("changed"))
    slots, torn = _slot_windows(whole, windows.where("slots"), theirs.where("slots"), windowed.select("item_id", "at", "own"), widths)
    covered = words.unionByName(slots).groupBy("doc_id", "item_id", "n", "hash").agg(F.min("changed").alias("changed"))
    counted = covered.groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_covered"), F.max("changed").alias("n_changed"))
    held = _held_runs(whole, met.join(keys.select("hash"), "hash", "left_semi"), runs, torn)
    n = theirs.groupBy("item_id").agg(F.first("n").alias("n"))
    held = held.join(n, "item_id", "left").select("doc_id", "item_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias(
        "n_covered"), F.lit(0).alias("n_changed"), F.lit(True).alias("held"))
    both = counted.withColumn("held", F.lit(False)).unionByName(held).groupBy("doc_id", "item_id").agg(
        *[F.max(c).alias(c) for c in ("n", "n_covered", "n_changed", "held")])
    return both.where(F.col("held") | (F.col("n_covered") >= share * F.col("n"))).select(
        "doc_id", "item_id", F.col("n").alias("n_windows"), "n_covered", "n_changed")


def _held_runs(whole: DataFrame, met: DataFrame, runs: DataFrame, torn: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents with a run of the item in an occurrence that is not torn."""
    sizes = sorted(r["size"] for r in runs.select("size").distinct().collect())  # at most `RUN` numbers
    again = whole.join(small(met.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("words", plain(F.col("tokens")))
    every = [_runs(F.col("words"), w) for w in sizes] or [_runs(F.col("words"), RUN)]
    rows = again.select("doc_id", F.explode(F.concat(*every)).alias("x")).select(
        "doc_id", F.col("x.at").alias("pos"), F.col("x.run").alias("theirs"), F.xxhash64("x.run").alias("hash"))
    # The words are compared once for each place of the document, before the places of the items come in.
    same = rows.join(runs.select("hash", "run").distinct(), "hash").where(F.col("run") == F.col("theirs"))
    both = same.select("doc_id", "pos", "hash").join(small(runs.drop("run")), "hash")
    places = both.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    return places.join(torn, ["doc_id", "item_id", "shift"], "left_anti").select("doc_id", "item_id").distinct()


def _slot_windows(whole: DataFrame, met: DataFrame, theirs: DataFrame, owns: DataFrame,
                  widths: list[int]) -> tuple[DataFrame, DataFrame]:
    """The met windows with slots that stand in an occurrence whose slot values agree, and how many values differ there.

    Of an item without telling windows, those of an occurrence that has them all.

    Also (doc_id, item_id, shift): the occurrences whose slot values do not agree.
    """
    again = whole.join(small(met.select("doc_id").distinct()), "doc_id", "left_semi").withColumn("template", template(F.col("tokens")))
    windows = F.concat(*[_windows(w, lambda i, w=w: F.struct(
        i.alias("pos"), F.slice("template", i, w).alias("window"), F.slice("tokens", i, w).alias("theirs"))) for w in widths])
    rows = again.select("doc_id", F.explode(F.filter(windows, lambda x: _has_slot(x["window"]))).alias("x"))
    rows = rows.select("doc_id", F.xxhash64("x.window").alias("hash"), "x.window", "x.pos", "x.theirs")
    both = rows.join(theirs, "hash").join(owns, ["item_id", "at"]).where(template(F.col("own")) == F.col("window"))
    zipped = F.arrays_zip(F.col("own").alias("a"), F.col("theirs").alias("b"))
    both = both.where(F.forall(zipped, lambda p: ~p["a"].startswith(WORD) | (_bare(p["a"]) == _bare(p["b"]))))
    both = cut_lineage(both.withColumn("shift", F.col("pos") - F.col("at")).select(
        "doc_id", "item_id", "shift", "hash", "n", "whole", "own", "theirs"), "slots")
    pairs = F.transform(F.filter(zipped, lambda p: p["a"] < WORD), lambda p: F.struct(
        _bare(p["a"]).alias("a"), _bare(p["b"]).alias("b")))
    key = ["doc_id", "item_id", "shift"]
    values = both.select(*key, F.explode(pairs).alias("p")).groupBy(*key, F.col("p.a").alias("a")).agg(
        F.min("p.b").alias("least"), F.max("p.b").alias("most"))
    agreed = cut_lineage(values.groupBy(*key).agg(
        F.sum((F.col("least") != F.col("most")).cast("long")).alias("torn"),
        F.sum((F.col("least") != F.col("a")).cast("long")).alias("changed")), "occurrences")
    # An occurrence whose slots are all words has no values.
    found = both.join(agreed, key, "left").where("coalesce(torn, 0) = 0").select(
        *key, "n", "hash", "whole", F.coalesce("changed", F.lit(0)).cast("long").alias("changed"))
    full = found.where("whole").groupBy(*key, "n").agg(F.countDistinct("hash").alias("k")).where("k = n").select(*key)
    found = found.where("not whole").unionByName(found.where("whole").join(full, key, "left_semi"))
    return found.select("doc_id", "item_id", "n", "hash", "changed"), agreed.where("torn > 0").select(*key)
