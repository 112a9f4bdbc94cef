"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, a run of one kind a single one; windows of template tokens are
hash-joined; the words that stand in matching placeholders count where they are equal or correspond one to one, so that a
question with other numbers and names is still caught. What windows at neighbouring shifts cover is added up, as a copy with words put in or
left out goes on at another shift. Items shorter than a window are looked up at their own lengths; words are joined as they
are where a template has too few literals. In scripts without blanks each character is a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, let, table, words

WINDOW = 8  # template tokens in a window
LITERALS = 3  # of them at least so many that are no placeholders
COVER = 0.5  # share of an item's coverable words that makes a document contaminated
QUOTE = 32  # so many covered words of an item do so too, however long the item is

# Measuring units and number words.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "ms", "min", "h", "hr", "hz", "khz", "mhz", "v", "w", "kw", "kb", "mb", "gb", "meter", "meters", "metre", "metres", "mile", "miles", "inch", "inches", "feet", "gram", "grams", "liter", "liters", "litre", "litres", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week", "weeks", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million")
MARKS = "<num>", "<name>", "<unit>"
EDGES = ".,;:!?\"'()[]{}"
# Thai, Lao, Burmese, Khmer, kana and Han characters.
UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U000323af]"


def _kind(ws: Column, bares: Column, lows: Column, i: Column, values: tuple, otherwise) -> Column:
    """values[0] for a number, [1] for a name, [2] for a unit at place i; else otherwise(the lower-cased word).

    The cheap tests come first, as most words begin with a small letter and are neither number nor unit.
    """
    bare, low, before = F.get(bares, i), F.get(lows, i), F.get(ws, i - 1)
    digit = (bare >= "0") & (bare < ":")
    signed = ((bare < "0") | (bare >= "\u00a3")) & F.rlike(bare, F.lit(r"^[$€£+-]+\d"))
    unit = low.isin(*UNITS) & before.isNotNull() & F.rlike(before, F.lit(r"^[$€£+-]?\d[\d.,]*$"))
    first = F.substring(bare, 1, 1)
    name = (bare != low) & before.isNotNull() & (first != F.lower(first)) & ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
    return F.when(digit | signed | low.isin(*NUMBERS), values[0]).when(unit, values[2]).when(name, values[1]).otherwise(otherwise(low))


def _spaced(text: Column) -> Column:
    """The text with blanks around characters of scripts that have none, and in the place of their punctuation.

    The cheap tests come first, as most texts are ASCII or have no character of these ranges.
    """
    may = (F.octet_length(text) > F.char_length(text)) & F.rlike(text, F.lit("[\u0e00-\U000323af]"))
    return F.when(may, F.regexp_replace(text, f"({UNSPACED})|[，。！？；：、（）《》「」『』]", " $1 ")).otherwise(text)


def _each_word(text: Column, body) -> Column:
    """body(words, bare words, lower-cased bare words), each array computed once."""
    bare = lambda ws: F.transform(ws, lambda w: F.btrim(w, F.lit(EDGES)))
    return let(let(_spaced(text), words), lambda ws: let(bare(ws), lambda bares: let(F.transform(bares, F.lower), lambda lows: body(ws, bares, lows))))


def canonical_tokens(text: Column) -> Column:
    """array of (raw, tmpl, at, n): each word lower-cased and without punctuation at its ends, and what the template has in its place.

    <num>: digits with separators, sign, percent or currency sign, a number with its unit attached, or a number word.
    <unit>: a unit word right after a number. <name>: a word with a capital that does not begin a sentence. A run of equal
    placeholders is one token. at, n: the first of a token's words, by number, and how many they are.
    """

    def tokens(ws: Column, bares: Column, lows: Column) -> Column:
        one = lambda low, i: F.struct(low.alias("raw"), _kind(ws, bares, lows, i, MARKS, lambda x: x).alias("tmpl"))
        return F.filter(F.transform(lows, one), lambda t: t["raw"] != "")

    def runs(ts: Column) -> Column:
        begins = lambda t, i: (i == 0) | ~t["tmpl"].isin(*MARKS) | (t["tmpl"] != F.get(ts, i - 1)["tmpl"])
        starts = F.array_compact(F.transform(ts, lambda t, i: F.when(begins(t, i), i)))

        def token(at: Column, n: Column) -> Column:
            raw = F.array_join(F.transform(F.slice(ts, at + 1, n), lambda t: t["raw"]), " ")
            return F.struct(raw.alias("raw"), F.get(ts, at)["tmpl"].alias("tmpl"), at.alias("at"), n.alias("n"))

        return let(starts, lambda x: F.transform(x, lambda at, k: token(at, F.coalesce(F.get(x, k + 1), F.size(ts)) - at)))

    return let(_each_word(text, tokens), runs)


def _template_hashes(ws: Column, bares: Column, lows: Column) -> Column:
    """A number for each of canonical_tokens; its low four bits say whether the token is a literal (1) or a placeholder (0)."""
    literal = lambda low: F.xxhash64(low).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(1).cast("long"))
    marks = tuple(F.lit(16 * (k + 1)).cast("long") for k in range(len(MARKS)))
    hashes = F.array_compact(F.transform(lows, lambda low, i: F.when(low != "", _kind(ws, bares, lows, i, marks, literal))))
    begins = lambda h: lambda x, i: (x.bitwiseAND(F.lit(1)) == 1) | (i == 0) | (x != F.get(h, i - 1))
    return let(hashes, lambda h: F.filter(h, begins(h)))


def _word_hashes(lows: Column) -> Column:
    """The like for each word as it is; all are literals."""
    return F.array_compact(F.transform(lows, lambda low: F.when(low != "", F.xxhash64(F.lit(1), low).bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(1).cast("long")))))


def _windows(h: Column, length: int, literals: int) -> Column:
    """array of (pos, key) of every window of `length` tokens that has enough literal ones.

    Windows are hashed by doubling: the hash of 2n tokens comes from those of two times n, and one more token is added where
    the length is odd. The low four bits carry the sum of the literals along, so length is at most 15.
    """
    both = lambda x, y: F.xxhash64(x, y).bitwiseAND(F.lit(-16)).bitwiseOR(x.bitwiseAND(F.lit(15)) + y.bitwiseAND(F.lit(15)))

    def wide(n: int) -> Column:
        if n == 1:
            return h
        m = n - 1 if n % 2 else n // 2

        def longer(x: Column) -> Column:
            rest = F.greatest(F.size(x) - F.lit(n - m), F.lit(0))
            return F.zip_with(F.slice(x, F.lit(1), rest), F.slice(h if n % 2 else x, F.lit(m + 1), rest), both)

        return let(wide(m), longer)

    return F.array_compact(F.transform(wide(length), lambda x, i: F.when(x.bitwiseAND(F.lit(15)) >= literals, F.struct(i.alias("pos"), x.alias("key")))))


def _whole(h: Column, window: int) -> Column:
    """A text shorter than a window as one key, however few its literals; it equals another whole text only."""
    one = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(h, F.size(h)).alias("key")))
    return F.when((F.size(h) > 0) & (F.size(h) < window), one).otherwise(F.slice(one, 1, 0))


def _own_windows(h: Column, window: int, literals: int) -> Column:
    """The windows of an item: of its own length where it is shorter than a window."""
    found = _windows(h, window, literals)
    for n in range(1, window):
        found = F.when(F.size(h) == n, _windows(h, n, literals)).otherwise(found)
    return found


def item_windows(text: Column, window: int = WINDOW) -> Column:
    """(template, words): windows of the template, and of the words as they are."""
    both = lambda h, r: F.struct(F.concat(_whole(h, window), _own_windows(h, window, LITERALS)).alias("template"), _own_windows(r, window, 1).alias("words"))
    return _each_word(text, lambda ws, bares, lows: let(_template_hashes(ws, bares, lows), lambda h: let(_word_hashes(lows), lambda r: both(h, r))))


def document_windows(text: Column, lengths: list[int], word_lengths: list[int], window: int = WINDOW) -> Column:
    """array of (pos, key) of the windows of these lengths: of the template, and of the words as they are."""
    short = [n for n in lengths if n < window]

    def of_template(h: Column) -> Column:
        parts = [_windows(h, n, LITERALS) for n in short]
        longer = [_windows(h, window, LITERALS)] + parts
        return F.when(F.size(h) < window, F.concat(_whole(h, window), *parts)).otherwise(F.concat(*longer) if parts else longer[0])

    of_words = lambda r: F.concat(*[_windows(r, n, 1) for n in word_lengths])

    def found(ws: Column, bares: Column, lows: Column) -> Column:
        template = let(_template_hashes(ws, bares, lows), of_template)
        return F.concat(template, let(_word_hashes(lows), of_words)) if word_lengths else template

    return _each_word(text, found)


def _under(at: Column, window: int, size: Column) -> Column:
    """The places of the tokens under windows that begin at the places `at`, of a text of `size` tokens."""
    return F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, F.least(p + F.lit(window - 1), size - 1)))))


def _words_of(places: Column, tokens: Column) -> Column:
    """The numbers of the words in the tokens at these places."""
    return F.flatten(F.transform(places, lambda p: let(F.get(tokens, p), lambda t: F.sequence(t["at"], t["at"] + t["n"] - 1))))


def template_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """rid (see keyed), item_id, shift, as_is, n_windows, words, item_size, coverable: documents that share windows with an item at a shift.

    docs: rid, text. benchmark: item_id, text; equal items are items of their own, null and blank ones match nothing.
    shift: the document's word, by number, at which the item would begin. words: the item's words, by number, under shared
    windows, of placeholders those whose words are equal in both texts or map one to one at this shift. coverable: how many
    words are under any of the item's template windows. as_is: the windows are of the words as they are. Items have those
    where template windows leave words out (few literals) or there is but one; documents have windows of the items' lengths
    only, which are `window` and less. Only (rid, pos, key) of the documents is joined, so document windows are not shuffled where Spark's size check
    lets the benchmark's windows be broadcast; one row per key holds all its places. The ids of documents that share a window
    are stored, so that where they are few enough to be broadcast, only the texts of these documents are shuffled and sorted.
    """
    scratch = scratch or Scratch(docs.sparkSession, "decontam")
    items = benchmark.select("item_id", canonical_tokens(F.col("text")).alias("item_tokens"), item_windows(F.col("text"), window).alias("_wins"))
    coverable = F.size(_words_of(_under(F.transform("_wins.template", lambda w: w["pos"]), window, F.size("item_tokens")), F.col("item_tokens")))
    items = items.withColumn("coverable", coverable).withColumn("item_size", F.aggregate("item_tokens", F.lit(0), lambda n, t: n + t["n"]))
    in_words = (F.col("coverable") < F.col("item_size")) | (F.size("item_tokens") <= window)
    items = scratch.save(items.select("item_id", "item_tokens", "coverable", "item_size", F.col("_wins.template").alias("_template"), F.when(in_words, F.col("_wins.words")).alias("_words")), "items")
    own = lambda wins, size: F.sort_array(F.collect_set(F.when(F.size(wins) > 0, F.least(F.lit(window), size))))
    lengths, word_lengths = items.agg(own("_template", F.size("item_tokens")), own("_words", F.col("item_size"))).first()
    flagged = lambda wins, as_is: items.select("item_id", F.lit(as_is).alias("as_is"), F.inline(wins))
    wins = flagged("_template", False).unionByName(flagged("_words", True))
    places = wins.groupBy("key").agg(F.collect_list(F.struct("item_id", "as_is", F.col("pos").alias("item_pos"))).alias("places"))
    found = (
        docs.select("rid", F.inline(document_windows(F.col("text"), lengths, word_lengths, window)))
        .join(places, "key")
        .select("rid", "pos", F.inline("places"))
        .groupBy("rid", "item_id", "as_is", (F.col("pos") - F.col("item_pos")).alias("step"))
        .agg(F.sort_array(F.collect_set("item_pos")).alias("at"))
    )
    found = scratch.save(found, "found")
    by_doc = found.groupBy("rid").agg(F.collect_list(F.struct("item_id", "as_is", "step", "at")).alias("hits"))
    named = scratch.save(found.select("rid").distinct(), "named")
    texts = docs.select("rid", "text").join(named, "rid", "left_semi")
    hits = by_doc.join(texts, "rid").select("rid", canonical_tokens(F.col("text")).alias("tokens"), "hits").select("rid", "tokens", F.inline("hits"))
    both = hits.join(items.select("item_id", "item_tokens", "item_size", "coverable"), "item_id").withColumn("under", _under(F.col("at"), window, F.when(F.col("as_is"), F.col("item_size")).otherwise(F.size("item_tokens"))))
    item_token, doc_token = lambda p: F.get(F.col("item_tokens"), p), lambda p: F.get(F.col("tokens"), p + F.col("step"))
    marks = F.filter("under", lambda p: item_token(p)["tmpl"].isin(*MARKS))
    slots = F.array_distinct(F.transform(marks, lambda p: F.struct(item_token(p)["raw"].alias("a"), doc_token(p)["raw"].alias("b"))))
    fits = lambda x, s: (x["a"] == x["b"]) | (F.size(F.filter(s, lambda y: (x["a"] == y["a"]) | (x["b"] == y["b"]))) == 1)
    both = both.withColumn("fitting", let(slots, lambda s: F.transform(F.filter(s, lambda x: fits(x, s)), lambda x: x["a"])))
    counted = F.filter("under", lambda p: ~item_token(p)["tmpl"].isin(*MARKS) | F.array_contains("fitting", item_token(p)["raw"]))
    first = F.get("at", F.lit(0))
    return both.select(
        "rid",
        "item_id",
        F.when(F.col("as_is"), F.col("step")).otherwise(doc_token(first)["at"] - item_token(first)["at"]).alias("shift"),
        "as_is",
        F.size("at").alias("n_windows"),
        F.when(F.col("as_is"), F.col("under")).otherwise(_words_of(counted, F.col("item_tokens"))).alias("words"),
        "item_size",
        "coverable",
    )


def item_covers(matches: DataFrame, window: int = WINDOW) -> DataFrame:
    """rid, item_id, covered, share: how many words of an item a document holds in one place, at best, and the share: of all words, or of
    those that template windows cover where that is more.

    A place is all shifts less than the item's length and a window apart: a copy may be stretched to twice the item. Shifts
    are dealt to stretches of twice that width which overlap by half, so that each such set is whole in one of them.
    """
    nth = F.floor(F.col("shift") / (F.col("item_size") + window))
    words = matches.select("rid", "item_id", "as_is", "item_size", "coverable", F.explode(F.array(nth - 1, nth)).alias("stretch"), "words").withColumn("word", F.explode("words"))
    sizes = [F.first(c).alias(c) for c in ("item_size", "coverable")]
    distinct = words.groupBy("rid", "item_id", "stretch", "word").agg(F.max(F.when(F.col("as_is"), 0).otherwise(1)).alias("in_template"), *sizes)
    covered = distinct.groupBy("rid", "item_id", "stretch").agg(F.count("*").alias("covered"), F.sum("in_template").alias("in_template"), *sizes)
    share = F.greatest(F.col("covered") / F.col("item_size"), F.when(F.col("coverable") > 0, F.col("in_template") / F.col("coverable")))
    return covered.groupBy("rid", "item_id").agg(F.max("covered").alias("covered"), F.max(share).alias("share"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, quote: int = QUOTE) -> DataFrame:
    """doc_id, rid, n_items, item_ids, best_cover, contaminated of every row of docs (doc_id, text).

    A document is contaminated by an item where shared windows in one place (see item_covers) have a share of at least
    `cover` or cover at least `quote` words. An item shorter than a window is held where all of it stands. Null, empty and blank texts share nothing; repeated rows and ids
    keep a row each; an empty benchmark contaminates nothing. Items are rows: those with a null or a repeated item_id are
    items of their own; item_ids holds each id once.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    rows, _ = keyed(docs, scratch)
    ids = benchmark.schema["item_id"].dataType.simpleString()
    items, same = keyed(benchmark.select(F.col("item_id").alias("doc_id"), "text"), Scratch(docs.sparkSession, "benchmark"))
    shared = item_covers(template_matches(rows, items.select(F.col("rid").alias("item_id"), "text"), window, scratch), window)
    named = shared.withColumnRenamed("item_id", "_item")
    if same:
        named = named.withColumn("item_id", F.col("_item").cast(ids))
    else:
        named = named.join(items.select(F.col("rid").alias("_item"), F.col("doc_id").alias("item_id")), "_item")
    held = (F.col("share") >= cover) | (F.col("covered") >= quote)
    found = F.sort_array(F.collect_set(F.when(held, F.struct("item_id"))))
    per_doc = named.groupBy("rid").agg(F.transform(found, lambda x: x["item_id"]).alias("item_ids"), F.max("share").alias("best_cover"))
    return (
        rows.select("rid", "doc_id")
        .join(per_doc, "rid", "left")
        .withColumn("item_ids", F.coalesce("item_ids", F.array().cast(f"array<{ids}>")))
        .select("doc_id", "rid", F.size("item_ids").alias("n_items"), "item_ids", F.round(F.coalesce("best_cover", F.lit(0.0)), 6).alias("best_cover"))
        .withColumn("contaminated", F.col("n_items") > 0)
    )


def op10_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("rid")
