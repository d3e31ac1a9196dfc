"""Benchmark decontamination by template windows, with Spark functions only.

Numbers, units after a number and capitalised words become typed slots; a second form of each text has no slots for
names, so that it doesn't depend on case. Windows of template words are hashed and joined with the benchmark's. Along one alignment of a document with an item, equal slots of the item
must hold equal values in the document and different ones different values, so the same question with other
parameters is found, and a text that only has the same shape is not. Windows that are verbatim, and long runs of
windows, are judged by themselves, so a slot elsewhere in the alignment doesn't hide them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuematch.llm.rows import packed, unpacked
from venuematch.storage import materialize

WINDOW = 8
MIN_RUN = 13
# Items of fewer words are looked for as a whole line or sentence only.
MIN_WORDS = 4
# Bits of a filter for each of its entries, and the greatest size of one: beyond, more is let through.
BITS_EACH = 64
MOST_BITS = 1 << 23

# Marks in front of a slot's value; private-use characters, taken out of the texts first.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
# Between the words of one name.
JOINED = "\ue003"
_SLOT = f"[{NUMBER}{UNIT}{NAME}]"
_LINE_END = r"[\r\n]+|(?<=[.!?])\s+"

# Units that may follow a number.
UNITS = (
    "km cm mm m mi ft in yd kg mg g lb lbs oz t l ml s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre "
    "kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton "
    "tons liter liters litre litres percent dollar dollars euro euros cent cents mph kmh hz khz mhz ghz kb mb gb tb"
).split()


def _marked(text: Column) -> Column:
    """Lower-case text without punctuation and with a mark in front of each slot's value.

    A name is a capitalised word wherever it is, or several with only blanks between them. Patterns begin with a rare
    character, so that most places of a text fail at once, and those for numbers are left out where there is none.
    """
    marks = f"{NUMBER}{UNIT}{NAME}{JOINED}"
    out = F.when(text.rlike(f"[{marks}]"), F.regexp_replace(text, f"[{marks}]", " ")).otherwise(text)
    out = F.regexp_replace(out, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})(?<!\p{L}['’]\p{Lu})(?=\p{Ll}|['’]\p{Lu}\p{Ll})", f"{NAME}$0")
    out = F.regexp_replace(out, rf"{NAME}([\p{{L}}\p{{N}}'’]+)[ \t]+(?={NAME})", f"{NAME}$1{JOINED}")
    out = F.regexp_replace(out, f"{JOINED}{NAME}", JOINED)
    counted = F.regexp_replace(out, r"\p{N}(?<![\p{L}\p{N}]\p{N})(?:[\p{N}.,]*\p{N})?", f"{NUMBER}$0")
    units = "|".join(UNITS)
    counted = F.regexp_replace(counted, rf"(\p{{N}})\s?((?i:{units})(?![\p{{L}}\p{{N}}])|%)", f"$1 {UNIT}$2")
    out = F.when(out.rlike(r"\p{N}"), counted).otherwise(out)
    return F.lower(F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}\s%{marks}]+|(?<!{UNIT})%", ""))


def _nameless(marked: Column) -> Column:
    """The same text with the words of names as they are."""
    return F.translate(marked, JOINED + NAME, " ")


def _split(text: Column) -> Column:
    """The words of a marked text; a slot is its mark followed by its value. A word of punctuation only is left out."""
    return F.array_remove(F.split(text, r"\s+"), "")


def _without_values(text: Column) -> Column:
    """A word or text cut at the first mark of each word, wherever in the word it is."""
    return F.regexp_replace(text, f"({_SLOT})\\S*", "$1")


def _word_hashes(marked: Column) -> Column:
    """Hashes of the same words, where a slot counts by its mark only."""
    return F.transform(_split(_without_values(marked)), lambda w: F.xxhash64(w))


def _windowed(texts: DataFrame, keys: list[str], window: int, short: list[int]) -> DataFrame:
    """``texts(keys, text)`` as (keys, form, words, found, singles): found has the hash of each window, in order.
    Singles has the hashes of single words, if there are ``short`` lengths below the window to look for.

    Form 0 has no names; form 1, of texts with names only, has a slot for each.

    Hashes of 1, 2, 4, ... words are each made from two of the half length. Every step uses the one before twice,
    which keeps Spark from folding them into one expression that would be evaluated again and again.
    """
    if window & (window - 1):
        raise ValueError("a window has a power of two words")
    out = texts.select(*keys, _marked(F.col("text")).alias("marked"))
    named = F.when(F.contains("marked", F.lit(NAME)), F.array(_nameless(F.col("marked")), "marked"))
    out = out.select(*keys, F.posexplode(named.otherwise(F.array("marked"))).alias("form", "marked"))
    out = out.select(*keys, "form", "marked", _word_hashes(F.col("marked")).alias("found"))
    singles = F.col("found") if short else F.lit(None).cast("array<bigint>")
    out = out.select(*keys, "form", F.when(F.size("found") > 0, _split(F.col("marked"))).alias("words"), "found", singles.alias("singles"))
    size = 1
    while size < window:
        later = F.slice("found", size + 1, F.greatest(F.size("found") - size, F.lit(0)))
        pairs = F.zip_with("found", later, lambda a, b: F.xxhash64(a, b))
        out = out.withColumn("found", F.slice(pairs, 1, F.greatest(F.size("found") - size, F.lit(0))))
        size *= 2
    return out


class _Filter:
    """Bits for hashes, two for each, as an array of longs. It may take other hashes for known ones, never the reverse.

    The array is the one row of a stored table, broadcast to where it is used. In the text of a query it would be parsed,
    planned, shown and kept by the driver at each of its places.
    """

    def __init__(self, hashes: DataFrame):
        """The size follows the number of ``hashes(hash)``, so about one unknown hash of a thousand passes."""
        distinct = hashes.distinct()
        self.bits = min(max(6, (BITS_EACH * distinct.count()).bit_length()), MOST_BITS.bit_length() - 1)
        place = F.explode(F.array(*(F.expr(f"shiftrightunsigned(hash, {32 * i}) & {(1 << self.bits) - 1}L") for i in (0, 1))))
        longs = distinct.select(place.alias("place")).select(
            F.shiftright("place", 6).alias("at"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit")
        )
        every = hashes.sparkSession.range(1 << (self.bits - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bit"))
        table = longs.union(every).groupBy("at").agg(F.bit_or("bit").alias("value"))
        in_order = F.array_sort(F.collect_list(F.struct("at", "value")))
        stored = materialize(table.agg(F.transform(in_order, lambda x: x["value"]).alias("table")), "filter")
        self.row, self.table = F.broadcast(stored), stored["table"]

    def may_hold(self, hash_: Column, table: Column) -> Column:
        """For rows joined with ``row``; ``table`` is its array, bound where many hashes are looked up."""

        def bit(shift: int) -> Column:
            place = F.shiftrightunsigned(hash_, shift)
            at = F.shiftright(place, 6).bitwiseAND((1 << (self.bits - 6)) - 1).cast("int")
            return F.getbit(F.get(table, at), place.bitwiseAND(63).cast("int")) == 1

        return bit(0) & bit(32)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _may_hold_run(text: Column, words: _Filter, pairs: _Filter, least: int) -> Column:
    """False only for texts that, marked in either form, have no ``least`` words in a row as the benchmark has them.

    It costs a part of the marking. A word is taken without its punctuation and in lower case. One with a capital, a digit
    or a per cent sign may be anything, since it may be part of a slot; so may what follows a digit, which is a word of
    its own if it is a unit. All other words are in the marked text as they are here, so each must be a word of the
    benchmark, and two neighbours must be neighbours there.
    """
    plain = F.regexp_replace(text, r"[^\p{L}\p{N}\s%]+", "")
    plain = F.regexp_replace(plain, r"(\p{N})(?:\s+|(?=[\p{L}%]))", "$1 %")
    plain = F.lower(F.regexp_replace(plain, r"[\p{N}\p{Lu}\p{Lt}]+", "%"))
    parts = F.array_remove(F.split(plain, r"\s+"), "")
    free, unknown = F.lit(0).cast("long"), F.lit(1).cast("long")
    named = lambda w, t: _bound(F.xxhash64(w), lambda h: F.when(words.may_hold(h, t), h).otherwise(unknown))
    hashes = _bound(words.table, lambda t: F.transform(parts, lambda w: F.when(F.contains(w, F.lit("%")), free).otherwise(named(w, t))))
    known = lambda a, b, t: (
        F.when((a == unknown) | (b == unknown), "0").when((a == free) | (b == free), "1")
        .when(pairs.may_hold(F.xxhash64(a, b), t), "1").otherwise("0")
    )
    follow = lambda found, t: F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: known(a, b, t))
    flags = _bound(hashes, lambda found: _bound(pairs.table, lambda t: follow(found, t)))
    run = F.contains(F.array_join(flags, ""), F.lit("1" * (least - 1)))
    odd = [F.contains(text, F.lit(mark)) for mark in (NUMBER, UNIT, NAME, JOINED)]
    return odd[0] | odd[1] | odd[2] | odd[3] | run


def _typed(words: Column) -> Column:
    return F.transform(words, _without_values)


def _consistent(slots: Column) -> Column:
    """Whether equal values of the item stand for equal ones of the document, and different for different.

    A name counts by its last word, since the one before may begin the sentence.
    """
    last = lambda v: F.substring_index(v, JOINED, -1)
    bare = lambda v: F.regexp_replace(last(v), NAME, "")
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(bare(s["i"]).alias("i"), bare(s["d"]).alias("d"))))
    different = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda s: s[side])))
    return (different("i") == F.size(pairs)) & (different("d") == F.size(pairs))


def _holds(hits: Column, window: Column) -> Column:
    """Whether the slots of ``hits(item_at, slots)`` are consistent and at least half of the words are none."""
    few = F.aggregate(hits, F.lit(0), lambda n, h: n + F.size(h["slots"])) * 2 <= F.size(hits) * window
    return few & _consistent(F.flatten(F.transform(hits, lambda h: h["slots"])))


def _run_holds(hits: Column, run: int, window: Column) -> Column:
    """The same for ``run`` windows, which have to follow one another."""
    return (F.element_at(hits, -1)["item_at"] - F.element_at(hits, 1)["item_at"] == run - 1) & _holds(hits, window)


def _short_spots(places: Column, n: int, spot) -> Column:
    return F.transform(places, lambda i: spot(F.xxhash64(F.slice("singles", i + 1, n)), i, n))


def _windows(windowed: DataFrame, keys: list[str], window: int, short: list[int], whole: bool = False, keep: _Filter | None = None) -> DataFrame:
    """(keys, hash, at, part): each window with its place and words; the filter ``keep`` chooses before they are built.

    A ``short`` length gives further windows of so many words: at each place, or if ``whole`` where these are all words.
    """
    spot = lambda h, i, n: F.struct(h.alias("hash"), i.alias("at"), F.lit(n).alias("n"))
    kept = lambda spots: _bound(keep.table, lambda t: F.filter(spots, lambda s: keep.may_hold(s["hash"], t)))
    chosen = lambda spots: spots if keep is None else kept(spots)
    spots = chosen(F.transform("found", lambda h, i: spot(h, i, window)))
    for n in short:
        fits = F.size("singles") == n if whole else F.size("singles") >= n
        places = F.when(fits, F.sequence(F.lit(0), F.size("singles") - n)).otherwise(F.array().cast("array<int>"))
        spots = F.concat(spots, chosen(_short_spots(places, n, spot)))
    with_words = F.transform(
        spots, lambda s: F.struct(s["hash"].alias("hash"), s["at"].alias("at"), F.slice("words", s["at"] + 1, s["n"]).alias("part"))
    )
    return (windowed if keep is None else windowed.crossJoin(keep.row)).select(*keys, F.inline(with_words))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, form, item_id, item_at, item_part, item_words): the windows of each different text, under its smallest item_id.

    An item of fewer words is a window as a whole.
    """
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string")).filter("text is not null")
    items = items.groupBy("text").agg(F.min("item_id").alias("item_id"))
    short = list(range(1, window))
    windowed = _windowed(items, ["item_id"], window, short).withColumn("item_words", F.size("words"))
    parts = _windows(windowed, ["item_id", "form", "item_words"], window, short, whole=True)
    return parts.select("hash", "form", "item_id", F.col("at").alias("item_at"), F.col("part").alias("item_part"), "item_words")


def _unmarked(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes (hash) of the words of windows that are no slots, and of two of them that follow each other."""
    words = known.select(F.explode("item_part").alias("word")).filter(~F.col("word").rlike(_SLOT))
    two = F.transform(F.sequence(F.lit(1), F.size("item_part") - 1), lambda i: F.slice("item_part", i, 2))
    pairs = known.filter(F.size("item_part") > 1).select(F.explode(two).alias("two")).filter(~F.exists("two", lambda w: w.rlike(_SLOT)))
    hashed = F.xxhash64(F.xxhash64(F.col("two")[0]), F.xxhash64(F.col("two")[1]))
    return words.select(F.xxhash64("word").alias("hash")), pairs.select(hashed.alias("hash"))


def passing(docs: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs(text, ...)`` whose text may hold a window of ``known``, or an item of fewer words as a whole."""
    least = known.agg(F.min(F.least(F.col("item_words"), F.lit(window)))).first()[0] or window
    words, pairs = map(_Filter, _unmarked(known))
    both = F.broadcast(words.row.crossJoin(pairs.row))
    return docs.join(both, _may_hold_run(docs["text"], words, pairs, least), "left_semi")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, min_run: int) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, same): the alignments that count, each text of a doc_id by itself."""
    known = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    keys = ["doc_id", "text_hash"]
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string"))
    usual, tiny = known.filter(F.col("item_words") >= MIN_WORDS), known.filter(F.col("item_words") < MIN_WORDS)
    lengths = lambda windows: sorted(n for n, in windows.filter(F.col("item_words") < window).select("item_words").distinct().collect())
    short = lengths(usual)
    held = _Filter(usual.select("hash"))
    windowed = _windowed(passing(texts, usual, window), keys, window, short)
    parts = _windows(windowed, [*keys, "form"], window, short, keep=held)
    met = parts.join(usual, ["form", "hash"])
    fewest = lengths(tiny)
    if fewest:
        # Each line and sentence of so few words, words with units in them included, as a text of its own.
        lines = F.filter(F.split("text", _LINE_END), lambda s: F.size(_split(s)) <= fewest[-1] * 2)
        alone = _windowed(texts.select(*keys, F.explode(lines).alias("text")), keys, window, fewest)
        met = met.union(_windows(alone, [*keys, "form"], window, fewest, whole=True).join(tiny, ["form", "hash"]))
    met = met.filter(_typed(F.col("part")) == _typed(F.col("item_part")))
    slots = F.filter(
        F.zip_with("item_part", "part", lambda i, d: F.struct(i.alias("i"), d.alias("d"))), lambda s: s["i"].rlike(_SLOT)
    )
    aligned = (
        met.select("doc_id", "text_hash", "form", "item_id", "item_words", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), slots.alias("slots"))
        .groupBy("doc_id", "text_hash", "form", "item_id", "item_words", "shift")
        .agg(F.array_sort(F.collect_set(F.struct("item_at", "slots"))).alias("hits"))
        .withColumn("n_windows", F.size("hits"))
    )
    verbatim = F.filter("hits", lambda h: F.forall(h["slots"], lambda s: s["i"] == s["d"]))
    # An item shorter than a window is one window.
    needed = F.greatest(F.least(F.lit(min_run), F.col("item_words")) - window + 1, F.lit(1))
    run = 2 * min_run - window + 1
    starts = F.when(F.col("n_windows") >= run, F.sequence(F.lit(1), F.col("n_windows") - run + 1))
    long_run = F.exists(starts, lambda i: _run_holds(F.slice("hits", i, run), run, F.lit(window)))
    same = F.size(verbatim) >= needed
    template = (F.col("n_windows") >= needed) & _holds(F.col("hits"), F.least(F.lit(window), F.col("item_words")))
    return aligned.withColumn("same", same).filter(F.col("same") | template | F.coalesce(long_run, F.lit(False)))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, item_id, n_windows, same_values): documents of ``docs(doc_id, text)`` that hold an item's question.

    A pair is returned once if along one alignment the matching windows cover ``min_run`` words (or the whole item,
    if shorter) and hold the item's own values (``same_values``), or if all that match are consistent and at least
    half of the words are no slots. Where they aren't, a run of twice ``min_run`` words that is consistent by itself
    is enough: a shorter one may well be chance. Items with equal texts count once, under their smallest item_id; an item
    of fewer than ``window`` words is looked for as a whole, and one of fewer than ``MIN_WORDS`` only where it is a whole line
    or sentence, as such a word is in many texts. Null and empty texts match nothing; repeated rows give one pair; null
    ids are returned as they are. Other columns are not read.

    Documents pass a filter made from the benchmark's neighbouring words before they are marked, and their windows one
    made from its windows; only what may match is joined, and Spark splits a hot window. The filters grow with the
    benchmark up to ``MOST_BITS`` and may let too much through, never too little. Stores the benchmark's windows in the
    shared folder.
    """
    hits = _hits(docs, benchmark, window, min_run)
    return hits.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("same").alias("same_values")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document holds a benchmark item; all other columns are kept, whatever their names."""
    hits = _hits(docs.select("doc_id", "text"), benchmark, WINDOW, MIN_RUN)
    hits = hits.select(F.struct(F.col("doc_id"), F.col("text_hash")).alias("hit")).distinct()
    hits = materialize(hits, "contaminated").select("hit.doc_id", "hit.text_hash")
    row = packed(docs)
    same = row["row.doc_id"].eqNullSafe(hits["doc_id"]) & (F.xxhash64(row["row.text"].cast("string")) == hits["text_hash"])
    return unpacked(row.join(hits, same, "left_anti"))
