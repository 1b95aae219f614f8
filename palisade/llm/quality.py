"""Quality rules: distribution divergence against language references, by DataFrame functions alone.

For each document two histograms are built: character classes, and the common words of its language. Both are
compared by Jensen-Shannon distance with the reference of the language, which is the median share
of each class or word among all documents of that language (statistics over the whole corpus, which junk pages
move little; one row per known language, so it is small by construction). Short documents pass the distance rules, because short histograms are noise.

Defined results: a null text is an empty one (all counts 0, base_failed true); an empty table gives an empty
result; repeated rows are judged row by row, each alike; an unknown or null language is compared with the pooled
character reference and has no word rule; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import stored

# Common words of each known language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "with", "for", "it", "a", "be"],
    "fr": ["de", "la", "le", "et", "les", "des", "que", "en", "un", "une", "est", "pour"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ein", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"],
}
POOLED = "*"
CLASSES = ("letter", "upper", "digit", "space", "punctuation", "symbol")
SPACE = "[\\x20\\x09-\\x0D]"

#: Thresholds on the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) and the minimum lengths.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS, MIN_COMMON = 0.20, 0.35, 100, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def window_hashes(words: Column, doublings: int) -> Column:
    """Hashes of all runs of 2**doublings consecutive words; each doubling joins two runs end to end."""
    def doubled(width: int) -> Callable[[Column], Column]:
        def join(h: Column) -> Column:
            pairs = F.zip_with(F.slice(h, F.lit(1), F.size(h) - width), F.slice(h, F.lit(width + 1), F.size(h)), lambda a, b: F.xxhash64(a, b))
            return F.when(F.size(h) > width, pairs).otherwise(F.slice(h, 1, 0))

        return join

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in range(doublings):
        hashes = let(hashes, doubled(1 << step))
    return hashes


def repeated_window_words(words: Column) -> Column:
    """Number of words that stand in an eight-word window found at least twice in the text."""
    width = 8

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def repeated(ordered: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(ordered) - 1)
        same = lambda k, j: F.coalesce(F.get(ordered, j)["h"] == F.get(ordered, k)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(at, lambda k: same(k, k - 1) | same(k, k + 1)), lambda k: F.get(ordered, k)["i"]))

    def count(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ordered, repeated), covered))

    return let(window_hashes(words, 3), count)


def histograms(text: Column, lang: Column) -> Column:
    """Struct of counts: n_words, word_chars, chars (by class) and common (by common word, then all other words)."""
    known = F.coalesce(lang.isin(*COMMON_WORDS), F.lit(False))
    listed = F.lit(None).cast("array<string>")
    for code, words in COMMON_WORDS.items():
        listed = F.when(lang == code, F.array(*map(F.lit, words))).otherwise(listed)

    def common(words: Column, names: Column) -> Column:
        hits = F.filter(words, lambda w: F.array_contains(names, w))
        counts = let(hits, lambda found: F.transform(names, lambda name: F.size(found) - F.size(F.array_remove(found, name))))
        return let(counts, lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0), lambda a, b: a + b))))

    n_chars = F.length(text)
    word_chars = F.length(F.regexp_replace(text, SPACE + "+", ""))
    upper, digit = F.regexp_count(text, F.lit("[A-Z]")), F.regexp_count(text, F.lit("[0-9]"))
    punctuation, symbol = F.regexp_count(text, F.lit("[.,;:!?'\"()-]")), F.regexp_count(text, F.lit("[#*$%&|<>@=+/\\\\^~_{}\\[\\]`]"))
    return F.struct(
        word_chars.cast("long").alias("word_chars"),
        F.array(n_chars, upper, digit, n_chars - word_chars, punctuation, symbol).alias("raw"),
        F.when(known, let(split_words(F.lower(text)), lambda w: common(w, listed))).alias("common"),
        F.when(known, lang).otherwise(F.lit(POOLED)).alias("language"),
    )


def class_counts(raw: Column) -> Column:
    """Letters are what is left of all characters."""
    return F.transform(raw, lambda x, i: F.when(i == 0, x - raw[1] - raw[2] - raw[3] - raw[4] - raw[5]).otherwise(x))


def shares(counts: Column) -> Column:
    return let(F.aggregate(F.transform(counts, lambda c: c.cast("double")), F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(counts, lambda c: F.try_divide(c.cast("double"), total)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2), F.lit(0.0), lambda a, b: a + b)))


def references(measured: DataFrame, mark: str) -> DataFrame:
    """(language, chars_ref, words_ref) from measures (column `mark`): median shares over all documents of MIN_WORDS words or more."""
    rows = measured.where(F.col(f"{mark}.words.n_words") >= MIN_WORDS).select(F.col(f"{mark}.h").alias("h"))
    rows = rows.select(F.col("h.language").alias("language"), shares(class_counts(F.col("h.raw"))).alias("c"), shares(F.col("h.common")).alias("w"))
    width = 1 + max(map(len, COMMON_WORDS.values()))
    middle = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(1000))
    sums = [middle(F.col("c")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [middle(F.col("w")[i]).alias(f"w{i}") for i in range(width)]
    both = rows.select(F.explode(F.array_distinct(F.array("language", F.lit(POOLED)))).alias("language"), "c", "w")
    medians = both.groupBy("language").agg(*sums)
    chars, words = (shares(F.array(*[f"{c}{i}" for i in range(n)])) for c, n in (("c", len(CLASSES)), ("w", width)))
    return medians.select("language", chars.alias("chars_ref"), F.when(F.col("language") != POOLED, words).alias("words_ref"))


def measure(docs: DataFrame, mark: str) -> DataFrame:
    """docs with a struct column `mark` of counts; a text is read for them once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return docs.withColumn(
        mark,
        F.struct(
            let(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).cast("long").alias("n_repeat_words"))).alias("words"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            histograms(text, F.col("lang")).alias("h"),
        ),
    )


def judge(measured: DataFrame, mark: str, into: str = "quality") -> DataFrame:
    """Measured rows (column `mark`, in a table: it is read twice) with a struct column `into` in its place: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept."""
    refs = references(measured, mark).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("language", F.struct("chars_ref", "words_ref")))).alias("refs"))
    side = refs.withColumnRenamed("refs", f"{mark}_refs")  # one row: at most one entry per known language
    got = measured.join(F.broadcast(side), how="left")
    m, h = (lambda name: F.col(f"{mark}.{name}")), (lambda name: F.col(f"{mark}.h.{name}"))
    ref = F.coalesce(F.element_at(F.col(f"{mark}_refs"), h("language")), F.element_at(F.col(f"{mark}_refs"), F.lit(POOLED)))
    n_words, n_repeat = m("words.n_words"), m("words.n_repeat_words")
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    chars = F.when(n_words >= MIN_WORDS, distance(shares(class_counts(h("raw"))), ref["chars_ref"]))
    n_common = F.aggregate(h("common"), F.lit(0), lambda a, b: a + b)
    words = F.when((n_words >= MIN_WORDS) & (n_common >= MIN_COMMON), distance(shares(h("common")), ref["words_ref"]))
    got = got.withColumn(f"{mark}_d", F.struct(chars.alias("chars"), words.alias("words")))
    strange = F.coalesce(F.col(f"{mark}_d.chars") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col(f"{mark}_d.words") > MAX_WORD_DISTANCE, F.lit(False))
    result = F.struct(
        n_words.alias("n_words"), h("word_chars").alias("word_chars"), m("n_symbols").alias("n_symbols"), m("n_dup_lines").alias("n_dup_lines"), n_repeat.alias("n_repeat_words"),
        F.col(f"{mark}_d.chars").alias("char_distance"), F.col(f"{mark}_d.words").alias("word_distance"), base_failed.alias("base_failed"), (~base_failed & ~strange).alias("kept"),
    )
    return got.withColumn(into, result).drop(mark, f"{mark}_refs", f"{mark}_d")


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: the counts, both distances and the verdict. Texts are measured once; the counts are stored."""
    mark = "__measures"
    counts = stored(measure(docs.select("doc_id", "text", "lang"), mark).drop("text"), "quality-measures")
    return judge(counts, mark).select("doc_id", "quality.*")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. Documents are stored with their counts, so texts are measured once."""
    mark, into = "__palisade_measures", "__palisade_quality"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", "lang")
    counts = stored(measure(rows, mark).select("row", mark), "quality-measures")
    return judge(counts, mark, into).where(F.col(f"{into}.kept")).select("row.*")
