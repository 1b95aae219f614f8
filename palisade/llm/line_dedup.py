"""Line dedup by a segment-partition edit join, with DataFrame functions alone.

A line goes if it repeats an earlier line exactly, or if some earlier line lies within EDITS edits of it (lines of at
least MIN_CHARS characters, so that two edits are a tenth of the line at most; "earlier" is by doc_id, then the text's
hash, then line number, and compares the lines' first places). Distinct lines are cut into EDITS + 1 segments. If two
lines lie within EDITS edits, one of them holds a segment of the other, at a place that the edits to its left and right
can explain, so a line of length L probes the segments of lines of lengths L - EDITS to L with the substrings of those
few places (Li et al., Pass-Join, 2011). Lines that meet are verified by a banded bit-parallel edit distance: the
band's vertical differences are two bit vectors of 2 * EDITS + 1 bits, and one step for each character updates all of
the band (Myers 1999, Hyyro 2003).

Equal lines are one line before anything is compared, so a line that a third of the documents share costs one row.
What is asked is whether an earlier near line exists, not for pairs. A segment that more than two lines own
(copies with a word changed) is therefore never expanded into pairs: each of its lines is compared with the earliest
one first, and lines that are near it are answered. The owners of the segment then stand in blocks of about BLOCK
rows, a line meets a block, and only those of the block leave that could be near by two tests, for any alphabet: an edit
changes the parity of at most two letter counts, and in crowds of over BLOCK lines that of at most four counts of
neighbouring letters, both counted in slots of a word of 64 bits. So rows grow with lines, and with pairs that pass the
tests, which lines of one crowd hardly do unless they are near. (The bits themselves are compared pair by pair, spread over the blocks.)

Defined results: each row of the input has its row in the report; a null, empty or blank text has no lines; lines
without a word are not counted, never removed and never compared; rows with a null doc_id are left alone and compared
with none; rows with one doc_id and different texts are documents of their own, in order of the texts' hashes; rows
with one doc_id and equal texts are one document, and each gets its result; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.quality import let
from palisade.session import stored

EDITS, MIN_CHARS = 2, 20
#: Owners of a crowded segment in a block.
BLOCK = 64
WORD = "[^\\x20\\x09-\\x0D]"
#: Characters whose counts' parities are compared.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 ,.ABDEHIMORST"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): rows with one doc_id are told apart by their texts' hashes."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, key) of lines with a word, of rows with a doc_id; key is the line's 64-bit hash."""
    lines = rows.where("doc_id IS NOT NULL").select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD)).withColumn("key", F.xxhash64("line"))


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of edits + 1 nearly equal ones: the longer ones come last."""
    short = F.lit(edits + 1) - F.pmod(length, F.lit(edits + 1))
    base = F.floor(length / (edits + 1)).cast("int")
    return F.lit(1) + base * i + F.greatest(F.lit(0), F.lit(i) - short), base + F.when(F.lit(i) >= short, 1).otherwise(0)


def stored_segments(line: Column, n: Column, edits: int) -> Column:
    return F.array(*[F.xxhash64(n, F.lit(i), F.substring(line, *segment(n, i, edits))) for i in range(edits + 1)])


def probes(line: Column, n: Column, edits: int) -> Column:
    """Hashes of the substrings that segment i of a line shorter by `less` can equal (multi-match-aware places)."""
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            start, size = segment(n - less, i, edits)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                at = start + shift
                out.append(F.when((at >= 1) & (at + size - 1 <= n), F.xxhash64(n - less, F.lit(i), F.substring(line, at, size))))
    return F.array_distinct(F.array(*out))


def parities(line: Column) -> Column:
    """A bit for each of LETTERS: whether the line holds it an odd number of times (all are of one byte)."""
    n = F.octet_length(line)
    bits = [F.shiftleft((n - F.octet_length(F.replace(line, F.lit(c)))).cast("long").bitwiseAND(F.lit(1)), i) for i, c in enumerate(LETTERS)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    # Letters beyond ASCII are dealt to the slots by their hash; a slot's bit turns over with each of them.
    other = F.regexp_extract_all(line, F.lit("[^\\x00-\\x7F]"), F.lit(0))
    return F.when(n == F.length(line), total).otherwise(total.bitwiseXOR(turned(other, lambda c: F.xxhash64(c))))


def turned(items: Column, hashed: Callable[[Column], Column]) -> Column:
    """64 bits, each turned over as often as an item's hash falls on it."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed(x), F.lit(64)).cast("int"))
    return F.aggregate(items, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(one(x)))


def neighbours(line: Column) -> Column:
    """64 bits of the parities of pairs of neighbouring letters (the last letter stands alone). An edit turns over four at most:
    one that replaces a letter takes two pairs and brings two."""

    def bits(letters: Column) -> Column:
        pairs = F.zip_with(letters, F.slice(letters, F.lit(2), F.size(letters)), lambda a, b: F.xxhash64(a, b))
        return turned(pairs, lambda h: h)

    return let(F.split(line, ""), bits)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings lie within `edits` edits, by a banded bit-parallel edit distance.

    Bit r of the vectors stands for row j - edits + r of column j. With the longer string down the rows, the cell that
    ends in the last row and column lies on one diagonal of the band; the distance grows by one where that diagonal's
    bit of `zero` (cells equal to their upper left neighbour) is not set."""
    every, top = (1 << (2 * edits + 1)) - 1, F.length(a) >= F.length(b)

    def run(pair: Column) -> Column:
        rows, columns = pair["rows"], pair["columns"]
        more = F.size(rows) - F.size(columns)
        diagonal = F.call_function("shiftleft", F.lit(1), F.least(more, F.lit(edits)) + edits)

        def step(state: Column, j: Column) -> Column:
            letter = F.get(columns, j)
            match = F.lit(0)
            for r in range(2 * edits + 1):
                match = match + F.when(F.get(rows, j + (r - edits)) == letter, 1 << r).otherwise(0)
            plus, minus = state["plus"], state["minus"]

            def update(x: Column) -> Column:
                zero = ((x.bitwiseAND(plus) + plus).bitwiseXOR(plus)).bitwiseOR(x).bitwiseOR(minus).bitwiseAND(F.lit(every))

                def vertical(zero: Column) -> Column:
                    across_up = minus.bitwiseOR(F.bitwise_not(zero.bitwiseOR(plus)).bitwiseAND(F.lit(every)))
                    across_down, down = zero.bitwiseAND(plus), F.shiftright(zero, 1)
                    return F.struct(
                        across_down.bitwiseOR(F.bitwise_not(down.bitwiseOR(across_up)).bitwiseAND(F.lit(every))).alias("plus"), down.bitwiseAND(across_up).alias("minus"),
                        (state["errors"] + F.when(zero.bitwiseAND(diagonal) == 0, 1).otherwise(0)).alias("errors"),
                    )

                return let(zero, vertical)

            # Columns after the last allowed error are not worked out.
            return F.when(state["errors"] > edits, state).otherwise(let(match, update))

        start = F.struct(F.lit(every >> edits << edits).alias("plus"), F.lit(0).alias("minus"), more.alias("errors"))
        steps = F.when(F.size(columns) > 0, F.sequence(F.lit(0), F.size(columns) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda s: s["errors"] <= edits)

    letters = lambda s: F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))
    pair = F.struct(letters(F.when(top, a).otherwise(b)).alias("rows"), letters(F.when(top, b).otherwise(a)).alias("columns"))
    return (F.abs(F.length(a) - F.length(b)) <= edits) & F.coalesce(let(pair, run), F.lit(False))


def hashed(lines: DataFrame, marks: Callable[[Column, Column, int], Column], edits: int, name: str) -> DataFrame:
    """(h, name): the hashes of each distinct line with its key. Equal lines meet by key, so only hashes are shuffled, not lines."""
    # The length is a column of its own: it is used many times, and counting characters reads the whole line.
    once = lines.select("key", marks(F.col("line"), F.col("n"), edits).alias("marks")).groupBy("key").agg(F.any_value("marks").alias("marks"))
    return once.select(F.explode("marks").alias("h"), F.col("key").alias(name)).where("h IS NOT NULL")


def texts_of(rows: DataFrame, wanted: DataFrame, edits: int) -> DataFrame:
    """(key, place, line, n, letters, segments) of the wanted (key, place): each line is read where it stands first."""
    by_row = wanted.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.text_key").alias("text_key")).agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
    # The wanted lines grow with the documents: both sides are dealt by row at every size, and none is broadcast.
    found = rows.join(stored(by_row, "line-places").hint("merge"), ["doc_id", "text_key"]).select(let(F.split("text", "\n"), lambda parts: F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), w["place"].alias("place"), F.get(parts, w["place"]["line_no"]).alias("line")))).alias("found"))
    # Equal texts of one doc_id are one document: the same line comes from each of its rows.
    lines = found.select(F.explode("found").alias("x")).select("x.*").dropDuplicates(["key"])
    measured = lines.select("*", F.length("line").alias("n"), parities(F.col("line")).alias("letters"))
    return stored(measured.withColumn("segments", stored_segments(F.col("line"), F.col("n"), edits)), "line-texts")


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(key): of each pair (a, b) within `edits` edits, the line that stands later."""
    of = lambda c, *names: texts.select(F.col("key").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in names])
    like = (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2 * edits) & (F.abs(F.col("n_a") - F.col("n_b")) <= edits)
    hopeful = pairs.distinct().join(of("a", "letters", "n", "place"), "a").join(of("b", "letters", "n", "place"), "b").where(like).select("a", "b", "place_a", "place_b")
    near = hopeful.join(of("a", "line"), "a").join(of("b", "line"), "b").where(within(F.col("line_a"), F.col("line_b"), edits))
    return near.select(F.when(F.col("place_a") > F.col("place_b"), F.col("a")).otherwise(F.col("b")).alias("key")).distinct()


def near_lines(rows: DataFrame, lines: DataFrame, firsts: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Keys of lines that have an earlier line within `edits` edits."""
    long = lines.withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    # A group is its size, least and greatest owner: a group of two is whole, a larger one is a crowd. One row for each line that probes it.
    groups = hashed(long, stored_segments, edits, "a").groupBy("h").agg(F.count("*").alias("owners"), F.min("a").alias("low"), F.max("a").alias("high"))
    met = hashed(long, probes, edits, "b").join(groups, "h").where("NOT (low = b AND high = b)")
    met = stored(met, "line-meetings")
    small, crowds = met.where("owners <= 2"), met.where("owners > 2").select("h", "b", "owners")
    pairs = small.select("b", F.explode(F.array("low", "high")).alias("a")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(crowds.select(F.col("b").alias("key"))).distinct()
    texts = texts_of(rows, stored(wanted.join(firsts.select("key", "place"), "key"), "line-wanted"), edits)

    pairs_of = F.when(F.col("owners") > BLOCK, neighbours(F.col("line"))).otherwise(F.lit(0).cast("long")).alias("pairs")
    of_line = texts.select(F.col("key").alias("b"), "place", "n", "letters", "segments", "line")
    members = crowds.join(of_line, "b").select("h", "b", "owners", "place", "n", "letters", pairs_of, F.array_contains("segments", F.col("h")).alias("owns"))
    members = stored(members, "line-crowds")
    earliest = stored(members.where("owns").groupBy("h").agg(F.min(F.struct("place", "b")).alias("first")), "line-earliest")
    heads = members.join(earliest, "h").select(F.col("first.b").alias("a"), "b").where("a <> b")
    answered = stored(verified(pairs.unionByName(heads), texts, edits), "line-near")

    # What is not answered meets its crowd block by block; a shorter line asks through the longer one that probes it.
    asked = members.join(answered.select(F.col("key").alias("b"), F.lit(True).alias("answered")), "b", "left").withColumn("open", F.col("answered").isNull())
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("owners") / BLOCK)).alias("block")
    blocks = asked.where("owns").groupBy("h", block).agg(F.collect_list(F.struct("b", "place", "n", "letters", "pairs", "open")).alias("block_owners"))

    def asks(x: Column) -> Column:
        earlier = F.when(x["place"] < F.col("place"), F.col("open")).otherwise(x["open"] & (x["n"] < F.col("n")))
        differ = lambda c: F.bit_count(x[c].bitwiseXOR(F.col(c)))
        return earlier & (differ("letters") <= 2 * edits) & (differ("pairs") <= 4 * edits) & (x["b"] != F.col("b"))

    meeting = asked.select("h", "b", "place", "n", "letters", "pairs", "open").join(blocks.drop("block"), "h").where(F.exists("block_owners", asks))
    late = meeting.select("b", F.explode(F.filter("block_owners", asks)).alias("x")).select(F.least("b", "x.b").alias("a"), F.greatest("b", "x.b").alias("b"))
    return answered.unionByName(verified(late, texts, edits)).distinct()


def judged_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, line_no, is_copy, is_near) of every line that goes."""
    rows = keyed(docs)
    lines = lines_of(rows)
    firsts = stored(lines.groupBy("key").agg(F.min(F.struct("doc_id", "text_key", "line_no")).alias("place"), F.count("*").alias("times")), "line-firsts")
    near = near_lines(rows, lines, firsts, edits, min_chars).withColumn("is_near", F.lit(True))
    known = firsts.join(near, "key", "left").where("times > 1 OR is_near").select("key", "place", F.coalesce("is_near", F.lit(False)).alias("is_near"))
    here = F.struct("doc_id", "text_key", "line_no")
    judged = lines.select("doc_id", "text_key", "line_no", "key").join(stored(known, "line-known"), "key")
    return judged.select("doc_id", "text_key", "line_no", (F.col("place") < here).alias("is_copy"), "is_near").where("is_copy OR is_near")


def removals(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(gone_id, gone_key, n_copies, n_near, gone): the line numbers that each document loses, in order."""
    lost = judged_lines(docs, edits, min_chars).groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    each = F.collect_set(F.struct("line_no", "is_copy")).alias("lost")  # equal rows give the same lines once
    listed = lost.agg(each).withColumn("lost", F.array_sort("lost"))
    count = lambda test: F.size(F.filter("lost", test)).cast("long")
    return listed.select("gone_id", "gone_key", count(lambda x: x["is_copy"]).alias("n_copies"), count(lambda x: ~x["is_copy"]).alias("n_near"), F.transform("lost", lambda x: x["line_no"]).alias("gone"))


def line_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_copies, n_near, removed) of each row: removed lists the line numbers, in order."""
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))).cast("long")
    rows = keyed(docs).select("doc_id", "text_key", n_lines.alias("n_lines"))
    got = rows.join(removals(docs, edits, min_chars), (F.col("doc_id") == F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")), "left")
    numbers = F.array_join(F.transform("gone", lambda x: x.cast("string")), ",")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return got.select("doc_id", "n_lines", zero("n_copies"), zero("n_near"), F.coalesce(numbers, F.lit("")).alias("removed"))


def drop_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the removed lines taken out of their texts."""
    names = {"gone_id": "__palisade_id", "gone_key": "__palisade_key", "gone": "__palisade_gone"}
    gone = removals(docs, edits, min_chars).select(*[F.col(a).alias(b) for a, b in names.items()])
    same = (docs["doc_id"].cast("long") == gone["__palisade_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["__palisade_key"])
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.coalesce(F.array_contains("__palisade_gone", i), F.lit(False))), "\n")
    return docs.join(gone, same, "left").select(*[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
