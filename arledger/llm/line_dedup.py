"""Line dedup by a deletion-neighbourhood join.

A line is dropped if an earlier line of the corpus lies within one character insertion,
deletion or substitution of it. Earlier means smaller (doc_id, text hash, line number).
Equal lines are collapsed first. Of the different lines, those that share their beginning or
end with another line of about their length go on; every other line is proven to be further than one edit
away. For each line that is left, all strings with one character deleted are hashed:

* lines with equal (deleted string, place) differ in that one character;
* a line that equals another line's deleted string is one insertion away.

Both are found by grouping on the hashed key with the earliest line as an aggregate, so a
frequent line or a large group of near copies sends one row per line and key, never pairs. An
edit distance check on the texts follows.

Defined cases: lines shorter than ``min_chars`` go only if they equal an earlier line, and without
``short_copies`` not even then (the query and the pipeline have it); blank lines always stay; a null text stays null; a document that loses all its
lines becomes an empty text; one that loses all but blank lines is left out on request; rows
with equal doc_id and text count as one document and share its result; a null doc_id sorts
first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arledger.llm.common import SPACE, narrowed, stored

#: Shorter lines are headings, list marks and brackets: one edit is no sign of a copy there.
MIN_CHARS = 20
_SEGMENT = 64
_SHORT_SEGMENT = 16
_LINE = ("h1", "h2")
_PLACE = ("doc_id", "dk", "line_no")


def _line_id(line: Column) -> list[Column]:
    """Two hashes of different seeds; together they identify a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _ends(line: Column, n: Column) -> Column:
    """Hashed beginning and end, one of which a line shares with any line within one edit.

    Both are ``size`` characters long, at most half of the line, so an edit leaves one alone.
    The size is the same for lines of 8k to 8k + 7 characters; a line of 8k also gives the
    ends of the size below, for pairs with a line one shorter.
    """

    def keys(size: Column) -> list[Column]:
        return [
            F.xxhash64(F.lit("head"), size, F.left(line, size)),
            F.xxhash64(F.lit("tail"), size, F.right(line, size)),
        ]

    size = (F.floor(n / 8) * 4).cast("int")
    return F.when(n % 8 == 0, F.array(*keys(size), *keys(size - 4))).otherwise(F.array(*keys(size)))


def _has_word(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "") != ""


def line_occurrences(
    docs: DataFrame, min_chars: int = MIN_CHARS, short_copies: bool = False
) -> DataFrame:
    """One row per line of at least ``min_chars`` characters, without its text.

    ``short_copies`` adds shorter lines with a word. They have no ends, and so no near lines."""
    rows = narrowed(docs, "doc_id", "text")
    long = F.col("n") >= min_chars
    taken = long | _has_word(F.col("line")) if short_copies else long
    ends = F.when(long, _ends(F.col("line"), F.col("n")))
    return (
        rows.select(
            "doc_id",
            F.xxhash64("text").alias("dk"),
            F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
        )
        .withColumn("n", F.char_length("line"))
        .where(taken)
        .select(*_PLACE, *_line_id(F.col("line")), ends.alias("ends"))
    )


def _first_places(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy(*_LINE).agg(
        F.min(F.struct(*_PLACE)).alias("place"), F.count("*").alias("times")
    )


def _sharing(occurrences: DataFrame, firsts: DataFrame) -> DataFrame:
    """Lines that share an end with another line: (h1, h2, place).

    Keys are counted before rows meet them; h1 alone tells lines apart here, since a wrong
    guess only lets a line through to the next step.
    """
    keyed = occurrences.select("h1", F.explode("ends").alias("key"))
    shared = (
        keyed.groupBy("key")
        .agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("key")
    )
    sharing = keyed.join(shared, "key", "left_semi").select("h1").distinct()
    return firsts.join(sharing, "h1", "left_semi")


def _with_text(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The texts of a few lines, cut out of the documents that hold them."""
    wanted = lines.groupBy(
        F.col("place.doc_id").alias("w_id"), F.col("place.dk").alias("w_dk")
    ).agg(F.collect_list(F.struct("place.line_no", *_LINE)).alias("wanted"))
    rows = narrowed(docs, "doc_id", "text").withColumn("dk", F.xxhash64("text"))
    met = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("dk") == F.col("w_dk"))
    return (
        rows.join(wanted, met)
        .withColumn("cut", F.split("text", "\n"))
        .select("doc_id", "dk", "cut", F.explode("wanted").alias("w"))
        .select(
            "w.h1",
            "w.h2",
            F.struct("doc_id", "dk", F.col("w.line_no").alias("line_no")).alias("place"),
            F.get("cut", F.col("w.line_no")).alias("line"),
        )
        .dropDuplicates(_LINE)
    )


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds ``id``, which orders lines as their places do: one range of places per task."""
    return lines.repartitionByRange("place").sortWithinPartitions("place").withColumn(
        "id", F.monotonically_increasing_id()
    )


def _segments(lines: DataFrame) -> DataFrame:
    """Each line's segments, with the rest of the line on both sides as a hash.

    ``around`` is what stays of a line if a character of the segment goes. ``around_own``
    leaves a segment one shorter, as a line that lost a character has it. Only segments whose
    rest another line has as well are kept. A line of one segment has no rest and stays.
    """
    n = F.char_length("line")
    # Short lines have short segments. A line of the border length is cut both ways, to meet
    # lines one shorter and one longer.
    sizes = F.array_compact(
        F.array(
            F.when(n <= _SEGMENT, F.lit(_SHORT_SEGMENT)), F.when(n >= _SEGMENT, F.lit(_SEGMENT))
        )
    )
    # A line whose length is a multiple of the segment has a last, empty segment: there a
    # longer line may have its last character.
    size = F.col("size")
    from_ = F.col("g") * size
    before = F.xxhash64("size", "g", F.left("line", from_))
    cut = (
        lines.withColumn("size", F.explode(sizes))
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.floor(n / size).cast("int"))))
        .select(
            "id",
            F.substr("line", from_ + 1, size).alias("part"),
            F.xxhash64(before, F.substr("line", from_ + size + 1)).alias("around"),
            F.xxhash64(before, F.substr("line", from_ + size)).alias("around_own"),
            (n < size).alias("single"),
            "size",
        )
    )
    cut = stored(cut)
    rests = cut.where(~F.col("single")).select(
        "id", F.explode(F.array("around", "around_own")).alias("rest")
    )
    shared = (
        rests.groupBy("rest")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("rest")
    )
    passed = rests.join(shared, "rest", "left_semi").distinct().withColumnRenamed("id", "p_id")
    has_rest = (F.col("id") == F.col("p_id")) & F.col("rest").isin(F.col("around"), F.col("around_own"))
    return cut.where("single").unionByName(
        cut.where(~F.col("single")).join(passed, has_rest, "left_semi")
    )


def deletion_keys(lines: DataFrame) -> DataFrame:
    """Hashed deletion neighbourhood of each line: (id, role, key).

    Role 0: the string without character i, and i. Role 1: the string without any one
    character. Role 2: the line itself, to meet role 1 of a longer line. Keys are made per
    segment, with the rest of the line as a hash, so a line of n characters costs n short
    strings and not n copies of itself.
    """
    cut = _segments(lines)
    size = F.char_length("part")
    deleted = cut.where(size > 0).withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
    rest = F.concat(F.left("part", F.col("i")), F.substr("part", F.col("i") + 2))
    string = deleted.select("id", "i", F.xxhash64("around", rest).alias("string"))
    placed = F.struct(F.lit(0).cast("byte").alias("role"), F.xxhash64("string", "i").alias("key"))
    any_place = F.struct(F.lit(1).cast("byte").alias("role"), F.col("string").alias("key"))
    own = cut.select(
        "id",
        F.lit(2).cast("byte").alias("role"),
        F.xxhash64("around_own", F.left("part", F.col("size") - 1)).alias("key"),
    )
    return (
        string.select("id", F.explode(F.array(placed, any_place)).alias("k"))
        .select("id", "k.role", "k.key")
        .unionByName(own)
    )


def _candidates(keys: DataFrame) -> DataFrame:
    """(id, earlier id): with the earliest line of each key, which is enough, since lines of
    one role 0 key are all within one edit of each other."""
    placed = F.col("role") == 0
    keys = keys.withColumn("placed", placed)
    grouped = (
        keys.groupBy("key", "placed")
        .agg(
            F.min(F.when(F.col("role") != 2, F.col("id"))).alias("first"),
            F.min(F.when(F.col("role") == 2, F.col("id"))).alias("own"),
            F.min("id").alias("low"),
            F.max("id").alias("high"),
        )
        .where(F.col("low") != F.col("high"))
        .where(F.col("first").isNotNull() & (F.col("placed") | F.col("own").isNotNull()))
        .select("key", "placed", "first", "own")
    )
    other = F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("first"))
    return (
        keys.join(grouped, ["key", "placed"])
        .select("id", other.alias("other_id"))
        .where(F.col("other_id") < F.col("id"))
        .distinct()
    )


def _within_one_edit(a: Column, b: Column) -> Column:
    """Edit distance of at most one, in time linear in the lines up to a logarithm.

    The common beginning is found by halving; what follows it must be equal after one
    character of either line, or of both, is left out.
    """
    size = F.least(F.char_length(a), F.char_length(b))
    middle = lambda x: ((x["low"] + x["high"] + 1) / 2).cast("int")
    equal = lambda x: F.left(a, middle(x)) == F.left(b, middle(x))
    common = F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int")),
        F.struct(F.lit(0).alias("low"), size.alias("high")),
        lambda x, _: F.struct(
            F.when(equal(x), middle(x)).otherwise(x["low"]).alias("low"),
            F.when(equal(x), x["high"]).otherwise(middle(x) - 1).alias("high"),
        ),
        lambda x: x["low"],
    )

    def rests_equal(at: Column) -> Column:
        rest_a, rest_b = F.substr(a, at + 1), F.substr(b, at + 1)
        shorter_a, shorter_b = F.substr(a, at + 2), F.substr(b, at + 2)
        return (shorter_a == rest_b) | (rest_a == shorter_b) | (shorter_a == shorter_b)

    return F.exists(F.array(common), rests_equal)


def near_lines(docs: DataFrame, occurrences: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that lie within one edit of an earlier, different line."""
    texts = stored(_numbered(_with_text(docs, _sharing(occurrences, firsts))))
    pairs = _candidates(deletion_keys(texts.select("id", "line")))
    other = texts.select(F.col("id").alias("other_id"), F.col("line").alias("other"))
    return (
        pairs.join(texts.select("id", *_LINE, "line"), "id")
        .join(other, "other_id")
        .where(_within_one_edit(F.col("line"), F.col("other")))
        .select(*_LINE)
        .distinct()
    )


def _dropped(docs: DataFrame, min_chars: int, short_copies: bool) -> DataFrame:
    """Dropped line numbers per document: (d_id, d_dk, drops)."""
    occurrences = stored(line_occurrences(docs, min_chars, short_copies))
    firsts = stored(_first_places(occurrences))
    near = near_lines(docs, occurrences, firsts).withColumn("near", F.lit(True))
    # Only lines that lose an occurrence meet the occurrences, from a table of their own, so
    # that the join can split a frequent line's rows.
    lines = stored(
        firsts.join(near, list(_LINE), "left")
        .where(F.col("near") | (F.col("times") > 1))
        .select(*_LINE, "place", "near")
    )
    return (
        occurrences.select(*_PLACE, *_LINE)
        .join(lines, list(_LINE))
        .where(F.col("near") | (F.struct(*_PLACE) != F.col("place")))
        .groupBy(F.col("doc_id").alias("d_id"), F.col("dk").alias("d_dk"))
        .agg(F.collect_set("line_no").alias("drops"))
    )


def _judged(
    docs: DataFrame, min_chars: int, short_copies: bool = False
) -> tuple[DataFrame, list[str]]:
    columns = [f"__c{i}" for i in range(len(docs.columns))]
    text = columns[docs.columns.index("text")]
    doc_id = columns[docs.columns.index("doc_id")]
    drops = _dropped(docs, min_chars, short_copies)
    rows = docs.toDF(*columns)
    met = F.col(doc_id).eqNullSafe(F.col("d_id")) & (F.xxhash64(text) == F.col("d_dk"))
    joined = (
        rows.join(drops, met, "left")
        .withColumn("__lines", F.split(text, "\n"))
        .withColumn("__n", F.coalesce(F.size("__lines"), F.lit(0)))
        .withColumn("__out", F.coalesce(F.size("drops"), F.lit(0)))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.col("__n") - 1), F.col("drops"))
    cut = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return joined.withColumn(
        "__text", F.when(F.col("drops").isNull(), F.col(text)).otherwise(cut)
    ), columns


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    drop_emptied: bool = False,
    short_copies: bool = False,
) -> DataFrame:
    """The documents without repeated lines, in the columns of ``docs``. ``n_chars`` follows
    the text where the column exists. ``drop_emptied`` leaves out documents that lost lines and
    have no line with a word left. ``short_copies`` drops exact repeats of lines shorter than
    ``min_chars`` too."""
    judged, columns = _judged(docs, min_chars, short_copies)
    if drop_emptied:
        judged = judged.where((F.col("__out") == 0) | _has_word(F.col("__text")))
    at = {name: F.col(column) for name, column in zip(docs.columns, columns)}
    at["text"] = F.col("__text")
    if "n_chars" in at:
        changed = F.char_length("__text").cast("long")
        at["n_chars"] = F.when(F.col("__out") > 0, changed).otherwise(at["n_chars"])
    return judged.select(*(column.alias(name) for name, column in at.items()))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 (of the text that stays)."""
    judged, columns = _judged(narrowed(docs, "doc_id", "text"), MIN_CHARS, short_copies=True)
    return judged.select(
        F.col(columns[0]).alias("doc_id"),
        F.greatest(F.col("__n"), F.lit(0)).cast("long").alias("n_lines"),
        F.col("__out").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("__text", F.lit("")), 256).alias("kept_sha256"),
    )
