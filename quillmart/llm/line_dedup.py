"""Line dedup by deletion neighbourhoods, built of DataFrame functions alone.

A line goes if an earlier line, of the same document or one before it, is within one edit (a character
inserted, deleted or replaced) or equal. Earlier is by document id, then by line number. Lines shorter than
``min_chars`` characters are not compared for edits, which would make one of "1." and "2."; with
``short_repeats`` they go if an equal line is earlier, unless they are empty or white space, else they stay.

Two lines are within one edit when deleting one character of one, or of each at the same place, makes them
equal. Every line emits the hashes of itself and of all its one-character deletions; equal hashes are joined,
and the edit distance of the neighbour found is verified. Before that two filters, which lose no pair, put
aside lines that cannot have a neighbour: a pair has its first or its last ``c`` characters in common, and the
first or second half of its longer length. Groups of equal hashes are no larger than the alphabet times the
length, whatever the data; equal lines are merged before, on the map side first.

Defined results: a NULL text stays NULL, an empty text stays empty, and a text whose lines all go becomes
empty. Documents without an id come last and count as one document if their texts are equal, as do rows
that repeat an id and a text; such rows get equal results. Other columns are carried whatever their names.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmart.llm.common import quoted, stored

#: Ids are whole numbers; rows without one come last.
NO_ID = 2**63 - 1
LINES = 10**10  # more than the lines of a document
TEXTS = 10**9  # remainders of the hashes that tell texts of one id apart
LONGEST_END = 64  # most characters compared at either end by the first filter
BUCKETS = 1 << 19  # bound on the rows that are broadcast


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(id_col: str, text: Column) -> tuple[Column, Column]:
    """Id and remainder of the text's hash: what tells documents apart."""
    doc = F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID)).alias("doc")
    return doc, F.pmod(F.xxhash64(text), F.lit(TEXTS)).alias("same")


def _compared(line: Column, min_chars: int, short_repeats: bool) -> Column:
    """Whether a line may go: it is long enough, or a shorter one that is not blank."""
    long_enough = F.char_length(line) >= min_chars
    return long_enough | line.rlike(r"\S") if short_repeats else long_enough


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, short_repeats: bool) -> DataFrame:
    """Every line that may go: ``pos``, ``line`` and its two hashes."""
    text = quoted(text_col)
    # Keys in a step of their own: next to the rows of the lines they would be computed for each of them.
    keyed = docs.select(*_keys(id_col, text), text.alias("text"))
    lines = keyed.select("doc", "same", F.posexplode(split_lines(F.col("text"))).alias("no", "line"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    place = ((whole("doc") * TEXTS + whole("same")).cast("decimal(28,0)") * F.lit(LINES).cast("decimal(11,0)")).cast(
        "decimal(38,0)"
    ) + whole("no")
    compared = lines.filter(_compared(F.col("line"), min_chars, short_repeats))
    return compared.withColumn("n", F.char_length("line")).select(
        place.cast("decimal(38,0)").alias("pos"), "line", "n",
        F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("h2"),
    )


def _end_length(n: Column) -> Column:
    """The power of two that fits into a line twice, up to the longest end compared."""
    size, out = 1, F.lit(1)
    while size < LONGEST_END:
        size *= 2
        out = F.when(n >= 2 * size, size).otherwise(out)
    return out


def _ends(line: Column, n: Column) -> Column:
    """Hashes of both ends, for the length of the line and for that of a line one longer."""

    def of(c: Column) -> list[Column]:
        return [F.xxhash64(F.lit(1), c, F.substring(line, 1, c)), F.xxhash64(F.lit(2), c, F.substring(line, n - c + 1, c))]

    own, longer = _end_length(n), _end_length(n + 1)
    return F.when(own == longer, F.array(*of(own))).otherwise(F.array(*of(own), *of(longer)))


def _halves(line: Column, n: Column) -> Column:
    """Hashes of both halves, if the shorter of two lines has the line's length, or one less."""
    out = []
    for shorter in (n, n - 1):
        first = F.floor(shorter / 2).cast("int")
        rest = shorter - first
        out += [
            F.xxhash64(F.lit(1), shorter, F.substring(line, 1, first)),
            F.xxhash64(F.lit(2), shorter, F.substring(line, n - rest + 1, rest)),
        ]
    return F.array(*out)


def _shared(rows: DataFrame, keys: Column) -> DataFrame:
    """Lines that share a key with another line: ``h``, ``h2``, and whether one of the first and the
    second of each pair of keys is shared."""
    keyed = rows.select("h", "h2", F.posexplode(keys).alias("side", "key"))
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    side = F.col("side") % 2
    return keyed.join(shared, "key").groupBy("h", "h2").agg(
        (F.min(side) == 0).alias("first"), (F.max(side) == 1).alias("second")
    )


def first_places(docs: DataFrame, id_col: str, text_col: str, min_chars: int, short_repeats: bool) -> DataFrame:
    """``pos`` of the lines that stay: first of their kind, and no neighbour before them."""
    lines = _lines(docs, id_col, text_col, min_chars, short_repeats)
    line, n = F.col("line"), F.col("n")
    # Without ends a line meets equal lines alone.
    distinct = stored(
        lines.select("h", "h2", "pos", F.when(n >= min_chars, _ends(line, n)).alias("ends"))
        .groupBy("h", "h2", F.col("ends")[0].alias("e0"), F.col("ends")[1].alias("e1"),
                 F.get("ends", F.lit(2)).alias("e2"), F.get("ends", F.lit(3)).alias("e3"))
        .agg(F.min("pos").alias("pos")), "lines",
    )
    ends = F.filter(F.array("e0", "e1", "e2", "e3"), lambda e: e.isNotNull())
    some = stored(_shared(distinct, ends).select("h", "h2").join(distinct.select("h", "h2", "pos"), ["h", "h2"]), "candidates")
    # A bounded number of buckets of hashes keeps most other lines from the join that fetches the texts.
    bucket = F.pmod("h", F.lit(BUCKETS)).alias("bucket")
    buckets = F.broadcast(some.select(bucket).distinct())
    near = lines.withColumn("bucket", bucket).join(buckets, "bucket", "left_semi").drop("bucket")
    texts = stored(near.join(some, ["h", "h2", "pos"]).select("h", "h2", "pos", "n", "line"), "texts")
    neighbours = _neighbours(texts.join(_shared(texts, _halves(line, n)), ["h", "h2"]))
    before = _verified(neighbours, texts).filter("other_pos < pos").select("pos").distinct()
    return distinct.select("pos").join(before, "pos", "left_anti")


def _neighbours(texts: DataFrame) -> DataFrame:
    """``h, h2`` of lines and the earliest line ``other`` that shares a hash with each.

    Only places outside a half that is shared with another line are deleted. The hash of a string is the
    exclusive or of the hashes of its characters and their places, so that those of all deletions follow
    from sums along the line.
    """
    chars = texts.select("h", "h2", "pos", "n", "first", "second", F.posexplode(F.regexp_extract_all("line", F.lit("(?s)."), F.lit(0))).alias("i", "c"))
    here, moved = F.xxhash64("c", "i"), F.xxhash64("c", F.col("i") - 1)
    line = Window.partitionBy("h", "h2")
    so_far = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.floor(F.col("n") / 2)
    differs = (F.col("first") & (F.col("i") >= F.floor((F.col("n") - 1) / 2))) | (F.col("second") & (F.col("i") <= middle))
    deleted = chars.select(
        "h", "h2", "pos", "n", "i", differs.alias("differs"),
        F.bit_xor(here).over(line).alias("whole"),
        F.bit_xor(here.bitwiseXOR(moved)).over(so_far).bitwiseXOR(here)
        .bitwiseXOR(F.bit_xor(moved).over(line)).alias("without"),
    )
    # The line itself once, at place -1, and a row for each deletion.
    own = F.struct(F.col("n").alias("size"), F.col("whole").alias("hash"), F.lit(-1).alias("at"))
    less = F.struct((F.col("n") - 1).alias("size"), F.col("without").alias("hash"), F.col("i").alias("at"))
    start, differs = F.col("i") == 0, F.col("differs")
    rows = F.when(start & differs, F.array(own, less)).when(start, F.array(own)).otherwise(F.array(less))
    emitted = deleted.filter(start | differs).select("h", "h2", "pos", F.inline(rows))
    seen = emitted.groupBy("size", "hash").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b")
    met = emitted.join(seen.select("size", "hash"), ["size", "hash"])
    member = F.struct("pos", "h", "h2")
    group = Window.partitionBy("size", "hash")
    same_place = Window.partitionBy("size", "hash", "at")
    is_whole = F.col("at") == -1
    other = F.when(is_whole, F.min(F.when(~is_whole, member)).over(group)).otherwise(
        F.least(F.min(F.when(is_whole, member)).over(group), F.min(member).over(same_place))
    )
    return met.select("h", "h2", "pos", other.alias("other")).groupBy("h", "h2", "pos").agg(F.min("other").alias("other"))


def _verified(neighbours: DataFrame, texts: DataFrame) -> DataFrame:
    """``pos`` and ``other_pos`` of neighbours whose edit distance is 1 at most."""
    pairs = neighbours.filter(F.col("other").isNotNull() & (F.col("other.pos") < F.col("pos")))
    one = texts.select("h", "h2", "line")
    two = texts.select(F.col("h").alias("oh"), F.col("h2").alias("oh2"), F.col("line").alias("other_line"))
    return (
        pairs.join(one, ["h", "h2"])
        .join(two, (F.col("other.h") == F.col("oh")) & (F.col("other.h2") == F.col("oh2")))
        .filter(F.levenshtein("line", "other_line", 1) >= 0)
        .select("pos", F.col("other.pos").alias("other_pos"))
    )


def dedup(
    docs: DataFrame, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False
) -> DataFrame:
    """``docs`` with only the lines that stay."""
    kept = kept_lines(docs, min_chars, id_col, text_col, short_repeats)
    return kept.select(
        *(F.col("kept_text" if c == text_col else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns))
    )


def kept_lines(
    docs: DataFrame, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text", short_repeats: bool = False
) -> DataFrame:
    """Per row: struct ``row`` with the columns of ``docs`` as ``c0, c1, ...``, ``n_lines`` and ``kept_text``."""
    stay = first_places(docs, id_col, text_col, min_chars, short_repeats)
    doc = F.floor(F.col("pos") / F.lit(LINES).cast("decimal(11,0)"))
    whole = F.floor(doc / F.lit(TEXTS).cast("decimal(10,0)"))
    numbers = stay.select(
        whole.cast("long").alias("kept_doc"),
        F.pmod(doc.cast("decimal(38,0)"), F.lit(TEXTS)).cast("long").alias("kept_same"),
        F.pmod("pos", F.lit(LINES)).cast("int").alias("no"),
    )
    by_doc = numbers.groupBy("kept_doc", "kept_same").agg(F.collect_list("no").alias("numbers"))
    text = quoted(text_col)
    rows = docs.select(
        *_keys(id_col, text), F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row")
    )
    joined = rows.join(by_doc, (F.col("doc") == F.col("kept_doc")) & (F.col("same") == F.col("kept_same")), "left")
    body = F.col(f"row.c{docs.columns.index(text_col)}")
    kept = F.filter(
        split_lines(body),
        lambda x, i: ~_compared(x, min_chars, short_repeats) | F.coalesce(F.array_contains("numbers", i), F.lit(False)),
    )
    return joined.select("row", F.size(split_lines(body)).alias("n_lines"), F.array_join(kept, "\n").alias("kept_text"))
