"""Document fingerprints by winnowing, in DataFrame functions only.

A text is lower-cased and cut into tokens: runs between white space, in parts of up to
``TOKEN`` characters, and single characters of scripts that set no spaces. The hash of
``GRAM`` consecutive tokens is a cyclic polynomial, which rolls: turned by one bit, less the
token that leaves, and with the token that comes. Its values are written out from their
tokens, as an array built step by step would be copied at each step. Of every ``WINDOW``
consecutive k-gram hashes the smallest is chosen, the rightmost one on a tie; each choice is
kept once, with its place. Two texts that share ``GRAM + WINDOW - 1`` consecutive tokens
therefore share a chosen hash. A text of fewer than ``SHORT`` k-grams keeps all of them.

A hash and its place travel as one number (31 bits of hash above 32 bits counted
down from the place), so the smallest number of a window is the choice; minima of
2, 4 and 8 hashes follow from each other. The place counts k-grams, that is, tokens, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialframe.session import materialize

GRAM = 2
WINDOW = 8  # a power of two
SHORT = 32
TOKEN = 8
_LOW = 0xFFFFFFFF
# Han, kana, Hangul and their extensions
_ALONE = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
_TOKENS = rf"[{_ALONE}]|[^\s{_ALONE}]{{1,{TOKEN}}}"


def with_marks(rows: DataFrame, text: str, marks: str, window: int = WINDOW) -> DataFrame:
    """Adds ``marks``: the chosen numbers of column ``text``, in order of place.

    Steps are columns of their own, so that each is made once. A text of fewer
    than ``GRAM`` tokens has the hash of its whole sequence; one without tokens,
    or null, has no marks. The window is a power of two.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window is a power of two")
    step = f"_{marks}"
    low, high = F.lit(_LOW).cast("bigint"), F.lit(0x7FFFFFFF).cast("bigint")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_TOKENS), F.lit(0))
    rows = rows.withColumn(step, F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.when(F.size(step) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(step)))

    def rolled(h: Column, i: Column) -> Column:
        value = _turned(h, GRAM - 1)
        for k in range(1, GRAM):
            value = value.bitwiseXOR(_turned(F.get(F.col(step), i + k), GRAM - 1 - k))
        return F.xxhash64(value)

    grams = F.transform(F.slice(step, F.lit(1), F.greatest(F.size(step) - GRAM + 1, F.lit(0))), rolled)
    rows = rows.withColumn(f"{step}g", F.when(F.size(step) < GRAM, whole).otherwise(grams)).drop(step)
    packed = F.transform(f"{step}g", lambda h, i: F.shiftleft(h.bitwiseAND(high), 32) + (low - i))
    rows = rows.withColumn(f"{step}p", packed).drop(f"{step}g")
    every, level, span = f"{step}p", f"{step}p", 1
    while span < window:  # minima of 2, 4, 8, ... consecutive hashes, each from two of the level before
        rows = rows.withColumn(f"{level}m", _pairwise_min(level, span))
        rows = rows.drop(level) if level != every else rows
        level, span = f"{level}m", 2 * span
    n = F.size(every)
    full = F.slice(level, F.lit(1), F.greatest(n - window + 1, F.lit(0)))
    chosen = F.when(n < max(SHORT, window), F.col(every)).otherwise(F.array_distinct(full))
    return rows.withColumn(marks, chosen).drop(level, every)


def _turned(h: Column, bits: int) -> Column:
    """The 64 bits of a number, turned to the left."""
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def _pairwise_min(level: str, span: int) -> Column:
    return F.transform(level, lambda v, i: F.least(v, F.get(F.col(level), i + span)))


def gram_hashes(marks: Column) -> Column:
    """Distinct hashes of the chosen k-grams, as a set in an array."""
    return F.array_distinct(F.transform(marks, lambda m: F.shiftright(m, 32).cast("int")))


def listed(marks: Column) -> Column:
    """``hash:place`` of every chosen k-gram (hash in hex), comma-joined."""
    low = F.lit(_LOW).cast("bigint")
    return F.array_join(
        F.transform(marks, lambda m: F.concat_ws(":", F.hex(F.shiftright(m, 32)), (low - m.bitwiseAND(low)).cast("string"))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two hash sets (size of intersection over union); 1 if both are empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def document_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text, marks): the chosen (hash, place) numbers of each text; see ``with_marks``."""
    return with_marks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "marks", window)


def following_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id): the next larger id; after the largest comes the smallest. Null ids are left out.

    Ids are laid out by range; each range finds its own next ids, and the first
    id of every range (one row for each range) closes the gaps between them.
    """
    distinct = ids.where("id is not null").select("id").distinct()
    placed = materialize(distinct.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    firsts = placed.groupBy("part").agg(F.min("id").alias("first"))
    order = Window.orderBy("first")  # over one row for each range
    then = F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy()))
    own = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return (
        placed.withColumn("own", own)
        .join(firsts.select("part", then.alias("then")), "part")
        .select("id", F.coalesce("own", "then").alias("next_id"))
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_chars, edited, digest, edited_digest, grams, edited_grams, near_edited, near_next) for every document.

    ``edited`` is the text with its last floor(n/2) code points replaced by the
    first as many, or all, of the next document in order of id (after the last:
    the first). A digest is the SHA-256 of the chosen hashes and places; likeness
    is that of the chosen hashes. Null texts count as empty. Where an id repeats,
    each of its rows is kept; the next document is then the row of the next
    larger id with the least text hash. A row without id has no next document:
    nothing comes in place of its second half, and ``near_next`` is 0. An empty
    table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = materialize(
        rows.where("id is not null")
        .groupBy("id")
        .agg(F.max(F.length("text")).alias("n"), F.min(F.xxhash64("text")).alias("pick"), F.count("*").alias("repeats"))
    )
    after = following_ids(sizes)
    links = (
        sizes.join(after, "id")
        .join(sizes.select(F.col("id").alias("next_id"), F.col("pick").alias("next_pick")), "next_id")
        .select(F.col("id").alias("to"), "next_id", F.floor(F.col("n") / 2).cast("int").alias("half"), "next_pick")
    )
    rows = with_marks(rows, "text", "marks", window)
    rows = rows.select("id", "text", gram_hashes(F.col("marks")).alias("grams"), F.sha2(listed(F.col("marks")), 256).alias("digest"))
    numbered = rows.where("id is not null")
    given = (
        numbered.join(links, F.col("id") == F.col("next_id"))
        .where(F.xxhash64("text").bitwiseXOR(F.col("next_pick")) == 0)  # after the join, on the exchange that both joins use
        .select(
            "to",
            F.substr("text", F.lit(1), F.col("half")).alias("next_text"),
            F.col("grams").alias("next_grams"),
            F.col("digest").alias("next_digest"),
        )
    )
    if (sizes.agg(F.max("repeats")).first()[0] or 1) > 1:
        given = given.dropDuplicates(["to"])  # rows that repeat in full
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in given.drop("to").dtypes]
    rows = (
        numbered.join(given, F.col("id") == F.col("to"), "left")
        .drop("to")
        .unionByName(rows.where("id is null").select("*", *nothing))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    rows = with_marks(rows, "edited", "edited_marks", window)
    rows = rows.withColumn("edited_grams", gram_hashes(F.col("edited_marks")))
    near_next = F.when(F.col("digest") == F.col("next_digest"), 1.0).otherwise(
        F.coalesce(likeness(F.col("grams"), F.col("next_grams")), F.lit(0.0))
    )
    return rows.select(
        "id",
        "n_chars",
        "edited",
        "digest",
        F.sha2(listed(F.col("edited_marks")), 256).alias("edited_digest"),
        "grams",
        "edited_grams",
        likeness(F.col("grams"), F.col("edited_grams")).alias("near_edited"),
        near_next.alias("near_next"),
    )
