"""I-Match document fingerprints, with DataFrame functions alone.

Terms whose document frequency lies within a band (equally, whose inverse document frequency does) form
the lexicon. Lexicon subsets are drawn at random, several at each of a ladder of levels, each level keeping half as many
terms as the one before; a document's distinct lexicon terms are sorted, and the terms of each subset hashed.
A text is hashed at the three levels whose subsets keep about two, one and half a term of as many distinct terms as it
has: such subsets still agree when half of the text has changed, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Tables, cut, free_shuffles, partitions, read

DRAWS, LEVELS = 15, 3  # subsets drawn at each level, and levels that a text is hashed at


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", min_share: float = 0.0005, max_share: float = 0.5, min_docs: int = 2, broadcast_copies: int = 1_000_000) -> DataFrame:
    """(h, mask) of every term found in ``min_share`` to ``max_share`` of the distinct texts of all rows.

    A text with many copies counts once and so keeps its terms; the band's top lies well above a third,
    so a group of near copies of that share keeps its terms too.
    ``h`` is the term's 64-bit hash; ``mask`` holds 4 bits for each of the ``DRAWS`` drawings: the finest
    level, up to 15, at which the drawing's subset keeps the term (a level keeps each term with half the chance of the one before), and above them the
    largest of these. As a share of at least ``min_share`` of the rows is asked for, the lexicon has at most (mean distinct terms
    of a row) / ``min_share`` terms, however many rows there are.

    Texts are told apart by 128-bit hashes. Only those with copies move to be made one; up to ``broadcast_copies`` such hashes (16 bytes each) are
    broadcast to find them, and with more all texts move by their hash.
    """
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("t"))
    keys = cut(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies")))
    total, several = keys.agg(F.count("*"), F.count_if(F.col("copies") > 1)).first()
    if several <= broadcast_copies:
        copied = F.broadcast(keys.where("copies > 1").select("k1", "k2"))
        once = keyed.join(copied, ["k1", "k2"], "left_anti").unionByName(keyed.join(copied, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    else:
        once = keyed.dropDuplicates(["k1", "k2"])
    counts = once.select(F.explode(terms(F.col("t"))).alias("t")).groupBy(F.xxhash64("t").alias("h")).agg(F.count("*").alias("n"))
    band = counts.where((F.col("n") >= max(min_docs, min_share * total)) & (F.col("n") <= max_share * total))
    chance = lambda k: (F.shiftrightunsigned(F.xxhash64("h", F.lit(k)), 11) + 0.5) / F.lit(2.0**53)
    drawn = [F.least(F.lit(15), F.floor(-F.log2(chance(k)))).cast("long") for k in range(DRAWS)]
    return band.select("h", F.array(*drawn).alias("d")).select("h", sum((F.shiftleft(F.get("d", F.lit(k)), 4 * k) for k in range(DRAWS)), F.shiftleft(F.array_max("d"), 4 * DRAWS)).alias("mask"))


def fingerprint_rows(rows: DataFrame, keys: list[str], text_col: str, lex: DataFrame, broadcast_terms: int = 1_000_000) -> DataFrame:
    """``keys``, ``level`` and ``prints`` (``LEVELS`` x ``DRAWS`` 31-bit hashes, 0 for a subset without terms) of each row.

    ``keys`` identify a row, and rows should lie by some of them. A text's first level is the one whose subsets keep about two of as
    many distinct terms as it has, and all of the text's terms are looked at. A row without
    a term in any of its subsets is hashed by all its distinct terms, and one without terms by its text; every subset
    then has that hash. The lexicon (already written) is broadcast if it has up to ``broadcast_terms`` rows.
    """
    told = rows.select(*keys, F.col(text_col).alias("text"), F.transform(terms(F.col(text_col)), lambda t: F.xxhash64(t)).alias("hs"))
    level = F.greatest(F.lit(0), F.least(F.lit(16 - LEVELS), F.round(F.log2(F.greatest(F.size("hs"), F.lit(1)))) - 1)).cast("int")
    plain = F.when(F.size("hs") > 0, F.xxhash64(F.sort_array("hs"))).otherwise(F.xxhash64("text"))
    told = told.select(*keys, level.alias("level"), plain.alias("plain"), "hs")
    spread = told.select(*keys, "level", "plain", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("hs"))).alias("term"))
    lex = lex.select(F.col("h").alias("term"), "mask")
    lex = F.broadcast(lex) if lex.count() <= broadcast_terms else lex
    hits = spread.join(lex, "term", "left").where(F.col("term").isNull() | (F.shiftrightunsigned("mask", 4 * DRAWS) >= F.col("level")))
    found = hits.groupBy(*keys, "level", "plain").agg(F.sort_array(F.collect_set(F.when(F.col("term").isNotNull(), F.struct("term", "mask")))).alias("own"))

    def short(h: Column) -> Column:
        return F.greatest(F.lit(1), h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))

    def one(j: int, k: int) -> Column:
        kept = F.transform(F.filter("own", lambda x: F.shiftrightunsigned(x["mask"], 4 * k).bitwiseAND(F.lit(15)) >= F.col("level") + j), lambda x: x["term"])
        return F.when(F.size(kept) > 0, short(F.xxhash64(kept))).otherwise(0)

    own = F.array(*[one(j, k) for j in range(LEVELS) for k in range(DRAWS)])
    usable = F.exists("p", lambda x: x != 0)
    same = F.array_repeat(short(F.col("plain")), LEVELS * DRAWS)
    return found.select(*keys, "level", "plain", own.alias("p")).select(*keys, "level", F.when(usable, F.col("p")).otherwise(same).alias("prints"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets, among those with terms in either text, whose hashes agree; ``a`` and ``b`` have level and prints.

    Subsets of the levels that both texts use are compared; texts without a common level are not alike.
    """
    apart = a["level"] - b["level"]
    size = (F.lit(LEVELS) - F.abs(apart)) * DRAWS
    part = lambda x, skip: F.slice(x["prints"], F.greatest(F.lit(0), skip) * DRAWS + 1, F.greatest(F.lit(0), size))
    both = F.zip_with(part(a, -apart), part(b, apart), lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    return F.size(F.filter(both, lambda x: x == 2)) / F.greatest(F.lit(1), F.size(F.filter(both, lambda x: x > 0)))


def as_text(print_: Column) -> Column:
    return F.concat(F.hex(print_["level"]), F.lit("-"), F.array_join(F.transform(print_["prints"], lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""))


def successors(docs: DataFrame, tables: Tables) -> DataFrame:
    """(o, h, n, c, next_o, next_h): for each (id, hash of text) its characters, its rows, and the next one, the first after the last.

    Only these narrow rows are put in order: by range, each range by a window, and the ranges' first rows, a row a range, link one range to the next.
    """
    spark = docs.sparkSession
    keyed = tables.cut(docs.groupBy("o", "h").agg(F.count("*").alias("c"), F.first("n").alias("n")).repartitionByRange(4 * partitions(spark), "o", "h").withColumn("range", F.spark_partition_id()))
    here = F.struct("o", "h")
    after = F.lead(here).over(Window.partitionBy("range").orderBy("o", "h"))
    heads = keyed.groupBy("range").agg(F.min(here).alias("head"))
    w = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(w), F.first("head").over(w)).alias("head"))
    found = keyed.withColumn("next", after).join(F.broadcast(heads), "range")
    return tables.cut(found.select("o", "h", "n", "c", F.coalesce("next", "head").alias("next")).select("o", "h", "n", "c", F.col("next.o").alias("next_o"), F.col("next.h").alias("next_h")))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its half-edited text, and their likeness; see the contract."""
    return edited_likeness(read(spark, sf_dir, "documents").select("doc_id", "text"))


def edited_likeness(docs: DataFrame, **band) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and likeness to that and to the next document's.

    Ids should be unique; rows that repeat an id are ordered by a hash of their text, and rows that are equal follow each other. A null id
    comes first, a null text is an empty one, and a text may be of any length. An empty table gives no rows. Other columns play no part.

    A text moves once, to its key; from there the next text's prefix, as long as the edit needs it, goes to the text before.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    rows = docs.select("doc_id", order.alias("o"), F.coalesce("text", F.lit("")).alias("text"))
    several = rows.groupBy("o").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    rows = rows.select("doc_id", "o", (F.xxhash64("text") if several else F.lit(0)).cast("long").alias("h"), "text")
    lex = tables.cut(lexicon(rows, "text", **band))
    chain = successors(rows.select("o", "h", F.length("text").alias("n")), tables)
    width = partitions(spark)
    texts = tables.bucketed(rows.dropDuplicates(["o", "h"]) if several else rows, width, ["o", "h"], "texts")
    free_shuffles(spark)
    half = F.floor(F.col("n") / 2).cast("int")
    wanted = chain.select(F.col("next_o").alias("o"), F.col("next_h").alias("h"), F.col("o").alias("to_o"), F.col("h").alias("to_h"), half.alias("k"))
    prefixes = texts.select("o", "h", "text").join(wanted.hint("merge"), ["o", "h"]).select(F.col("to_o").alias("o"), F.col("to_h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("k")).alias("prefix"))
    both = texts.join(chain.hint("merge"), ["o", "h"]).join(prefixes.hint("merge"), ["o", "h"])
    # Of equal rows all but the last are followed by their own text.
    both = both.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i")) if several else both.withColumn("i", F.lit(1).cast("long"))
    prefix = F.when(F.col("i") < F.col("c"), F.substring(F.col("text"), F.lit(1), half)).otherwise(F.col("prefix"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), prefix)
    versions = F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("t"), F.sha2(F.col("edited"), 256).alias("sha")))
    both = both.select("o", "h", "i", "c", "doc_id", F.col("n").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["o", "h", "i", "c", "doc_id", "n_chars", "sha", "edit"]
    prints = fingerprint_rows(both.select(*keys[:6], F.explode(versions).alias("v")).select(*keys[:6], "v.*"), keys, "t", lex)
    pair = prints.groupBy(*keys[:6]).agg(F.max("sha").alias("sha"), *[F.max(F.when(F.col("edit") == e, F.struct("level", "prints"))).alias(f"v{e}") for e in (0, 1)])
    pair = tables.bucketed(pair, width, ["o", "h"], "prints", deal=False)
    free_shuffles(spark)
    # A text's print goes to the text before it.
    after = pair.where("i = 1").select("o", "h", "v0").join(wanted.select("o", "h", "to_o", "to_h").hint("merge"), ["o", "h"])
    after = after.select(F.col("to_o").alias("o"), F.col("to_h").alias("h"), F.col("v0").alias("after"))
    pair = pair.join(after.hint("merge"), ["o", "h"]).withColumn("after", F.when(F.col("i") < F.col("c"), F.col("v0")).otherwise(F.col("after")))
    return pair.select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("v0")).alias("fingerprint"), as_text(F.col("v1")).alias("edited_fingerprint"),
        likeness(F.col("v0"), F.col("v1")).alias("near_edited"), likeness(F.col("v0"), F.col("after")).alias("near_next"),
    )
