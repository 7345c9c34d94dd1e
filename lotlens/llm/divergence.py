"""How far the sources of a language differ in their words, by smoothed shares in whole numbers.

Plain relational: words are exploded and counted by language and source; each language's kept vocabulary is crossed with its
sources, so that a word that a source lacks counts 0 there; the dense table joins itself on language and word, for the sum of
differences of every two sources; windows rank.

Nothing is keyed by language or source alone, as one may hold most rows: counts are combined before they are shuffled, the
vocabulary meets the sources by (language, part of the vocabulary), and the dense table is dealt by (language, word), where a key has a
row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.llm.common import empty_if_null, materialise

#: Runs of ASCII letters and of everything beyond ASCII: what isn't \x00-\x40, \x5B-\x60 or \x7B-\x7F, told by what it is, as
#: Java matches a negated class eight times more slowly.
TERM = r"[A-Za-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A share of 1, a word's count besides its own, documents that a kept word is in, words listed for a source.
WHOLE, PRIOR, KEEP, LISTED = 1_000_000_000, 5, 30, 50
#: Parts into which a language's vocabulary is dealt.
SPREAD = 64


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a row with a null term for each (lang, source)."""
    terms = F.regexp_extract_all(F.translate(empty_if_null("text"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    rows = docs.select(empty_if_null("lang").alias("lang"), empty_if_null("source").alias("source"), terms.alias("terms"))
    # one list a document: nothing, its k terms, its distinct terms; a place in it says what a row counts for
    each = F.concat(F.array(F.lit(None).cast("string")), "terms", F.array_distinct("terms"))
    rows = rows.select("lang", "source", F.size("terms").alias("k"), F.posexplode(each).alias("at", "term"))
    return rows.groupBy("lang", "source", "term").agg(
        F.count_if((F.col("at") > 0) & (F.col("at") <= F.col("k"))).alias("n"), F.count_if(F.col("at") > F.col("k")).alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + PRIOR) / (total + PRIOR * terms)), exactly: the product may be beyond a long."""
    over = F.lit(WHOLE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    return F.call_function("div", over, (total + terms * PRIOR).cast("decimal(20,0)")) + 1


def source_divergence(docs: DataFrame, keep: int = KEEP, listed: int = LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source that occur, null ones being empty.

    Terms are runs of ASCII letters (A-Z lowered) and characters beyond ASCII in the whole text; a language keeps those in at
    least ``keep`` of its documents. Part ``pair``: each other source of the language with the sum, over all kept terms, of the
    differences of shares, 0 without kept terms. Part ``term``: up to ``listed`` kept terms that the source has and whose share is
    above the language's. Ranks by value, then item (in order of UTF-8 bytes), from 1.

    Null and empty texts have no terms, their sources still take part; a source alone in its language has no pairs.
    Repeated rows count each time, identifiers are not read. Other columns than lang, source and text are ignored, whatever their
    names. An empty table gives an empty result.
    """
    of_lang = Window.partitionBy("lang", "term")  # a row for each source
    counts = term_counts(docs).withColumns({"lang_n": F.sum("n").over(of_lang), "lang_docs": F.sum("docs").over(of_lang)})
    counts = materialise(counts.where((F.col("lang_docs") >= keep) | F.col("term").isNull()).drop("docs", "lang_docs"), "terms")
    kept = counts.where("term IS NOT NULL")
    vocabulary = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms", "lang_total"])

    # the empty term stands for the language itself: it brings each two sources together where no term is kept
    vocabulary = vocabulary.unionByName(groups.select("lang").distinct().select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("lang_n")))
    part = F.pmod(F.xxhash64("term"), F.lit(SPREAD)).cast("int")
    dealt = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    cells = vocabulary.withColumn("__part", part).join(dealt, ["lang", "__part"]).drop("__part")
    real = F.col("term") != ""
    dense = cells.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").fillna(0, ["n"]).select(
        "lang", "source", "term", "n",
        F.when(real, share(F.col("n"), F.col("total"), F.col("terms"))).otherwise(F.lit(0)).alias("p"),
        F.when(real, share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).otherwise(F.lit(0)).alias("q"),
    )
    dense = materialise(dense.repartition("lang", "term"), "shares")

    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("of_item"))
    apart = dense.select("lang", "term", "source", "p").join(other, ["lang", "term"]).where(F.col("source") < F.col("item"))
    apart = apart.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("of_item"))).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = apart.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    above = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= listed)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
