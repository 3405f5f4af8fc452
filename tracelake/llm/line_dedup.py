"""Exact line deduplication across documents, in DataFrame functions only.

Method: line keys are hashed (96 bits), the occurrences are range-partitioned by hash
with a secondary sort by document and position, each key's first occurrence is streamed
off the sorted run, and what comes back per document is a compressed keep bitmap (one
64-bit word per 64 lines, words that keep everything left out), never text.

Hot keys: no range partition holds a key that sits in a large share of all documents.
Which hash ranges are hot is counted exactly, over HASH_RANGES ranges; the first document
of a key in a hot range is pre-aggregated before its shuffle, and its occurrences meet it
in a join whose large partitions Spark splits.

Defined results: a null or empty text is one empty line; a row with a null id keeps all
its lines and makes no other row lose any; rows that repeat an id count as one document
(they keep or lose a line together) but are returned one by one; an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.common import materialize

#: Characters stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Equal ranges of the hash space whose row counts tell where hot keys lie.
HASH_RANGES = 4096
#: A range is hot at this many times the mean count of all ranges.
HOT_FACTOR = 4


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, part, pos, h1, h2): hashed keys of the lines long enough to count."""
    keyed = (
        docs.filter(F.col(id_col).isNotNull())
        .select(
            F.col(id_col).alias("doc"),
            F.xxhash64(F.col(text_col)).alias("part"),
            F.posexplode(_lines(F.col(text_col))).alias("pos", "line"),
        )
        .filter(F.length("line") >= min_chars)
        .select("doc", "part", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
    )
    return keyed.select("doc", "part", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


def keep_bitmaps(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> DataFrame:
    """(doc, part, n_dropped, words): documents that lose lines, ``words`` maps word index to its 64 keep bits.

    ``part`` is a hash of the text and tells rows with the same id apart.
    """
    spark = docs.sparkSession
    occ = materialize(occurrences(docs, id_col, text_col, min_chars), "line-occurrences")
    span = F.shiftrightunsigned("h1", 52).cast("int")
    counts = occ.groupBy(span.alias("span")).agg(F.count("*").alias("n"))  # HASH_RANGES rows at most
    mean = counts.agg(F.sum("n").alias("all")).select((F.col("all") / HASH_RANGES).alias("mean"))
    hot = [r.span for r in counts.crossJoin(F.broadcast(mean)).filter(F.col("n") > F.greatest(F.col("mean") * HOT_FACTOR, F.lit(1000))).select("span").collect()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = occ.filter(~span.isin(hot)) if hot else occ
    ranged = rows.repartitionByRange(parts, "h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
    # the window reuses the range partitioning and its sort; its running frame streams
    run = W.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    drops = ranged.withColumn("first_doc", F.first("doc").over(run)).filter(F.col("doc") != F.col("first_doc"))
    drops = drops.select("doc", "part", "pos")
    if hot:
        firsts = occ.filter(span.isin(hot)).groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"))
        later = occ.filter(span.isin(hot)).join(firsts, ["h1", "h2"]).filter(F.col("doc") != F.col("first_doc"))
        drops = drops.unionByName(later.select("doc", "part", "pos"))
    word = F.expr("pos div 64").cast("int").alias("word")
    bit = F.expr("shiftleft(1L, pos % 64)")
    return (
        drops.groupBy("doc", "part", word)
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc", "part")
        .agg(
            F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
            F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("keep")))).alias("words"),
        )
    )


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10
) -> DataFrame:
    """``docs`` with line counts and the text that is left.

    Keys of at least ``min_chars`` code points found in two documents or more lose all
    their lines except in the smallest id. Adds ``n_lines``, ``n_dropped``, ``kept_text``
    (replacing columns of these names); other columns pass through.
    """
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars).select(
        F.col("doc").alias("__doc"), F.col("part").alias("__part"), F.col("n_dropped").alias("__dropped"), F.col("words").alias("__words")
    )
    # a row is carried as one column, so that its columns may have any names
    own_id, text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")
    joined = docs.select(F.struct("*").alias("row")).join(bitmaps, (own_id == F.col("__doc")) & (F.xxhash64(text) == F.col("__part")), "left")
    lines = _lines(text)
    n_lines = F.size(lines)
    # a dense word array makes each line's test one array access
    dense = F.expr("transform(sequence(0, __last), w -> coalesce(element_at(__words, w), -1L))")
    kept = F.expr("array_join(filter(__lines, (x, i) -> (shiftright(get(__dense, i div 64), i % 64) & 1L) = 1L), '\n')")
    slim = joined.withColumn("__n", n_lines.cast("long"))
    some = slim.withColumns({
        "__lines": F.when(F.col("__words").isNotNull(), lines),
        "__last": F.expr("cast((__n - 1) div 64 as int)"),
    }).withColumn("__dense", F.when(F.col("__words").isNotNull(), dense))
    out = some.withColumn("__kept", F.when(F.col("__words").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names],
        F.col("__n").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.col("__kept").alias("kept_text"),
    )
