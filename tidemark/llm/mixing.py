"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / size copies. The documents of a source
stand in a line ordered by size (so that the copies follow the sizes, not only the
count); their expected copies are summed along the line, one random offset is added,
and a document is emitted once for each integer its own stretch of the sum crosses.

The place in line is found without bringing a source together: counts by (source,
size class), then by (class, size, bin), give each bin's first place; only the rows
of one bin are ordered among themselves. A bin holds the rows of one size whose key
hashes alike, so a hot source or thousands of copies spread over many bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.util import word_count, written

WEIGHTS = (5, 2, 1)
#: The mix's size as a share of all sizes, and the most a source may be repeated.
SHARE = 1.5
REPEAT = 2
SEED = "mix-1"
#: Bins of one size; more only cost counts. A bin's rows are cut further, by ranges of the key, so that a range has about RANGE rows of all sizes.
BINS, RANGE = 64, 1 << 22
#: Rates and offsets are whole multiples of one part in UNIT, so sums along the line are exact at any length.
UNIT = 1 << 32


def targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """From (src, source, source_size) of each source its target added.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes. A target stops at ``repeat`` times its source's size; the excess goes to the others
    by weight until none is above. That fixed point fills sources in order of stop / weight:
    a source stops while its stop / weight is below the level the rest would get. The windows
    below run over one row a source.
    """
    # Binary order of UTF-8 is code point order.
    by_name = (F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(Window.orderBy(*by_name)) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    rows = totals.withColumn("weight", weight).withColumn("stop", F.lit(repeat) * F.col("source_size"))
    rows = rows.withColumn("level", F.col("stop") / F.col("weight"))
    rows = rows.withColumn("all", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    filled = Window.orderBy("level", *by_name)
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn(
        "open", (F.col("all") - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(rest)
    )
    # The first level that is not above its stop holds for it and all after it.
    holds = F.first(F.when(F.col("level") >= F.col("open"), F.col("open")), ignorenulls=True).over(
        filled.rowsBetween(Window.unboundedPreceding, 0)
    )
    stop = F.col("stop").cast("double")
    return rows.select("src", "source_size", F.least(stop, F.coalesce(F.col("weight") * holds, stop)).alias("target"))


def plan(rows: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """(rid, doc_id, source, size, ...) with ``source_size``, ``target`` and ``copies`` added.

    A source without words has target 0 and is taken never. Rows of one bin stand by
    (doc_id, rid); a null doc_id stands first. ``rows`` are read three times, for the range of
    the keys, the counts and the places, and are shuffled once, with whatever they carry.
    """
    key = ["src", "class", "size", "bin", "range"]
    span = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    low, wide_by = int(span[1] or 0), max(1, -(-(int(span[2] or 0) - int(span[1] or 0) + 1) * RANGE // max(1, span[0])))
    # Rows without a key stand first, in the order of ``rid``, and are cut by its upper half.
    ranges = F.when(F.col("doc_id").isNull(), F.shiftright("rid", 33) - (1 << 40)).otherwise(F.floor((F.col("doc_id").cast("decimal(38,0)") - low) / wide_by).cast("long"))
    wide = rows.withColumn("range", ranges).withColumns(
        {
            "src": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
            "class": F.when(F.col("size") > 0, F.floor(8 * F.log2(F.col("size")))).otherwise(-1).cast("int"),
            "bin": F.coalesce(
                F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") % BINS, F.lit(0)
            ),
        }
    )
    counts = written(wide.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "counts")
    by_class = counts.groupBy("src", "class").agg(F.sum("n").alias("n"))
    line = Window.partitionBy("src").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.select("src", "class", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("class_first"))
    inner = Window.partitionBy("src", "class").orderBy("size", "bin", "range").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.select(*key, F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("bin_first"))

    totals = counts.groupBy("src").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(totals, **shares)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "src")), 1, 8), 16, 10).cast("decimal(20,0)")
    rate = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * float(UNIT)).cast("decimal(12,0)")
    goal = goal.withColumns({"rate": rate, "offset": draw})

    places = bins.join(by_class, ["src", "class"]).join(goal, "src")
    places = places.withColumn("first", F.col("class_first") + F.col("bin_first")).drop("class_first", "bin_first")
    own = Window.partitionBy(*key).orderBy("doc_id", "rid")
    placed = wide.withColumn("place", F.row_number().over(own)).join(places, key)
    placed = placed.withColumn("at", (F.col("first") + F.col("place")).cast("decimal(18,0)"))
    crossed = lambda upto: F.expr(f"(offset + {upto} * rate) DIV CAST({UNIT} AS DECIMAL(10,0))")
    return placed.select(*rows.columns, "source_size", "target", (crossed("at") - crossed("(at - 1)")).alias("copies"))


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("rid"),
        docs[key].alias("doc_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"),
    )


def mix(docs: DataFrame, **shares) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    ``docs`` are read twice: give stored rows, not a plan that may change. Null and wordless
    texts have size 0; a source without words is never taken, but a wordless text of another
    source may be. Null sources are one source. Repeated rows are rows of their own; an empty
    table gives an empty result.
    """
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"),
        F.monotonically_increasing_id().alias("rid"),
    )
    taken = plan(rows, **shares).where("copies > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return copies.select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every row.

    Null texts have size 0; null sources are one source, last in line; repeated rows are
    rows of their own; an empty table gives an empty result.
    """
    return plan(written(sized(docs), "sizes")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


#: The same by one window over each source; word counts by pattern.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS stop, (2 * source_size)::DOUBLE / (CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS level FROM totals),
opened AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open FROM weighed),
goal AS (
  SELECT source, source_size, least(stop::DOUBLE, coalesce(weight * first_value(CASE WHEN level >= open THEN open END IGNORE NULLS) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), stop::DOUBLE)) AS target FROM opened),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix-1|' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off, s.source
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
lined AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 2))::INT % 64, 0), doc_id NULLS FIRST)::DOUBLE AS place FROM placed)
SELECT doc_id, size, source_size, target,
  (size * (floor(off + place * rate) - floor(off + (place - 1) * rate)))::BIGINT AS taken
FROM lined"""
