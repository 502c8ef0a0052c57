"""Mixing sources to target weights: hash-random keys, range sums within each source, a cut at the exact budget.

A source's documents are ordered by the md5 of id and text. Rows are summed by (source, two leading hex digits of the key), which is
a range partition of uniform keys; prefix sums over those 256 ranges find the one with the cut, which is parted again by the next two digits, until it has
few rows; only those are sorted. Texts are never shuffled, and no source meets in one task: a prefix sum has 256 rows, however large the source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, n_words

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
EPOCHS = 3
#: Hex digits by which a range of keys is parted, and the rows of a range that is not parted any more.
DIGITS, FEW_ROWS = 2, 256


def source_targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, n_rows, source_size) -> the same with weight and target.

    Shares of the total by weight; where a share is above the cap, the cap is the target and the excess goes to the rest by
    weight, until none is above. Each round is one aggregate of one row. Sources are numbered within sorted partitions; only the partitions' sizes meet in a window.
    """
    placed = scratch.save(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("place") - F.shiftleft("part", 33)
    w = F.element_at(F.array(*map(F.lit, weights)), (number % len(weights) + 1).cast("int"))
    table = scratch.save(placed.join(before, "part").withColumn("weight", w.cast("long")).drop("place", "part", "before"), "weights")
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("source_size").cast("decimal(38,0)") * epochs * level.denominator < F.col("weight").cast("decimal(38,0)") * level.numerator
        size = F.col("source_size").cast("decimal(38,0)")
        total, fixed, rest, n = table.agg(F.sum(size), F.coalesce(F.sum(F.when(above, size * epochs)), F.lit(0)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if not rest or n == capped:
            break
        level, capped = Fraction(int(total) - int(fixed), int(rest)), n
        top, bottom = int(total) - int(fixed), int(rest)
    if level is None:
        return table.withColumn("target", F.lit(0.0))
    share = F.col("weight").cast("double") * F.lit(float(top)) / F.lit(float(bottom))
    return table.withColumn("target", F.least(share, F.col("source_size").cast("double") * epochs))


def mix_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))


def mixing_plan(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(rows with size and key, sources with target, rounds, cut_key, cut_words).

    A source's budget is its target rounded down. All its documents are taken ``rounds`` times; in the next round those with a key
    below cut_key are taken whole and those at cut_key for cut_words words (rows that tie, which are copies, share what is left evenly).
    """
    sized = docs.withColumns({"size": n_words(F.col("text")), "key": mix_key()})
    slim = scratch.save(sized.select("source", "size", "key"), "sized")
    stats = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    targets = scratch.save(source_targets(stats, scratch, weights, epochs), "targets")
    # The null source gets a name of its own beside the others' names.
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    budget = targets.withColumns({"name": name, "budget": F.floor("target")}).withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    budget = budget.withColumn("left", F.col("budget") - F.col("rounds") * F.col("source_size"))
    keyed = slim.withColumn("name", name)
    upto = lambda column, *by: F.coalesce(F.sum(column).over(Window.partitionBy("name").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = budget.where("left > 0").select("name", "left", F.lit(0).cast("long").alias("before"), F.lit("").alias("range"), F.col("n_rows").alias("rows"), F.lit(True).alias("wide"))
    digits = 0
    while digits < 32 and not cut.where((F.col("rows") > FEW_ROWS) & F.col("wide")).isEmpty():
        inside = keyed.withColumn("range", F.substring("key", 1, digits)).join(cut.select("name", "range", "before", "left"), ["name", "range"])
        digits += DIGITS
        sums = inside.groupBy("name", "before", "left", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), (F.min("key") < F.max("key")).alias("wide"))
        found = sums.withColumn("before", F.col("before") + upto("words", "range")).where("before <= left AND left < before + words")
        cut = scratch.save(found.select("name", "left", "before", "range", "rows", "wide"), f"cut{digits}")
    inside = keyed.withColumn("range", F.substring("key", 1, digits)).join(cut.select("name", "range", "before", "left"), ["name", "range"]).groupBy("name", "before", "left", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("ties"))
    at = F.col("before") + upto("words", "key")
    cut = inside.withColumn("at", at).where("at <= left AND left < at + words").select("name", F.col("key").alias("cut_key"), F.floor((F.col("left") - F.col("at")) / F.col("ties")).cast("long").alias("cut_words"))
    plan = budget.join(cut, "name", "left").select("name", "source_size", "target", "rounds", "cut_key", F.coalesce("cut_words", F.lit(0).cast("long")).alias("cut_words"))
    plan = scratch.save(plan, "plan")
    scratch.keep("plan")
    return sized.withColumn("name", name), plan


def with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the plan of each source: a written table, whose size tells Spark whether to broadcast it."""
    joined = sized.join(plan, "name")
    extra = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0).cast("long"))
    return joined.withColumns({"extra": extra, "taken": F.col("rounds") * F.col("size") + extra})


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents: a row for each time that a document is taken, with the columns of ``docs`` alone.

    The row of the document at a source's cut holds its first words only. Null and empty texts have no words and are never taken; tied rows
    are taken alike; an empty table gives an empty table; reruns agree. Columns that clash with working names keep their values.
    """
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text", "source")
    sized, plan = mixing_plan(inner, Scratch(docs.sparkSession, "mix"), weights, epochs)
    whole = F.when(F.col("extra") == F.col("size"), 1).otherwise(0) + F.col("rounds")
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    taken = with_plan(sized, plan).where("taken > 0").withColumn("times", whole.cast("int") + part.cast("int"))
    taken = taken.withColumn("nth", F.explode(F.sequence(F.lit(1), "times"))).withColumn("cut", part & (F.col("nth") == F.col("times")))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col("extra").cast("int"), F.lit(1))), "")
    text = F.when(F.col("cut"), first).otherwise(F.col("text"))
    out = {"text": text.alias("text"), "n_chars": F.when(F.col("cut"), F.length(first).cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars") if "n_chars" in names else None}
    return taken.select(*[out.get(c) if out.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in names])


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``; the cases are as in :func:`mix_sources`."""
    sized, plan = mixing_plan(docs.select("doc_id", "text", "source"), Scratch(docs.sparkSession, "mix"), weights, epochs)
    return with_plan(sized, plan).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT 0 AS step, sum(source_size)::DOUBLE AS top, sum(weight)::DOUBLE AS bottom, 0::BIGINT AS n FROM src
  UNION ALL
  SELECT step + 1,
         (SELECT sum(source_size) FROM src) - coalesce((SELECT sum(3 * source_size) FROM src WHERE 3 * source_size < weight * top / bottom), 0),
         (SELECT sum(weight) FROM src WHERE NOT 3 * source_size < weight * top / bottom),
         (SELECT count(*) FROM src WHERE 3 * source_size < weight * top / bottom)
  FROM fill WHERE step < 200 AND (SELECT count(*) FROM src WHERE 3 * source_size < weight * top / bottom) > n),
last AS (SELECT arg_max(top, step) AS top, arg_max(bottom, step) AS bottom FROM fill),
goal AS (
  SELECT source, source_size, least(weight * top / bottom, 3.0 * source_size)::DOUBLE AS target FROM src, last),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS rounds FROM goal),
tied AS (
  SELECT source, key, sum(size) AS words, count(*) AS ties FROM sized GROUP BY source, key),
placed AS (
  SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY key) - words)::BIGINT AS at FROM tied)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (b.rounds * d.size + CASE WHEN p.at + p.words <= floor(b.target)::BIGINT - b.rounds * b.source_size THEN d.size
            WHEN p.at <= floor(b.target)::BIGINT - b.rounds * b.source_size THEN (floor(b.target)::BIGINT - b.rounds * b.source_size - p.at) // p.ties
            ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN placed p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key
JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
"""
