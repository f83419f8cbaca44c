"""Mixing sources to target weights by weighted fair queueing.

Every document is offered ``PASSES`` times, in an order of its source that is shuffled by the md5 of its id and text. Its
virtual finish time is the source's words up to and with it, divided by the source's target. The documents of all
sources are sorted by that time, and the mix is the front of that order up to the total budget; the document that
crosses the budget is cut there.

Targets: the budget is shared by weight; where a share exceeds ``PASSES`` times its source's size it stops there and
the excess is shared by weight among the others, until none exceeds it.

Rows that are equal in id and text are counted first, in ``SALTS`` parts. The running sum of a source is the sum of the
buckets before (md5 prefixes), the sum of the rows before within a bucket, and the number among equals, so that neither a
source nor an id with a third of all rows meets in one task. The global order is a range sort of all offers by virtual
time; words are summed by range, and the range in which the budget ends is summed row by row. Only sums by source and by
range meet in one task; neither grows with the documents of a source.

Nulls: a null text has size 0; the null source is a source, last in order; a null id shuffles as the empty
string.
Documents without words are returned with taken 0; texts may be of any length. Repeated rows are separate documents. Columns other than id, text
and source are ignored here and kept by ``mixed_documents``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import SPACE, drop, words, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
PASSES = 2
#: Parts over which rows that are equal in id and text are dealt, and offers of a range of the global order.
SALTS, RANGE = 64, 200_000
#: Names of the columns that tell rows apart where ids repeat.
KEYS = ("_text_key", "_row_key")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, target) from (source, source_size): budget shared by weight, none above PASSES times its size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(PASSES)))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    base = base.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # stopping one more source raises the level of the rest until they fit, and lowers it from there on
    base = base.withColumn("level", F.max("level").over(whole))
    return base.select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def queue(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, taken_1 ... taken_PASSES): what the mix takes of each pass of each document.

    Columns named in ``keep`` are carried along after those.
    """
    text = F.col(text_col).cast("string")
    mark = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.md5(text.cast("binary")), F.lit(""))).cast("binary"))
    sized = docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), mark.alias("mark"))
    sized = written(sized.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "sizes")
    # rows with one mark have one size, and which of them is which makes no difference
    alike = sized.groupBy("source", "mark", "salt").agg(F.first("size").alias("each"), F.count("*").alias("n")).withColumn("words", F.col("each") * F.col("n")).withColumn("bucket", F.substring("mark", 1, 3))
    alike = written(alike, "alike")
    buckets = alike.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    goals = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share)
    skip = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    buckets = buckets.withColumn("skip", skip).drop("n").withColumnRenamed("source", "s").withColumnRenamed("bucket", "b")
    goals = goals.withColumnRenamed("source", "g")
    buckets = buckets.join(goals, buckets["s"].eqNullSafe(goals["g"])).drop("g")
    before = F.sum("words").over(Window.partitionBy("source", "bucket").orderBy("mark", "salt")) - F.col("words")
    begun = alike.withColumn("before", before).join(buckets, alike["source"].eqNullSafe(buckets["s"]) & (alike["bucket"] == buckets["b"]))
    begun = begun.select(F.col("source").alias("s"), F.col("mark").alias("m"), F.col("salt").alias("t"), (F.col("skip") + F.col("before")).alias("begin"), "source_size", "target")
    number = F.row_number().over(Window.partitionBy("source", "mark", "salt").orderBy("doc_id"))
    served = sized.withColumn("number", number).join(begun, sized["source"].eqNullSafe(begun["s"]) & (sized["mark"] == begun["m"]) & (sized["salt"] == begun["t"]))
    ends = [F.col("begin") + F.col("number") * F.col("size") + F.lit(k) * F.col("source_size") for k in range(PASSES)]
    served = served.select(*keep, "doc_id", "size", "source", "source_size", "target", *[F.when(F.col("target") > 0, e / F.col("target")).otherwise(F.lit(0.0)).alias(f"finish_{k + 1}") for k, e in enumerate(ends)])
    served = written(served, "finish")
    drop(sized, alike)
    budget = int(share * (served.agg(F.sum("size")).first()[0] or 0))
    time, source, taken = cut(served, budget)
    for k in range(1, PASSES + 1):
        at, tie = F.col(f"finish_{k}"), F.coalesce(F.col("source") < F.lit(source), F.col("source").isNotNull() & F.lit(source is None)) if time is not None else F.lit(False)
        here = F.col("source").eqNullSafe(F.lit(source)) & (at == F.lit(time)) if time is not None else F.lit(False)
        all_of = (at < F.lit(time)) | ((at == F.lit(time)) & tie) if time is not None else F.lit(True)
        served = served.withColumn(f"taken_{k}", F.when(F.col("size") == 0, 0).when(here, F.lit(taken)).when(all_of, F.col("size")).otherwise(0).cast("long"))
    parts = [f"taken_{k}" for k in range(1, PASSES + 1)]
    return served.select("doc_id", "size", "source", "source_size", "target", sum(map(F.col, parts)).alias("taken"), *parts, *keep)


def cut(served: DataFrame, budget: int) -> tuple[float | None, str | None, int]:
    """Virtual time and source of the document in which the budget ends, and the words taken of it.

    All offers are sorted globally by range; the words of the ranges say in which the budget ends, and within that range
    the running sum says where.
    """
    offers = served.where("size > 0").select("source", "size", F.explode(F.array(*[f"finish_{k + 1}" for k in range(PASSES)])).alias("at"))
    order = (F.col("at"), F.col("source").asc_nulls_last())
    ranges = max(int(served.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-offers.count() // RANGE))
    line = written(offers.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "line")
    sums = line.groupBy("range").agg(F.sum("size").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy("range")))
    last = sums.where(F.col("end") >= budget).orderBy("range").select("range", (F.col("end") - F.col("n")).alias("before")).first()
    if last is None:
        drop(line)
        return None, None, 0
    end = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(last["before"])
    row = line.where(F.col("range") == last["range"]).withColumn("end", end).where(F.col("end") >= budget).orderBy("end").first()
    drop(line)
    return row["at"], row["source"], row["size"] - (row["end"] - budget)


def row_keys(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """KEYS of a row: hashes of its text and of its other columns, equal only for rows that are equal throughout."""
    text = F.col(text_col).cast("string")
    # a hash skips nulls, so which columns are null is hashed with them
    others = [c for c in docs.columns if c != text_col]
    values = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes if c in others]
    return {KEYS[0]: F.coalesce(F.md5(text.cast("binary")), F.lit("")), KEYS[1]: F.xxhash64(*values, *[F.col(c).isNull() for c in others])}


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row for each time a document is taken.

    The one document that the budget cuts keeps its first words, joined by spaces. Columns are those of ``docs``.
    """
    # the row is a struct, so that none of its columns can bear a name that is used here
    keys = [k.alias(name) for name, k in row_keys(docs, text_col).items()]
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *keys)
    took = written(queue(keyed, weights, share, keep=KEYS).where("taken > 0"), "took")
    took = took.select(*KEYS, F.explode(F.array(*[f"taken_{k}" for k in range(1, PASSES + 1)])).alias("taken_words"), F.col("size").alias("taken_of")).where("taken_words > 0")
    # equal rows are one row here and as many in the queue, so that each of those finds one
    once = keyed.select(*KEYS, "doc")
    if keyed.groupBy(*KEYS).count().where("count > 1").limit(1).count():
        once = once.groupBy(*KEYS).agg(F.first("doc").alias("doc"))
    out = once.join(took, list(KEYS)).select("doc", "taken_words", "taken_of")
    whole = F.col("doc")[text_col]
    text = F.when(F.col("taken_words") < F.col("taken_of"), F.array_join(F.slice(words(whole), 1, F.col("taken_words").cast("int")), " ")).otherwise(whole)
    return out.select(*[(text if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE.replace("[", "[^", 1)}')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(md5(text), ''))) AS mark FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM levels),
served AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY mark, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS words FROM sized),
passes AS (
  SELECT s.doc_id, s.size, g.source, g.source_size, g.target, p.k, CASE WHEN g.target > 0 THEN CAST(s.words + p.k * g.source_size AS DOUBLE) / g.target ELSE 0 END AS finish
  FROM served s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source, (VALUES (0), (1)) p(k)),
line AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, doc_id, k ROWS UNBOUNDED PRECEDING) AS done, (SELECT CAST(floor(1.5 * sum(source_size)) AS BIGINT) FROM sources) AS budget FROM passes WHERE size > 0)
SELECT s.doc_id, s.size, g.source_size, g.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
LEFT JOIN (SELECT doc_id, sum(greatest(0, least(size, size - (done - budget)))) AS taken FROM line GROUP BY doc_id) t ON t.doc_id = s.doc_id
"""
