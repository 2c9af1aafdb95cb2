"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of all rows over its
actual share.  A document's count is the inverse Poisson distribution at a
uniform number made from a hash of the seed, its id and its content, so it depends on nothing
but the document and the rate: runs, retries and partitionings agree.  Rates over
``STEP`` are sums of several Poisson draws, each with its own hash, as
exp(-rate) would vanish.  Documents are exploded by their count, and a hash of
id, copy and seed puts all copies in one global random order.

Defined cases: a null source is a source of its own; a source without a weight
has weight ``default_weight``; weights are relative to the sum over the sources
present; repeated rows draw equal counts; null ids draw by their text;
null and empty texts are documents like others, and texts of any length are one row a copy;
columns named copy, n_copies or shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "mix-1"
STEP = 16.0
#: Distribution function values kept for a rate of at most STEP: beyond, less than 2**-53 is left.
TAIL = 96
#: Sources up to which the table of rates, about a kilobyte a row, is broadcast; beyond, the join is shuffled and its hot keys split.
MAX_BROADCAST = 10_000
#: Copies of one row that one task makes at most.
BLOCK_COPIES = 1000
#: Columns of replicate's own, in lower case; an input column of such a name is replaced.
DEFINED = {"copy", "n_copies", "shuffle_key"}


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None, source_col: str = "source", **options) -> DataFrame:
    """source, rate, draws and the distribution function of one draw.

    Weights come from the given mapping, or with ``temper`` from the sources' own sizes to that power.
    """
    return _rates(docs, weights, source_col, **options)[0]


def _rates(docs: DataFrame, weights: dict[str | None, float] | None, source_col: str, default_weight: float = 1.0, temper: float | None = None, epochs: float = 1.0) -> tuple[DataFrame, int, float]:
    """The table of rates, its number of sources and the greatest rate."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if temper is not None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temper)))
    else:
        weight = F.lit(float(default_weight))
        for name, value in (weights or {}).items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("n").alias("n"), F.count("*").alias("sources"), F.max(F.col("weight") / F.col("n")).alias("most")).first()
    rate = F.lit(float(epochs)) * F.col("weight") / F.lit(total["w"]) * F.lit(float(total["n"] or 0)) / F.col("n")
    draws = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    table = F.aggregate(F.sequence(F.lit(1), F.lit(TAIL)), F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf")), lambda a, k: F.struct((a["p"] * F.col("mean") / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("mean") / k)).alias("cdf")))["cdf"]
    return sizes.withColumn("rate", rate).withColumn("draws", draws).withColumn("mean", F.col("rate") / F.col("draws")).select("source", "rate", "draws", table.alias("cdf")), total["sources"], epochs * (total["most"] or 0.0) / (total["w"] or 1.0) * (total["n"] or 0)


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, shuffle: bool = True, **options) -> DataFrame:
    """The rows, each as often as it was drawn, with copy (from 1), n_copies and shuffle_key, in the key's order."""
    table, sources, most = _rates(docs, weights, source_col, **options)
    table = table.select(F.col("source").alias("__source"), F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf"))
    # the sources were counted: a short table goes to every task, so that a hot source's texts stay where they are
    table = F.broadcast(table) if sources <= MAX_BROADCAST else table
    who = known_as(id_col, text_col)
    joined = docs.join(table, docs[source_col].eqNullSafe(table["__source"]), "left")
    numbers = F.transform(F.sequence(F.lit(1), F.col("__draws")), lambda k: uniform(F.lit(seed), k.cast("string"), who))
    count = F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter("__cdf", lambda c: c <= u)))
    # a generator's output, so that the draws are made once a row
    drawn = joined.withColumn("n_copies", F.explode(F.array(count))).drop("__source", "__draws", "__cdf").where("n_copies > 0")
    if most > BLOCK_COPIES / 4:
        # some row may have very many copies: its range of numbers is dealt out in blocks before they become rows
        blocks = drawn.withColumn("__from", F.explode(F.sequence(F.lit(1), F.col("n_copies"), F.lit(BLOCK_COPIES))))
        drawn = blocks.repartition(F.xxhash64(who, "__from"))
        last = F.least(F.col("n_copies"), F.col("__from") + BLOCK_COPIES - 1)
        out = drawn.withColumn("copy", F.explode(F.sequence(F.col("__from"), last))).drop("__from")
    else:
        out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("shuffle_key", order_key(seed, F.col("copy"), who))
    if not shuffle:
        return out
    # keys are even on their range, so equal parts of it are dealt without a sample
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(parts, F.floor(F.col("shuffle_key") / F.lit(float(1 << 52)) * parts).cast("int")).sortWithinPartitions("shuffle_key")


def order_key(seed: str, copy: Column, who: Column) -> Column:
    """52 bits of an MD5 that put all copies in one random order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), copy.cast("string"), who)), 1, 13), 16, 10).cast("bigint")


def known_as(id_col: str, text_col: str) -> Column:
    """What a document is drawn by: its id, or its text where that is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def in_random_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """Adds shuffle_key, numbering equal rows anew as copies: the global order of rows that were replicated before."""
    who = known_as(id_col, text_col)
    numbered = docs.withColumn("__copy", F.row_number().over(Window.partitionBy(F.col(id_col), F.xxhash64(text_col)).orderBy(F.lit(0))))
    return numbered.withColumn("shuffle_key", order_key(seed, F.col("__copy"), who)).drop("__copy")


def oracle_sql(seed: str = SEED) -> str:
    """The same with equal weights for all sources, as SQL."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rated AS (SELECT source, 1.0::DOUBLE * 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n::DOUBLE AS rate FROM sizes),
means AS (SELECT source, greatest(ceil(rate / {STEP}), 1)::BIGINT AS draws, rate / greatest(ceil(rate / {STEP}), 1) AS mean FROM rated),
table_of AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM table_of WHERE k < {TAIL}),
cdfs AS (SELECT source, list(c ORDER BY k) AS cdf FROM table_of GROUP BY source),
tries AS (SELECT d.doc_id, d.source, d.n_chars, unnest(range(1, m.draws + 1)) AS j FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
counted AS (SELECT t.doc_id, t.source, t.n_chars, t.j,
  len(list_filter(c.cdf, lambda x: x <= ('0x' || substr(md5('{seed}:' || t.j || ':' || t.doc_id), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE)) AS n
  FROM tries t JOIN cdfs c ON t.source IS NOT DISTINCT FROM c.source),
summed AS (SELECT doc_id, source, n_chars, sum(n)::INT AS n_copies FROM counted GROUP BY ALL),
copies AS (SELECT doc_id, source, n_chars, n_copies, unnest(range(1, n_copies + 1))::INT AS "copy" FROM summed WHERE n_copies > 0)
SELECT doc_id, source, n_chars, n_copies, "copy", ('0x' || substr(md5('{seed}:order:' || "copy" || ':' || doc_id), 1, 13))::BIGINT AS shuffle_key FROM copies
"""
