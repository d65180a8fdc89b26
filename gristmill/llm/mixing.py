"""Mixing sources to target weights by systematic sampling.

Every document has its expected copies; a prefix sum of these within the source, plus one random offset for each
source, is compared with the integers, and a document is emitted once for each integer that its step crosses.
Documents stand in the order of their sizes, large ones first. A document's expected copies are what is left of the
source's target over what is left of its size: the first HEAD documents of a source carry what they took too much or
too little on to the smaller ones one by one, and those after them share the rest evenly. A document that is longer
than what is left isn't expected. So the words taken miss the target by about the size of a source's last documents,
or of its HEAD-th.

Cases: a null text has size 0 and is never emitted; a null source is a source of its own, last in order; sources of
size 0 have target 0 and none taken; repeated rows are sampled as rows of their own; rows of one doc_id and size stand
in the order of their texts' hashes; an empty table gives an empty result; apply_mix keeps columns of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import HOT, cut, fresh, global_rank, look_up, table, word_count

WEIGHTS = (5, 2, 1)
#: A source is used this often at most.
MOST = 3
SEED = "mix-1"
#: Documents of a source whose copies depend on those before them.
HEAD = 256


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: a row per source with `source` and source_size. Adds target: shares of the total by weight, weights
    repeating over the sources by code point, null last; what exceeds `most` times a source's size is shared
    again by weight among the others until none is above. Each round is one aggregation with a one-row result;
    sources are ranked without bringing them to one task."""
    ranked = cut(global_rank(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col(source).asc_nulls_last()], "_rank").drop("_all"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", pick.cast("long")).drop("_rank")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    # level: words for each unit of weight, as the fraction rest / left
    rest, left = total, ranked.agg(F.sum("_weight")).first()[0] or 1
    while True:
        capped = F.lit(most) * F.col("source_size") * F.lit(left) <= F.col("_weight") * F.lit(rest)
        full, weight = ranked.agg(F.sum(F.when(capped, most * F.col("source_size"))), F.sum(F.when(~capped, F.col("_weight")))).first()
        now = (total - (full or 0), weight)
        if weight is None or now == (rest, left):
            break
        rest, left = now
    level = F.col("_weight") * F.lit(float(rest)) / F.lit(float(left))
    return ranked.withColumn("target", F.least(most * F.col("source_size").cast("double"), level)).drop("_weight")


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) for each source, drawn by a digest of seed and source, so that reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\0")))), 1, 8), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 32))


def _expected(left: Column, size: Column, most: int, own: Column | None = None) -> Column:
    """Expected copies: `left`, the words still to take, over `size`, the words still there. A document of `own` words
    isn't expected more often than fits into what is left; a source's last one has the nearest whole number."""
    even = F.greatest(F.lit(0.0), left / size)
    if own is not None:
        fit = F.floor(left / own + F.when(size > own, 0.0).otherwise(0.5)).cast("double")
        fit = F.greatest(F.lit(0.0), fit)
        even = F.when(own > 0, F.when(size > own, F.least(even, fit)).otherwise(fit)).otherwise(0.0)
    return F.when(size > 0, F.least(F.lit(float(most)), even)).otherwise(F.lit(0.0))


def _copies(before: Column, after: Column, most: int) -> Column:
    """Integers crossed; rounding of the sums can't add one."""
    return F.least(F.lit(most).cast("long"), F.floor(after) - F.floor(before))


def _mixed(light: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """light: doc_id, source, size, _hash and other columns, behind a checkpoint. Adds source_size, target, copies."""
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    sizes = cut(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    hot = sizes.filter(F.col("_rows") * HOT > total).select(name.alias("_name"))
    plan = cut(targets(sizes.select("source", "source_size"), "source", weights, most)).select(name.alias("_name"), "source_size", "target", offset(F.col("source"), seed).alias("_offset"))
    ranked = global_rank(light, ["source"], [F.desc("size"), F.col("doc_id").asc_nulls_last(), F.col("_hash")], "_rank").withColumn("_name", name)

    # the first ones of each source, at most HEAD, are folded in order
    doc = F.struct("_rank", *light.columns)
    state = lambda t, s, at, out: F.struct(t.alias("t"), s.alias("s"), at.alias("at"), out.alias("out"))

    def fold(old: Column, d: Column) -> Column:
        after = old.at + _expected(old.t, old.s, most, d.size)
        copies = _copies(old.at, after, most)
        return state(old.t - (copies * d.size).cast("double"), old.s - d.size, after, F.concat(old.out, F.array(copies)))

    heads = ranked.filter(F.col("_rank") < HEAD).groupBy("_name").agg(F.array_sort(F.collect_list(doc)).alias("_docs")).join(plan, "_name")
    start = state(F.col("target"), F.col("source_size"), F.col("_offset"), F.array().cast("array<bigint>"))
    heads = cut(heads.withColumn("_end", F.aggregate("_docs", start, fold)))
    first = heads.select("source_size", "target", F.explode(F.arrays_zip("_docs", F.col("_end.out").alias("_copies"))).alias("_one"))
    first = first.select(*[F.col("_one._docs")[c].alias(c) for c in light.columns], "source_size", "target", F.col("_one._copies").alias("copies"))

    # the others share what is left
    ends = heads.select("_name", "source_size", "target", F.col("_end.at").alias("_at"), _expected(F.col("_end.t"), F.col("_end.s"), most).alias("_step"))
    rest = look_up(ranked.filter(F.col("_rank") >= HEAD), "_name", ends, hot, place=F.col("_rank").cast("string"))
    reach = lambda k: F.col("_at") + k * F.col("_step")
    rest = rest.withColumn("copies", _copies(reach(F.col("_rank") - HEAD), reach(F.col("_rank") - HEAD + 1), most))
    return first.unionByName(rest.select(*first.columns))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """A row per document with doc_id, source, size, source_size, target and copies."""
    light = cut(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("_hash")))
    return _mixed(light, weights, most, seed).drop("_hash")


def apply_mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies. Rows are numbered and written to a
    checkpoint once; they then meet their copies by number, so that texts are shuffled once and no key is hot."""
    n, own, c, nth = fresh(df, "_number", "_own", "_copies", "_nth")
    base = cut(df.withColumn(n, F.monotonically_increasing_id()))
    light = cut(base.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("_hash"), F.col(n).alias("_number")))
    taken = _mixed(light, weights, most, seed).filter("copies > 0").select(F.col("_number").alias(own), F.col("copies").cast("int").alias(c))
    given = base.join(taken, F.col(n) == F.col(own)).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(c))))
    return given.select(*[F.col(f"`{x}`") for x in df.columns])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same law by DuckDB. The level is where capped sources, those with the least size to weight, stop.
OP3_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::BIGINT AS weight FROM sizes),
capped AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(3 * source_size) OVER o, 0) AS before_size, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest_weight
  FROM weighted WINDOW o AS (ORDER BY 3.0 * source_size / weight, source_size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, left_weight FROM (SELECT (total - before_size)::DOUBLE AS rest, rest_weight::DOUBLE AS left_weight,
    3.0 * source_size * rest_weight > weight * (total - before_size) AS open, 3.0 * source_size / weight AS stop, source_size, source FROM capped)
  WHERE open ORDER BY stop, source_size, source LIMIT 1),
plan AS (SELECT source, source_size, least(3 * source_size::DOUBLE, weight * (SELECT rest FROM level) / (SELECT left_weight FROM level)) AS target FROM weighted),
ranked AS MATERIALIZED (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id NULLS LAST) - 1 AS k FROM docs d),
heads AS MATERIALIZED (SELECT source, size, k FROM ranked WHERE k < 256),
fold(source, k, t, s, acc, copies) AS (
  SELECT source, 0::BIGINT, target, source_size, ('0x' || substr(md5('mix-1:' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0, NULL::BIGINT FROM plan
  UNION ALL
  SELECT source, k + 1, t - (c * size)::DOUBLE, s - size, acc + step, c FROM (
    SELECT *, least(3, floor(acc + step) - floor(acc))::BIGINT AS c FROM (
      SELECT f.source, f.k, t, s, acc, size, CASE WHEN s > 0 AND size > 0 THEN least(3.0::DOUBLE, CASE WHEN s > size
        THEN least(greatest(0.0::DOUBLE, t / s), greatest(0.0::DOUBLE, floor(t / size))) ELSE greatest(0.0::DOUBLE, floor(t / size + 0.5)) END) ELSE 0.0::DOUBLE END AS step
      FROM fold f JOIN heads h ON h.source IS NOT DISTINCT FROM f.source AND h.k = f.k))),
ends AS (SELECT *, CASE WHEN s > 0 THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, t / s)) ELSE 0.0::DOUBLE END AS step FROM fold)
SELECT r.doc_id, r.size, p.source_size, p.target,
  CASE WHEN r.k < 256 THEN f.copies ELSE least(3, floor(f.acc + (r.k - 255) * f.step) - floor(f.acc + (r.k - 256) * f.step))::BIGINT END * r.size AS taken
FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source JOIN ends f ON f.source IS NOT DISTINCT FROM r.source AND f.k = least(r.k + 1, 256)
"""

QUERIES = {"op3_source_mix": op3_source_mix}
SQL = {"op3_source_mix": OP3_SQL}
