"""Mixing sources to target weights by capped water-filling.

The control tables have one row per source, or per source and slice of the seeded order; documents themselves are
never shuffled. Only DataFrame functions run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import WORD, bounded_broadcast, cut, spread

#: Salts for a table of sources too long to broadcast.
SALTS = 64


@dataclass(frozen=True)
class Mixture:
    """sizes: a row per document. sources: a row per source, with its target and the edge of its extra repetition."""

    sizes: DataFrame
    sources: DataFrame
    seed: int


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """The document's place in the seeded order, the same on every run and in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds target: each source's share of all sizes by weight, at most max_epochs times its own size.

    sources: source, source_size. Weights go to sources by code point, null last, repeating. What a clamped source
    cannot take is shared anew among the others by weight, until none is above its limit. Sorted by the level at which
    each source meets its limit, the clamped ones are a prefix, so running sums give the fixed point of those rounds
    at once: a source is clamped if the level left by those before it reaches its own.
    The windows run over one row per source, in one task: a table of a million sources is some 30 MB.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("meets", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    return (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long"))
        .withColumn("limit", F.col("source_size") * max_epochs)
        .withColumn("meets", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("free", F.col("limit") * F.col("share") > F.col("weight") * F.col("left"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct("meets", "left", "share"))).over(total))
        .withColumn(
            "target",
            F.when(F.col("free"), F.col("weight") * F.col("level.left") / F.col("level.share")).otherwise(F.col("limit").cast("double")),
        )
        .select("source", "source_size", "weight", "target")
    )


def plan_mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, slice_digits: int = 3) -> Mixture:
    """Targets of all sources, and where each source's fractional repetition ends.

    A source takes every document floor(target / size) times, and once more the documents that come first in the
    seeded order, as far as the rest of the target reaches: the document on the edge is taken if more than half of it
    is within. The edge is found in two steps, by slice of the order and then inside one slice, so that no source's
    rows meet in one task.

    docs: doc_id, text, source; other columns are ignored. Null texts and texts without words have size 0; a null
    source is a source of its own, the last; a null doc_id has one fixed place in the order; rows of one doc_id and
    source are taken together. No documents: no sources.
    """
    sizes = cut(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("place")), "mix-sizes"
    ).withColumn("slice", F.substring("place", 1, slice_digits))
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = water_fill(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    sources = sources.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")).withColumn(
        "quota", F.col("target") - F.col("whole") * F.col("source_size")
    )
    sources = cut(sources, "mix-sources")

    in_order = Window.partitionBy("source").orderBy("slice")
    last = (
        _with_source(slices, sources.select("source", "quota"))
        .withColumn("before", F.sum("slice_size").over(in_order) - F.col("slice_size"))
        .filter((F.col("quota") > 0) & (F.col("before") <= F.col("quota")) & (F.col("before") + F.col("slice_size") > F.col("quota")))
        .select("source", "slice", "before", "quota")
    )
    inside = Window.partitionBy("source").orderBy("place", "doc_id")
    last = cut(last.select(F.col("source").alias("s"), F.col("slice").alias("b"), "before", "quota"), "mix-slices")
    few = bounded_broadcast(last)
    edges = (
        sizes.join(last if few is None else few, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("b")))
        .groupBy("source", "place", "doc_id", "before", "quota")
        .agg(F.sum("size").alias("size"))
        .withColumn("prior", F.col("before") + F.sum("size").over(inside) - F.col("size"))
        .filter((F.col("prior") <= F.col("quota")) & (F.col("prior") + F.col("size") > F.col("quota")))
        .select(F.col("source").alias("edge_source"), F.struct("place", "doc_id").alias("edge"), (2 * F.col("prior") + F.col("size") <= 2 * F.col("quota")).alias("edge_in"))
    )
    sources = sources.join(edges, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    return Mixture(sizes, cut(sources, "mix-edges"), seed)


def _with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df with its source's columns. Few sources are broadcast; more are joined on source and a salt."""
    sources = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if (few := bounded_broadcast(sources)) is not None:
        return df.join(few, same).drop("_source")
    salted = sources.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("_salt") == F.col("_salt_r"))).drop("_source", "_salt", "_salt_r")


def with_repeats(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """docs with source_size and target of its source, and repeats: how often the mix takes the document.

    Columns of docs named like those replace nothing: they are dropped first.
    """
    kept = [c for c in docs.columns if c not in ("source_size", "target", "repeats")]
    rows = docs.select("doc_id", "source", F.struct(*kept).alias("_row"))
    key = F.struct(draw(F.col("doc_id"), mixture.seed).alias("place"), F.col("doc_id"))
    extra = F.coalesce((key < F.col("edge")) | ((key == F.col("edge")) & F.col("edge_in")), F.lit(False))
    joined = _with_source(rows, mixture.sources.select("source", "source_size", "target", "whole", "edge", "edge_in"))
    return joined.select("_row.*", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("repeats"))


def sample_mixture(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of docs."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_all"))
    taken = with_repeats(rows, plan_mixture(docs, **settings)).filter("repeats > 0")
    return taken.select("_all", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))).select("_all.*")


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in words."""
    mixture = plan_mixture(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    rows = with_repeats(mixture.sizes.drop("slice", "place"), mixture)
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight
  FROM d GROUP BY source
), m AS (
  SELECT *, source_size * 3 AS lim, (source_size * 3)::DOUBLE / weight AS meets FROM s
), c AS (
  SELECT *,
    (sum(source_size) OVER ())::BIGINT - coalesce(sum(lim) OVER before, 0)::BIGINT AS remaining,
    (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER before, 0)::BIGINT AS share
  FROM m WINDOW before AS (ORDER BY meets, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT *, lim * share > weight * remaining AS free FROM c
), l AS (SELECT remaining AS l_remaining, share AS l_share FROM f WHERE free ORDER BY meets, remaining, share LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN free THEN (weight * l_remaining)::DOUBLE / l_share ELSE lim::DOUBLE END AS target
  FROM f LEFT JOIN l ON true
), w AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM t
), o AS (
  SELECT d.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS quota,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id)::BIGINT - d.size AS prior
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), r AS (
  SELECT *, whole + (quota > 0 AND (prior + size <= quota OR (prior <= quota AND 2 * prior + size <= 2 * quota)))::BIGINT AS repeats
  FROM o
)
SELECT doc_id, source, size, source_size, target, repeats, repeats * size AS taken FROM r
"""
