"""Sharding by proportional stratified interleaving: every shard holds every source's share of the rows.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of its source.
In the order of fractional ranks the sources are interleaved in proportion, so any stretch of it has the mixture of the whole, and
shards are equal stretches. Ranks come from sorts in ranges: a range knows how many rows lie before it, so neither a source nor
the whole table passes through one task. Only ids, sources, sizes and checksums are sorted, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of, unused

SHARDS, SEED = 8, 42


def seeded_key(c: Column, seed: int) -> Column:
    """64 bits of md5 of seed and value as hexadecimal text, so that any engine shuffles alike; null counts as empty."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(c.cast("string"), F.lit("")))), 1, 16)


def in_ranges(df: DataFrame, order: list[str], part: str, place: str, scratch: Scratch) -> DataFrame:
    """df sorted in ranges and written, with the number of each row's range and its place there from 0."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.table(ranges.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias(place)))


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, source, ``size``, ``text_crc32``, ``fraction``, ``shard``, ``slot``, and the carried columns.

    size is the text's UTF-8 bytes plus one, text_crc32 their checksum; a null text counts as empty. The law is that of rows: shards' row
    counts are at most one apart, and slots run from 0 without a gap. Null
    sources are a stratum of their own, after the others in the order; null ids come after others of an equal key. Rows that repeat an id
    are rows of their own, ordered by checksum and size; what is equal in all these may swap places. An empty
    table gives an empty one, and with fewer rows than shards some shards are empty. Columns of docs that aren't named play no part;
    a carried column that has the name of a made one is refused.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    made = ["size", "text_crc32", "fraction", "shard", "slot"]
    clash = {c.lower() for c in carry} & {c.lower() for c in (*made, id_col, source_col)}
    if clash:
        raise ValueError(f"these columns can't be carried: {sorted(clash)}")
    key, part, place, first, before, total, start = unused(docs.select(id_col, source_col, *carry), "key", "part", "place", "first", "before", "total", "start")
    scratch = Scratch(docs.sparkSession)
    text = F.encode(text_of(text_col), "UTF-8")
    thin = scratch.table(docs.select(F.col(id_col), F.col(source_col), *carry, (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), seeded_key(F.col(id_col), seed).alias(key)))
    nulls_last = [F.col(source_col).isNull(), F.col(source_col), F.col(key), F.col(id_col).isNull(), F.col(id_col), F.col("text_crc32"), F.col("size")]

    ranked = in_ranges(thin, nulls_last, part, place, scratch)
    # One row for each source in each range; a source's window has no more rows than there are ranges.
    cells = ranked.groupBy(source_col, part).agg(F.min(place).alias(first), F.count(F.lit(1)).alias(total))
    earlier = F.coalesce(F.sum(total).over(Window.partitionBy(source_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum(total).over(Window.partitionBy(source_col))
    cells = scratch.table(cells.select(F.col(source_col).alias(start), F.col(part).alias(before), (earlier - F.col(first)).alias(first), whole.alias(total)))
    met = ranked.join(cells, (F.col(part) == F.col(before)) & F.col(source_col).eqNullSafe(F.col(start)))
    rank = F.col(place) + F.col(first)
    fractions = scratch.table(met.select(id_col, source_col, *carry, "size", "text_crc32", key, ((2 * rank + 1).cast("double") / (2 * F.col(total)).cast("double")).alias("fraction")))

    mixed = in_ranges(fractions, [F.col("fraction"), *nulls_last], part, place, scratch)
    sizes = sorted((r[0], r[1]) for r in mixed.groupBy(part).agg(F.count(F.lit(1)).alias(total)).collect())  # one row a range
    starts, n = [], 0
    for number, rows in sizes:
        starts.append((number, n))
        n += rows
    offsets = docs.sparkSession.createDataFrame(starts or [(0, 0)], f"{before} int, {start} long")
    at = F.col(start) + F.col(place)
    numbered = mixed.join(F.broadcast(offsets), F.col(part) == F.col(before)).withColumn(place, at)
    shard = F.expr(f"({place} * {shards}L) div {max(1, n)}L").cast("int")
    # Shard s starts at the first place p with p * shards >= s * n.
    slot = F.col(place) - F.expr(f"(shard * {max(1, n)}L + {shards - 1}L) div {shards}L")
    return numbered.select(id_col, source_col, *carry, "size", "text_crc32", "fraction", shard.alias("shard"), place).withColumn("slot", slot).drop(place)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> DataFrame:
    """Writes all columns of docs, shard by shard in the order of slots, and returns the written table with ``shard`` and ``slot``.

    The id, text and source columns are those of assign_shards' options.
    """
    id_col, source_col = options.get("id_col", "doc_id"), options.get("source_col", "source")
    rest = tuple(c for c in docs.columns if c not in (id_col, source_col))
    placed = assign_shards(docs, shards, carry=rest, **options).drop("size", "text_crc32", "fraction")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)
