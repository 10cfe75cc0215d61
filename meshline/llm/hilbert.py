"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS order-preserving codes, the codes become
one index on the curve, rows are sorted by it and the order is cut into runs of
equal counts. Rows near each other on the curve are near in every dimension, so
each shard spans a small part of each and a filter on any of them skips shards.

Everything is DataFrame functions. A row's place comes from its range partition
and its place inside (``monotonically_increasing_id``), written down before it
is used, plus the rows of the partitions before: no window over all rows.

Defined cases: a null text has size 1 and crc 0; a null in a dimension is its
lowest code; equal rows get slots of their own; an empty table gives no rows;
with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from meshline.llm.common import exact
from meshline.session import cut

BITS = 8
#: The most borders between codes that a dimension takes: the most frequent strings, or quantiles of numbers.
BORDERS = 255


def borders(rows: DataFrame, column: str) -> list:
    """Sorted borders of the codes of one dimension; at most BORDERS values.
    Numbers: approximate quantiles. Strings: the most frequent values."""
    if isinstance(rows.schema[column].dataType, T.NumericType):
        found = rows.agg(F.percentile_approx(F.col(column).cast("double"), [k / (BORDERS + 1) for k in range(1, BORDERS + 1)], 10_000).alias("q")).first()["q"]
        return sorted(set(found or []))
    top = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(BORDERS)
    return sorted(r["v"] for r in top.collect())


def code(value: Column, cuts: list, numeric: bool) -> Column:
    """How many borders are at or below `value`, spread over 0 .. 2**BITS - 1."""
    if not cuts:
        return F.lit(0)
    cast = value.cast("double" if numeric else "string")
    below = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= cast))
    return F.when(value.isNull(), 0).otherwise((below * ((1 << BITS) - 1) / len(cuts)).cast("int"))


def hilbert_index(codes: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a point with `bits` bits in each
    dimension: Skilling's transform (AIP Conf. Proc. 707, 2004) over the bits,
    then the bits of the dimensions interleaved."""
    n = len(codes)
    both = lambda a, b: a.bitwiseAND(b)
    names = [f"x{i}" for i in range(n)]
    point = F.struct(*(c.cast("int").alias(k) for c, k in zip(codes, names)))

    def turn(acc: Column, q: Column) -> Column:
        x, p = [acc[k] for k in names], q - 1
        for i in range(n):
            hit = both(x[i], q) != 0
            if i == 0:
                x[0] = F.when(hit, x[0].bitwiseXOR(p)).otherwise(x[0])
            else:
                t = both(x[0].bitwiseXOR(x[i]), p)
                x[0], x[i] = F.when(hit, x[0].bitwiseXOR(p)).otherwise(x[0].bitwiseXOR(t)), F.when(hit, x[i]).otherwise(x[i].bitwiseXOR(t))
        return F.struct(*(v.alias(k) for v, k in zip(x, names)))

    def gray(acc: Column) -> Column:
        x = [reduce(xor_columns, [acc[k] for k in names[: i + 1]]) for i in range(n)]
        flip = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), F.struct(F.lit(0).alias("t"), x[-1].alias("last")), lambda a, q: F.struct(F.when(both(a["last"], q) != 0, a["t"].bitwiseXOR(q - 1)).otherwise(a["t"]).alias("t"), a["last"].alias("last")), lambda a: a["t"])
        return F.struct(*(v.alias(k) for v, k in zip(x, names)), flip.alias("flip"))

    turned = F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))), point, turn, gray)
    bit_of = lambda s, i, b: F.shiftright(s[names[i]].bitwiseXOR(s["flip"]), b).bitwiseAND(1).cast("long")
    return F.transform(F.array(turned), lambda s: reduce(lambda a, b: a + b, [F.shiftleft(bit_of(s, i, b), b * n + n - 1 - i) for b in range(bits) for i in range(n)]))[0]


def xor_columns(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def shard(docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = ("size", "lang", "source"), doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert) of all
    rows; shards differ by at most one row. `dimensions` are columns of `docs`
    or `size`; those that `docs` lacks are left out. carry: the whole row comes
    along as `row`, for writing shards with partitionBy("shard")."""
    raw = F.coalesce(exact(docs, text).cast("binary"), F.lit(b""))
    used = [d for d in dimensions if d == "size" or d in docs.columns]
    columns = [exact(docs, doc_id).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32")]
    columns += [exact(docs, d).alias(f"dim{k}") for k, d in enumerate(used) if d != "size"]
    if carry:
        columns.append(F.struct(*(exact(docs, c) for c in docs.columns)).alias("row"))
    narrow = cut(docs.select(*columns), "hilbert-rows")
    names = ["size" if d == "size" else f"dim{k}" for k, d in enumerate(used)]
    codes = [code(F.col(c), borders(narrow, c), isinstance(narrow.schema[c].dataType, T.NumericType)) for c in names]
    index = hilbert_index(codes) if codes else F.lit(0).cast("long")
    kept = ["doc_id", "size", "text_crc32"] + ["row"] * carry
    indexed = narrow.select(*kept, index.alias("hilbert")).withColumn("seen", F.monotonically_increasing_id())
    order = ["hilbert", "doc_id", "text_crc32", "seen"]  # `seen` lets equal rows lie in several partitions
    placed = cut(indexed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("seen"), "hilbert-order")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each range partition
    before = sizes.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    total = placed.count()
    at = placed.withColumn("part", part).join(F.broadcast(before), F.col("part") == F.col("of")).withColumn("place", F.col("before") + inside)
    cuts = at.withColumn("shard", F.expr(f"(place * {shards}) div {max(1, total)}").cast("int"))
    first = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return cuts.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert", *["row"] * carry)


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options: object) -> None:
    """The rows of `docs` as Parquet, a folder for each shard, sorted by slot."""
    placed, folder = shard(docs, shards, carry=True, **options), "__shard"
    while folder.lower() in (c.lower() for c in docs.columns):
        folder += "_"
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
