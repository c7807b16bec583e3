"""Sharding along a Hilbert curve over metadata, for pruning files in several dimensions at once.

Every row gets a cell: language and source by their place among all rows in name order (so neighbouring names
share cells), text size on a logarithmic scale, each in 2**BITS steps. Cells are numbered along a Hilbert
curve, rows sorted by that number (then text checksum, then id), and the sequence is cut into runs, one a
shard. Law ``rows``: shard sizes differ by at most one row. The curve keeps near cells in near shards, so a shard's
minima and maxima of each dimension are narrow.

Texts are moved once, by the sort: the cells of languages and sources are sent to them. The sort is a range exchange on all keys: a source or a text that holds a third of the rows spreads over many
tasks. Equal texts of one cell are neighbours and may lie on both sides of a cut, as the law demands.

Defined results: a null text has size 1 and the checksum of an empty one; null languages and sources count as a
name before all others; null or repeated ids only decide ties, rows equal in everything take neighbouring
slots; fewer rows than shards leave shards empty; an empty table gives no rows. Names of added columns win
over equal names in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import ranked, sent

BITS = 5


def name_cells(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(name, cell) of the distinct values of a column: cells of near equal row counts in name order.

    The window runs over one row per distinct value: metadata with far fewer values than rows.
    """
    counts = df.groupBy(F.coalesce(column, F.lit("")).alias("name")).count()
    upto = F.sum("count").over(Window.orderBy("name"))
    middle = (upto - F.col("count") / 2) / F.sum("count").over(Window.partitionBy())
    return counts.select("name", F.least(F.floor(middle * (1 << bits)), F.lit((1 << bits) - 1)).cast("int").alias("cell"))


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Half powers of two: about 40 per cent more bytes a step, saturating at both ends."""
    step = F.floor(F.log2(size.cast("double")) * 2) - 8
    return F.greatest(F.lit(0), F.least(step, F.lit((1 << bits) - 1))).cast("int")


def curve_index(df: DataFrame, axes: list[str], index: str, bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert number of integer columns ``axes`` (each 0 to 2**bits - 1).

    Bit by bit from the top, the part of the grid a cell lies in is turned so that the curve enters and leaves it
    at the right corners; Gray decoding of the turned bits then gives the number.
    """
    names = [f"_h{i}" for i in range(len(axes))]
    df = df.withColumns({n: F.col(a).cast("long") for n, a in zip(names, axes, strict=True)})
    first = names[0]
    for bit in range(bits - 1, 0, -1):
        mask = F.lit((1 << bit) - 1)
        for name in names:
            on = F.shiftright(name, bit).bitwiseAND(F.lit(1)) == 1
            swap = F.col(first).bitwiseXOR(F.col(name)).bitwiseAND(mask)
            turned = {first: F.when(on, F.col(first).bitwiseXOR(mask)).otherwise(F.col(first).bitwiseXOR(swap))}
            if name != first:
                turned[name] = F.when(on, F.col(name)).otherwise(F.col(name).bitwiseXOR(swap))
            df = df.withColumns(turned)
    for before, name in zip(names, names[1:], strict=False):
        df = df.withColumn(name, F.col(name).bitwiseXOR(F.col(before)))
    flips = F.lit(0).cast("long")
    for bit in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(F.shiftright(names[-1], bit).bitwiseAND(F.lit(1)) == 1, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_flips", flips)
    number = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for name in names:
            number = number * 2 + F.shiftright(F.col(name).bitwiseXOR(F.col("_flips")), bit).bitwiseAND(F.lit(1))
    return df.withColumn(index, number).drop("_flips", *names)


def shard(docs: DataFrame, shards: int = 8, carry: list[str] = (), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, curve) per row, with the columns in ``carry`` as they are.

    ``slot`` counts a shard's rows from 0; ``grown_shard`` is null, as this law deals anew when shards are added.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.struct(F.lit(1).alias("one"), *[F.col(c) for c in carry]).alias("kept"),
    )
    for column in ("lang", "source"):
        cells = name_cells(docs.select(F.col(lang_col if column == "lang" else source_col).alias("value")), "value")
        rows = rows.join(sent(cells.select(F.col("name").alias(column), F.col("cell").alias(f"{column}_cell")), f"hilbert-{column}"), column)
    rows = curve_index(rows.withColumn("size_cell", size_cell(F.col("size"))), ["lang_cell", "source_cell", "size_cell"], "curve")
    placed = ranked(rows.select("id", "size", "crc", "curve", "kept"), ["curve", "crc", "id"], "rank", "hilbert")
    total = max(1, placed.count())
    placed = placed.withColumn("shard", F.expr(f"cast(rank * {shards} div {total}L as int)"))
    slot = F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    own = [F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"]
    taken = {id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve"}
    return placed.select(*own, *[F.col("kept").getField(c).alias(c) for c in carry if c not in taken])


def write_shards(docs: DataFrame, path: str, shards: int = 8, **names) -> None:
    """All columns of ``docs`` as Parquet, a folder a shard, each file a range of the shard's slots in order."""
    out = shard(docs, shards, list(docs.columns), **names)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
