"""Reading and shaping recorded ticks: JSON lines (bronze) to flat silver columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import book as B
from ..functions import text as X
from ..functions.num import as_price, finite
from ..schema import CORRUPT, wire_tick
from ..session import cut

DAY_FILES = "ticks_*.jsonl*"
DAY_PATTERN = r"(\d{4}-\d{2}-\d{2})"


def _check(paths) -> list[str]:
    out = [paths] if isinstance(paths, str) else list(paths)
    if not all(isinstance(p, str) for p in out):
        raise TypeError("tick source must be a path or a list of paths")
    return out


def read_ticks(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Valid tick objects only, with ``file``, ``line`` and ``line_no``; blank, malformed and non-object lines are skipped."""
    parsed = parse_lines(read_lines(spark, paths, glob))
    return parsed.filter(F.col("state") == "valid").select("file", "line", "line_no", "tick.*")


#: rows of the table of splits up to which it is sent to every task; beyond it the lines are shuffled by split
SENT_SPLITS = 1_000_000


def numbered(df: DataFrame) -> DataFrame:
    """Rows of line files with ``file``, ``line`` (1-based in the file) and ``line_no`` (0-based over all files in path order).

    One pass counts the lines of every split. Counts summed up along files and over all splits, a row for each, say how
    many lines lie before a split; a line's place in its split is its row in the task less the split's first row there. The size
    of splits follows from the number of cores, which may change between the two passes, so it is pinned for the session, and
    a line whose split was not counted raises an error.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__start")]
    splits = df.select(*where, row.alias("r")).groupBy("file", "__start").agg(F.min("r").alias("__first"), F.count(F.lit(1)).alias("__n"))
    splits = cut(splits, "splits")
    along, over = Window.partitionBy("file").orderBy("__start"), Window.orderBy("file", "__start")
    places = splits.withColumns({"__in_file": F.sum("__n").over(along) - F.col("__n"), "__in_all": F.sum("__n").over(over) - F.col("__n")})
    if splits.count() <= SENT_SPLITS:
        places = F.broadcast(places)
    at = F.col("__row") - F.col("__first")
    at = F.when((at >= 0) & (at < F.col("__n")), at).otherwise(F.raise_error(F.concat(F.lit("lines of a split that was not counted: "), "file")))
    out = df.select("*", *where, row.alias("__row")).join(places, ["file", "__start"], "left").withColumn("__at", at)
    return out.withColumns({"line": F.col("__in_file") + F.col("__at") + 1, "line_no": F.col("__in_all") + F.col("__at")}).drop(*(x for x in out.columns if x.startswith("__")))


def read_lines(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Every physical line with its file, day and place; nothing is dropped."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return numbered(reader.text(_check(paths))).select("value", "file", "line", "line_no", F.regexp_extract("file", DAY_PATTERN, 1).alias("file_day"))


def list_files(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """(file, size_bytes, file_day) of every file; contents are not read. Files of no bytes are left out, as by all readers."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(_check(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size_bytes"))
    return files.withColumn("file_day", F.regexp_extract("file", DAY_PATTERN, 1))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Classify lines as empty / corrupt / valid and parse the valid ones into ``tick``."""
    body = F.trim(F.col("value"))
    schema = wire_tick(with_corrupt=True).simpleString()
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # a generator's output: filters on it are not pushed below, where the line would be parsed a second time
    df = lines.select("*", F.explode(F.array(parsed)).alias("__p"))
    state = F.when(body == "", "empty").when(F.col("__p").isNull() | F.col(f"__p.{CORRUPT}").isNotNull(), "corrupt").otherwise("valid")
    return df.withColumns({"state": state, "tick": F.when(state == "valid", F.col("__p"))}).drop("__p")


def raw_prefilter(lines: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Drop lines whose series and slug strings cannot match, before any JSON parsing.

    A line whose two fields cannot be located textually is kept for the parser to judge.
    """
    series = F.regexp_extract("value", r'"series"\s*:\s*"([^"\\]*)"', 1)
    slug = F.regexp_extract("value", r'"slug"\s*:\s*"([^"\\]*)"', 1)
    unknown = (series == "") | (slug == "")
    return lines.filter(unknown | X.selection_filter(series, slug, F.lit(0), tokens))


def _levels(m: Column, descending: bool) -> Column:
    arr = F.array_sort(B.ladder(m))
    return F.reverse(arr) if descending else arr


def silver_columns() -> list[Column]:
    """Flat quote columns, sorted ladders, token fallbacks; NaN and infinities become NULL."""
    c = F.col
    books = {"up": "up_book", "dn": "down_book"}
    ts, start = X.sane_epoch(c("ts")), X.sane_epoch(c("start_ts"))
    out = {
        "ts_us": F.floor(ts * 1e6 + 0.5).cast("bigint"),
        "el_ms": F.floor((F.floor(ts * 1e6 + 0.5) - start * 1e6) / 1000).cast("bigint"),
        "day": X.day_key(c("start_ts")),
        "up_token": F.coalesce(c("up_token"), c("up_book.token_id")),
        "dn_token": F.coalesce(c("down_token"), c("down_book.token_id")),
        "mid": finite(c("mid")),
        "touch_pair": finite(c("touch_pair")),
        "tape": c("tape_delta"),
    }
    for side, b in books.items():
        out[f"{side}_bid"] = as_price(c(f"{b}.best_bid"))
        out[f"{side}_ask"] = as_price(c(f"{b}.best_ask"))
        out[f"{side}_bids"] = _levels(c(f"{b}.bids"), True)
        out[f"{side}_asks"] = _levels(c(f"{b}.asks"), False)
    keep = ["ts", "series", "duration", "label", "cid", "slug", "start_ts", "end_ts", "err"]
    return [*[c(k) for k in keep], *[v.alias(k) for k, v in out.items()]]


def to_silver(wire: DataFrame) -> DataFrame:
    """Flat ticks; ``file`` and ``line_no`` stay where the reader gave them."""
    return wire.select(*[x for x in ("file", "line", "line_no") if x in wire.columns], *silver_columns())


def _as_map(levels: Column) -> Column:
    return F.map_from_entries(F.transform(levels, lambda x: F.struct(x["price"].cast("string"), x["size"])))


def to_wire(silver: DataFrame, *carry: str) -> DataFrame:
    """The recorded JSON shape of silver ticks, one struct column ``tick`` plus the order columns and those in ``carry``."""
    c = F.col

    def book(side, token):
        return F.struct(
            c(token).alias("token_id"), _as_map(c(f"{side}_bids")).alias("bids"), _as_map(c(f"{side}_asks")).alias("asks"),
            c(f"{side}_bid").alias("best_bid"), c(f"{side}_ask").alias("best_ask"), F.lit(0).alias("malformed"),
        )

    tick = F.struct(
        "ts", F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"), "series", "duration", "label", "cid", "slug",
        "start_ts", "end_ts", (c("end_ts") - c("ts")).alias("t_rem"), book("up", "up_token").alias("up_book"), book("dn", "dn_token").alias("down_book"),
        c("tape").alias("tape_delta"), "mid", "touch_pair", "err",
    )
    return silver.select(*carry, "line_no", X.day_key(c("ts")).alias("file_day"), "event_id", tick.alias("tick"))
