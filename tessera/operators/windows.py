"""Count windows over token streams: moving-average type/token ratio, buckets, runs and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def window_types(tokens: DataFrame, size: int, stride: int, by: tuple[str, ...], pos: str = "gpos", token: str = "token", group: int = 64) -> DataFrame:
    """(by, k, types, c): distinct and all tokens of window k = [k * stride, k * stride + size).

    Tokens are shuffled once, by groups of neighbouring windows (twice where windows of two groups overlap). There a token is new to
    the windows that begin after its last occurrence, so what is summed are flags, not strings. A group is bounded by its windows'
    tokens: a stream with a third of all tokens is many groups."""
    low, high = F.greatest(F.lit(0), F.ceil((F.col("__p") - (size - 1)) / stride)), F.floor(F.col("__p") / stride)
    rows = tokens.select(*by, F.col(pos).alias("__p"), F.col(token).alias("__t"))
    rows = rows.withColumn("__g", F.explode(F.sequence(F.floor(low / group), F.floor(high / group)))).repartition(*by, "__g")
    first, last = F.greatest(low, F.col("__g") * group), F.least(high, F.col("__g") * group + (group - 1))
    before = F.coalesce(F.lag("__p").over(Window.partitionBy(*by, "__g", "__t").orderBy("__p")), F.lit(-1))
    rows = rows.withColumn("__before", before).select(*by, "__g", "__before", F.explode(F.sequence(first, last)).alias("k"))
    types = rows.groupBy(*by, "__g", "k").agg(F.count(F.when(F.col("__before") < F.col("k") * stride, 1)).alias("types"), F.count("*").alias("c"))
    return types.drop("__g")


def mattr(tokens: DataFrame, size: int = 2000, stride: int = 1000, by: tuple[str, ...] = (), pos: str = "gpos", token: str = "token") -> DataFrame:
    """(by, windows, mattr) of streams whose tokens carry their position.

    Window k covers [k * stride, k * stride + size). A full one counts its type/token ratio with weight 1. What is left at the
    end is one partial window, from the start after the last full one; it adds types / size to the sum and tokens / size to the
    weight, unless there are full windows and it holds nothing but their overlap."""
    types = window_types(tokens, size, stride, by, pos, token)
    # a window is full, or the rest, or (within the last full one) neither; the stream's length follows from its last window
    k = F.col("k")
    total = types.groupBy(*by).agg(F.max(k * stride + F.col("c")).alias("n"))
    total = total.withColumn("full", F.when(F.col("n") >= size, F.floor((F.col("n") - size) / stride) + 1).otherwise(F.lit(0)))
    both = types.join(total, list(by)) if by else types.crossJoin(F.broadcast(total))
    full = k < F.col("full")
    rest = (k == F.col("full")) & ~((F.col("full") > 0) & (F.col("c") == size - stride))
    s = F.sum(F.when(full, F.col("types") / size).when(rest, F.col("types") / size))
    w = F.sum(F.when(full, F.lit(1.0)).when(rest, F.col("c") / size))
    return both.groupBy(*by).agg(F.sum(F.when(full | rest, 1).otherwise(0)).alias("windows"), (s / w).alias("mattr"))


def global_rank(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """df with its rows' numbers, from 0, in the order of all rows: ranged over tasks, ranked in each, and moved by the sizes of the
    ranges before (as many as there are partitions). No task sees more than its range."""
    from tessera.sources.artifacts import checkpoint

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpoint(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__i", inside).join(F.broadcast(sizes), "__p").withColumn(out, (F.col("__i") + F.col("__base")).cast("long")).drop("__p", "__i", "__base")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, span: int = 4096) -> DataFrame:
    """df with the running sum of value per key, in order (the first of which is a number or a time), this row included.

    Sums per key and span of the order come first, so that a key with very many rows is spread over many tasks."""
    at = F.col(order[0])
    at = at.cast("timestamp").cast("double") if dict(df.dtypes)[order[0]].startswith("timestamp") else at
    rows = df.withColumn("__s", F.floor(at / span)).withColumn("__v", value)
    spans = rows.groupBy(*keys, "__s").agg(F.sum("__v").alias("__m"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__base", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inside = Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__r", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return rows.join(spans, [*keys, "__s"]).withColumn(out, F.col("__r") + F.col("__base")).drop("__s", "__v", "__r", "__base")


def buckets(df: DataFrame, key: str | list[str], order: str | list[str], every: int, weight: str | None = None) -> DataFrame:
    """df with bucket: the number of whole `every` observations of the key before this one, in order (see `running`)."""
    keys, orders = ([x] if isinstance(x, str) else x for x in (key, order))
    seen = running(df, keys, orders, F.col(weight) if weight else F.lit(1), "__seen")
    return seen.withColumn("bucket", F.floor((F.col("__seen") - 1) / every)).drop("__seen")


def collapse_runs(df: DataFrame, value: str, order: str, by: tuple[str, ...] = (), only: str | None = None, span: int = 4096) -> DataFrame:
    """Rows whose value differs from the one before (or isn't `only`, if that is given). order is a whole number.

    Runs are cut at spans of the order, each a window of its own; of a span, only the first row looks at the last value of the
    spans before, which are one row each."""
    rows = df.withColumn("__s", F.floor(F.col(order) / span))
    inside = Window.partitionBy(*by, "__s").orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(inside)).withColumn("__before", F.lag(value).over(inside))
    ends = rows.groupBy(*by, "__s").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__end"))
    across = Window.partitionBy(*by).orderBy("__s")
    ends = ends.select(*by, "__s", F.lag("__end").over(across).alias("__end"))
    rows = rows.join(ends.where("__end is not null"), [*by, "__s"], "left")
    first = (F.col("__i") == 1) & F.col("__end").isNull()
    before = F.when(F.col("__i") > 1, F.col("__before")).otherwise(F.col("__end.v"))
    same = F.col(value).eqNullSafe(before) & (F.lit(True) if only is None else F.col(value) == only)
    return rows.withColumn("__keep", first | ~F.coalesce(same, F.lit(False))).where("__keep").select(*df.columns)


def zip_offset(arr: Column, k: int) -> Column:
    """Pairs of element i and element i + k."""
    n = F.greatest(F.size(arr) - k, F.lit(0))
    # the array is evaluated outside of the lambda, so once a row and not once an element
    return F.zip_with(F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(k + 1), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def periodic(df: DataFrame, pos: str, period: int, choices: int) -> DataFrame:
    """df with choice: which of the alternatives is on at this position, changing every `period` positions."""
    return df.withColumn("choice", F.floor(F.col(pos) / period) % choices)


def top_by(df: DataFrame, n: int, order: list[Column], by: tuple[str, ...]) -> DataFrame:
    """The first n rows of every group (a window-group limit keeps the shuffle small)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
