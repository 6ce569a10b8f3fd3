"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.session import checkpoint_root, ship_package
from parley.sources.tables import load_table

# Separators of the plain word rule: space and the five ASCII controls
# tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return load_table(spark, sf_dir, name)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, folder: str) -> str:
    """``folder``, made and qualified by the session's default file system, as
    an address that ``pyarrow.fs`` opens inside tasks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    path = fs.makeQualified(path)
    fs.mkdirs(path)
    name = path.toString()
    return "file://" + name[len("file:") :] if name.startswith("file:/") and not name.startswith("file://") else name


def bind(df: DataFrame, keep: list[str], **exprs: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The expressions are generated from a one-element array, so the optimizer
    neither copies them into later projections and filters nor evaluates them
    again inside a lambda.
    """
    one = F.explode_outer(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))).alias("_bound")
    return df.select(*keep, one).select(*keep, *[F.col(f"_bound.{n}").alias(n) for n in exprs])


def repeated_keys(rows: DataFrame, key: str, per: int = 50_000) -> DataFrame | None:
    """``_again``: the keys that occur more than once (none: null), counted
    map-side; broadcast only while there are few."""
    seen = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    again = cut(seen.select(F.col(key).alias("_again")))
    n = again.count()
    return None if not n else F.broadcast(again) if n <= per else again


def number_equals(rows: DataFrame, key: str, name: str, again: DataFrame | None) -> DataFrame:
    """Add ``name``: 0, 1, ... for the rows that share ``key`` (in any order).

    Keys that occur once, all but those of ``again`` (``repeated_keys``), get 0
    without moving.  The others are written once and numbered inside (key,
    partition), plus the sizes of the key's partitions before, so one key may
    hold any share of the rows.
    """
    if again is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    once = rows.join(again, rows[key] == again["_again"], "left_anti").withColumn(name, F.lit(0).cast("long"))
    many = cut(rows.join(again, rows[key] == again["_again"], "left_semi").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the upper bits are the partition
    runs = many.groupBy(key, part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(key, "_part", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_at")) - 1
    many = many.withColumn("_part", part).withColumn("_in", inside).join(runs, [key, "_part"])
    return once.unionByName(many.withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).select(*rows.columns, name))


def pairs_to_components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a long, b long)``.

    Returns ``node, component`` (smallest node reachable) for every node that
    has a link; other nodes are their own component.  Alternates the two star
    contractions: every node hands its larger neighbours to its smallest
    neighbour, then its smaller ones.  Each half is one pre-aggregated
    minimum per node and one join, so a node of any degree stays spread (AQE
    splits its join rows); the edge list never grows beyond the links given.
    Rounds end when the edges no longer change, after about log(nodes) rounds.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    while True:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("v")))
        low = both.groupBy("n").agg(F.min("v").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("v > n").join(low, "n").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(moved.unionByName(small.select("hi", F.col("m").alias("lo"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == now:
            break
        state = now
    comp = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return comp.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", per: int = 4096, most: int = 50_000) -> DataFrame:
    """``left`` joined to ``right`` (few rows a key) where one key, null
    included, may hold any share of ``left``.

    Keys with more than ``per`` rows are counted map-side; their rows on the
    left are dealt over one salt for every ``per`` rows and their rows on the
    right repeated for each.  ``per`` grows with the table so that fewer than
    ``most`` keys are hot, which bounds their broadcast.  Null keys match
    nothing.  ``left`` must be materialised (``cut``): the salts follow its row
    numbers.
    """
    sizes = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    per = max(per, left.count() // most + 1)
    hot = cut(sizes.where(F.col("_n") > per).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.ceil(F.col("_n") / per).cast("int").alias("_salts")))

    def salts(df: DataFrame) -> DataFrame:
        on = F.lit(True)
        for k in keys:
            on = on & df[k].eqNullSafe(hot[f"_h_{k}"])
        return df.join(F.broadcast(hot), on, "left").drop(*[f"_h_{k}" for k in keys])

    dealt = salts(left.withColumn("_row", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_salt", F.pmod(F.col("_row"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_row", "_salts")
    copied = salts(right).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
