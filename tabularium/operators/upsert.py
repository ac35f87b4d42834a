"""Changes of stored tables, set-based: each gives the table as it stands afterwards. ``overwrite`` stores it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabularium.functions.text import normalize_name
from tabularium.session import stage


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one of greatest order (ties: the greatest row). Null keys are kept as a key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("m"))
    return picked.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest]).select(*df.columns)


def replace_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source replace those of target with the same keys; the others are added. source has one row per key."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def update_columns(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns come from source where it has the key (nulls too), the other columns stay; new keys are added with nulls."""
    s = source.select(*keys, *[F.col(c).alias("__" + c) for c in columns], F.lit(True).alias("__novo"))
    joined = target.withColumn("__velho", F.lit(True)).join(s, keys, "full")
    out = [F.when(F.col("__novo"), F.col("__" + c)).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in target.columns]
    return joined.select(*out)


def get_or_create(dimension: DataFrame, names: DataFrame, key: str = "id", name: str = "nome") -> DataFrame:
    """dimension with the missing names added: ids follow the greatest one in the order of the names.

    The new names are range-partitioned and stored once, each with its partition. Row numbers within the partitions and
    offsets from their counts come from that one table, so that ids are distinct and consecutive, and no task sorts all
    new names. Null names are left out.
    """
    top = dimension.agg(F.coalesce(F.max(key), F.lit(0)).alias("t")).first()["t"]
    fresh = names.select(name).filter(F.col(name).isNotNull()).distinct().join(dimension.select(name), name, "left_anti")
    spread = stage(fresh.repartitionByRange(name).withColumn("__p", F.spark_partition_id()), "nomes-novos")
    counts = sorted((r["__p"], r["count"]) for r in spread.groupBy("__p").count().collect())  # one row per partition
    before, offsets = top, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    start = F.broadcast(spread.sparkSession.createDataFrame(offsets, "__p int, __antes bigint"))
    numbered = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(name))).join(start, "__p")
    ids = (F.col("__antes") + F.col("__n")).cast(dimension.schema[key].dataType)
    return dimension.select(key, name).unionByName(numbered.select(ids.alias(key), name))


def key_or_default(dimension: DataFrame, names: DataFrame, default: int = 1, key: str = "id", name: str = "nome") -> DataFrame:
    """(name, key) of each row of names: its id in dimension (the lowest of equal names), the default where it has none or is null."""
    known = dimension.groupBy(name).agg(F.min(key).alias(key))
    return names.select(name).join(known, name, "left").select(name, F.coalesce(key, F.lit(default)).alias(key))


def upsert_links(links: DataFrame, source: DataFrame) -> DataFrame:
    """links (id_norma, id_autor, cargo_autor, cargo_autor_normalizado, ativo) with those of source (id_norma, id_autor, cargo_autor).

    A known pair takes the new title and keeps its normalised title and flag; a new pair is active. Titles are stored
    in upper case with single blanks. Of several titles for a pair the greatest counts; null keys are left out.
    """
    keys = ["id_norma", "id_autor"]
    new = source.filter(F.col("id_norma").isNotNull() & F.col("id_autor").isNotNull()).groupBy(*keys).agg(F.max(normalize_name(F.col("cargo_autor"))).alias("cargo_autor"))
    merged = update_columns(links, new, keys, ["cargo_autor"])
    return merged.withColumn("ativo", F.coalesce("ativo", F.lit(1)).cast(links.schema["ativo"].dataType)) if "ativo" in links.columns else merged


def update_by_map(target: DataFrame, mapping: DataFrame, on: str, column: str) -> DataFrame:
    """column becomes the mapping's value (on, valor) where it has one; null keys and values change nothing."""
    m = mapping.filter(F.col(on).isNotNull() & F.col("valor").isNotNull()).groupBy(on).agg(F.max("valor").alias("valor"))
    return target.join(m, on, "left").withColumn(column, F.coalesce("valor", column)).select(*target.columns)


def set_where(target: DataFrame, column: str, keys: DataFrame, value, otherwise=None) -> DataFrame:
    """column becomes value in rows whose keys are listed (repeated and null keys in the list are harmless), else otherwise or itself."""
    k = keys.columns
    marked = target.join(keys.dropna().dropDuplicates().withColumn("__sim", F.lit(True)), k, "left")
    return marked.withColumn(column, F.when(F.col("__sim"), F.lit(value)).otherwise(F.col(column) if otherwise is None else F.lit(otherwise)).cast(target.schema[column].dataType)).select(*target.columns)


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the missing columns (name -> type) added as nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def overwrite(df: DataFrame, path: str) -> None:
    """Store df at path; df may read from path. An error leaves the old table in place.

    The new table is written beside it; then the old one is moved away, the new one moved in and the old one deleted.
    A crash between the two moves leaves both tables, as ``path.old`` and ``path.new``: ``recover`` puts one back.
    """
    spark = df.sparkSession
    new, at, old = _paths(spark, path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    recover(spark, path)
    df.write.mode("overwrite").parquet(path + ".new")
    moved = fs.exists(at)
    if moved and not fs.rename(at, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(new, at):
        if moved:
            fs.rename(old, at)
        raise OSError(f"can't move {path}.new to its place")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def _paths(spark: SparkSession, path: str) -> list:
    return [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + end) for end in (".new", "", ".old")]


def recover(spark: SparkSession, path: str) -> None:
    """Put the old table back if a crash left none at path."""
    _, at, old = _paths(spark, path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        elif not fs.rename(old, at):
            raise OSError(f"can't put {path} back")


def delete_all(spark: SparkSession, path: str) -> None:
    """Leave a stored table empty, with its columns."""
    overwrite(spark.read.parquet(path).limit(0), path)
