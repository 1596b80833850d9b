"""Exact dedup inside clusters: dense block ids, recipes, stores, and rebuilding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fragments per bucket of the two-level numbering.
BUCKET = 256


def first_ids(blocks: DataFrame, cluster: str = "cluster", ord_: str = "fragment") -> DataFrame:
    """cluster, md5, first (fragment, pos) and block_id: the rank from 0 of a digest's first occurrence in its cluster.

    Ranks come from two levels: a row number inside buckets of fragments and the running sum of the buckets' sizes, so
    that a cluster with most of the blocks does not fall to one task.
    """
    first = blocks.groupBy(cluster, "md5").agg(F.min(F.struct(F.col(ord_).alias("fragment"), "pos")).alias("first")).withColumn("bucket", F.floor(F.col("first.fragment") / BUCKET))
    inside = Window.partitionBy(cluster, "bucket").orderBy("first")
    sizes = first.groupBy(cluster, "bucket").agg(F.count("*").alias("c"))
    before = sizes.withColumn("before", F.sum("c").over(Window.partitionBy(cluster).orderBy("bucket")) - F.col("c")).drop("c")
    return first.withColumn("r", F.row_number().over(inside)).join(before, [cluster, "bucket"]).select(cluster, "md5", "first", (F.col("before") + F.col("r") - 1).alias("block_id"))


def local_dedup(blocks: DataFrame, cluster: str = "cluster", ord_: str = "fragment") -> DataFrame:
    """The recipe: cluster, fragment, pos, block_id of every full block. Blank blocks are blocks like any other."""
    full = blocks.where("is_full")
    return full.join(first_ids(full, cluster, ord_).drop("first"), [cluster, "md5"]).select(cluster, ord_, "pos", "block_id")


def store(blocks: DataFrame, cluster: str = "cluster", ord_: str = "fragment") -> tuple[DataFrame, DataFrame, DataFrame]:
    """store_blocks (cluster, block_id, md5, data), recipes and tails of blocks that carry their data.

    Data is fetched only for first occurrences, by a join on their places.
    """
    full = blocks.where("is_full")
    ids = first_ids(full, cluster, ord_)
    places = ids.select(cluster, F.col("first.fragment").alias(ord_), F.col("first.pos").alias("pos"), "block_id")
    base = full.join(places, [cluster, ord_, "pos"]).select(cluster, "block_id", "md5", "data")
    recipes = full.select(cluster, ord_, "pos", "md5").join(ids.drop("first"), [cluster, "md5"]).select(cluster, ord_, "pos", "block_id")
    tails = blocks.where("not is_full").select(cluster, ord_, "data")
    return base, recipes, tails


def rebuild(base: DataFrame, recipes: DataFrame, tails: DataFrame, cluster: str = "cluster", ord_: str = "fragment") -> DataFrame:
    """fragment and data: the blocks of each recipe in order, then the tail."""
    parts = recipes.join(base.select(cluster, "block_id", "data"), [cluster, "block_id"]).select(ord_, "pos", "data")
    parts = parts.unionByName(tails.select(ord_, F.lit((1 << 62)).alias("pos"), "data"))
    return parts.groupBy(ord_).agg(F.expr("listagg(data, x'') within group (order by pos)").alias("data"))


def recipe_slice(recipes: DataFrame, fragment: int, offset: int, count: int, ord_: str = "fragment") -> DataFrame:
    return recipes.where((F.col(ord_) == fragment) & (F.col("pos") >= offset) & (F.col("pos") < offset + count))


def file_groups(files: DataFrame, digest: str = "digest") -> DataFrame:
    """Files by composite digest: num distinct inodes (a digest seen only through links counts 1), sorted path lists.

    ``files``: digest, inode, path, link (null, or the kind ``s`` of a symbolic link), size.
    """
    f = files.where(F.col(digest).isNotNull())
    first = Window.partitionBy(digest, "inode").orderBy("path")
    real = f.withColumn("r", F.row_number().over(first))
    hard = (F.col("link").isNull()) & (F.col("r") > 1)
    return real.groupBy(digest).agg(
        F.greatest(F.count_distinct(F.when(F.col("link").isNull(), F.col("inode"))), F.lit(1)).alias("num"),
        F.array_sort(F.collect_list(F.when(F.col("link").isNull() & (F.col("r") == 1), F.col("path")))).alias("real_dir"),
        F.array_sort(F.collect_list(F.when(hard, F.col("path")))).alias("h_link"),
        F.array_sort(F.collect_list(F.when(F.col("link") == "s", F.col("path")))).alias("s_link"),
        F.max("size").alias("size"),
    )


def file_dedup(files: DataFrame, by: tuple[str, ...] = (), block_size: int = 4096) -> DataFrame:
    """First file of each digest (in each cluster), with the way it is stored: whole below ``block_size``, else as blocks."""
    w = Window.partitionBy(*by, "digest").orderBy("fragment")
    return files.where("digest is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").withColumn("stored_as", F.when(F.col("size") < block_size, "file").otherwise("blocks"))


def file_block_dedup(files: DataFrame, blocks: DataFrame, size: int, cluster: str = "cluster", ord_: str = "fragment") -> DataFrame:
    """How each file is stored when whole files are compared before blocks, cluster by cluster.

    ``files``: cluster, fragment, digest, size (stored, since it is read twice); ``blocks``: their full blocks. keeper is the
    first file of the digest in the cluster. stored_as: copy (a repeat of the keeper), file (below ``size``) or blocks; a keeper
    stored as blocks has block_num full blocks, of which new_blocks occur in no file kept before, and a tail of last_size bytes.
    Digests and ids are shuffled, no data.
    """
    first = files.where("digest is not null").groupBy(cluster, "digest").agg(F.min(ord_).alias("keeper"))
    kept = files.join(first, [cluster, "digest"])
    large = kept.where((F.col(ord_) == F.col("keeper")) & (F.col("size") >= size)).select(cluster, ord_)
    new = first_ids(blocks.where("is_full").join(large, [cluster, ord_], "left_semi"), cluster, ord_)
    counts = new.groupBy(cluster, F.col("first.fragment").alias(ord_)).agg(F.count("*").alias("new_blocks"))
    how = F.when(F.col(ord_) != F.col("keeper"), "copy").when(F.col("size") < size, "file").otherwise("blocks")
    in_blocks = how == "blocks"
    out = kept.join(counts, [cluster, ord_], "left")
    return out.select(
        cluster,
        ord_,
        "keeper",
        how.alias("stored_as"),
        F.when(in_blocks, F.floor(F.col("size") / size)).otherwise(0).cast("long").alias("block_num"),
        F.when(in_blocks, F.coalesce("new_blocks", F.lit(0))).otherwise(0).cast("long").alias("new_blocks"),
        F.when(how == "copy", 0).when(how == "file", F.col("size")).otherwise(F.col("size") % size).cast("long").alias("last_size"),
    )


def merge_parts(fragments: DataFrame, part_bytes: int, image: str = "image") -> DataFrame:
    """image, part, data: fragments (image, byte_offset, data) merged back into parts of ``part_bytes`` bytes of their image.

    A fragment that crosses parts is cut first, so that an image of any size is merged by as many tasks as it has parts.
    Fragments cover their image without gaps; null and empty ones have no bytes.
    """
    n = F.octet_length("data")
    first = F.floor(F.col("byte_offset") / part_bytes)
    last = F.floor((F.col("byte_offset") + n - 1) / part_bytes)
    each = fragments.where(n > 0).select(image, "byte_offset", "data", F.explode(F.sequence(first, last)).alias("part"))
    start = F.greatest(F.col("part") * part_bytes - F.col("byte_offset"), F.lit(0).cast("long"))
    stop = F.least(F.col("part") * part_bytes + part_bytes - F.col("byte_offset"), n.cast("long"))
    cut = each.select(image, "part", (F.col("byte_offset") + start).alias("at"), F.substring(F.col("data"), (start + 1).cast("int"), (stop - start).cast("int")).alias("data"))
    return cut.groupBy(image, "part").agg(F.expr("listagg(data, x'') within group (order by at)").alias("data"))


# --- hash-table operations -------------------------------------------------------------------------------------------


def upsert(table: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Rows by key, those of ``updates`` in place of those of ``table``; of several updates the one with the last version."""
    new = updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), version).alias("s")).select("s.*")
    return table.join(new, key, "left_anti").unionByName(new)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys, key, "left_anti")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return keys.join(table, key)
