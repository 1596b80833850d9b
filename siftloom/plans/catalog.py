"""Queries over the shared tables by name, and the DuckDB SQL that each is held against.

image = documents.source, fragment = document, bytes = the text in UTF-8, block = 64 bytes, fragment type = doc_id % 10.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.functions import digests, disks
from siftloom.operators import blocks as B
from siftloom.operators import cluster as C
from siftloom.operators import dedup as D
from siftloom.operators import pairs as P
from siftloom.operators import sketches as S
from siftloom.session import materialize, new_path
from siftloom.sources import files, images
from siftloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SIZE = 64
EPS = 20
PERMS = 16


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def objects(spark: SparkSession, sf: str) -> DataFrame:
    """cluster (number of the source), fragment, type and bytes of every document."""
    d = table(spark, sf, "documents")
    return d.select(F.substring("source", 4, 9).cast("long").alias("cluster"), F.col("doc_id").alias("fragment"), (F.col("doc_id") % 10).cast("int").alias("type"), F.encode("text", "UTF-8").alias("bytes"))


def blocks(spark: SparkSession, sf: str, with_data: bool = False) -> DataFrame:
    return B.fixed_blocks(objects(spark, sf), SIZE, keep=("cluster", "fragment"), with_data=with_data)


def full(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).where("is_full")


OBJ = "obj as (select cast(substr(source, 4) as bigint) as cluster, doc_id as fragment, cast(doc_id % 10 as int) as type, encode(text) as b, octet_length(encode(text)) as n from documents)"
BLK = OBJ + f""", slot as (select cluster, fragment, b, n, unnest(range(0, (n + {SIZE - 1}) // {SIZE})) as pos from obj where n > 0),
blk as (select cluster, fragment, pos, pos * {SIZE} as byte_offset, cast(least({SIZE}, n - pos * {SIZE}) as int) as size, md5(b[(pos * {SIZE} + 1):(pos * {SIZE} + {SIZE})]) as md5, (pos + 1) * {SIZE} <= n as is_full, b[(pos * {SIZE} + 1):(pos * {SIZE} + {SIZE})] as data from slot)"""


def bits_sql(features: str, by: str) -> str:
    """CTEs that end in sim(by, simhash) from a table of (by, md5, weight)."""
    return f"""bit as (select {by}, i, sum(case when (cast(concat('0x', md5[(i // 4 + 1):(i // 4 + 1)]) as int) >> (3 - i % 4)) & 1 = 1 then weight else -weight end) as s from {features}, range(128) t(i) group by {by}, i),
nib as (select {by}, i // 4 as j, cast(sum(case when s > 0 then 1 << (3 - i % 4) else 0 end) as int) as v from bit group by {by}, i // 4),
sim as (select {by}, string_agg(substr('0123456789abcdef', v + 1, 1), '' order by j) as simhash from nib group by {by})"""


def dist_sql(a: str, b: str) -> str:
    half = lambda x, s: f"cast(concat('0x', substr({x}, {s}, 16)) as ubigint)"
    return "cast(" + " + ".join(f"bit_count(xor({half(a, s)}, {half(b, s)}))" for s in (1, 17)) + " as int)"


LOG = "feat as (select fragment, md5, 10 + length(bin(count(*))) as weight from blk where is_full group by 1, 2), " + bits_sql("feat", "fragment")


# --- blocks ----------------------------------------------------------------------------------------------------------


@query(f"with {BLK} select fragment, pos, byte_offset, size, md5, is_full from blk")
def chunk_md5(spark, sf):
    return blocks(spark, sf).drop("cluster")


@query(f"with {BLK} select fragment, pos, md5 from blk where is_full and md5 <> md5(unhex(repeat('00', {SIZE})))")
def blank_filter(spark, sf):
    return B.drop_blank(full(spark, sf), SIZE).select("fragment", "pos", "md5")


@query(f"with {BLK} select md5, count(*) as n from blk where is_full group by 1 order by n desc, md5 limit 20")
def block_top20(spark, sf):
    return B.top_blocks(full(spark, sf))


@query(f"with {BLK} select n, count(*) as digests from (select md5, count(*) as n from blk where is_full group by 1) group by 1")
def block_count_hist(spark, sf):
    return B.count_histogram(full(spark, sf))


@query(f"with {BLK} select md5 from blk where is_full group by 1 having count(*) = 1")
def unique_blocks(spark, sf):
    return B.unique_blocks(full(spark, sf))


_STATS = "cast(count(*) as bigint) as total_blocks, count(distinct md5) as unique_blocks, round((count(*) - count(distinct md5)) / count(*), 6) as dup_rate from blk where is_full"


@query(f"with {BLK} select {_STATS}")
def dup_stats(spark, sf):
    return B.dup_stats(full(spark, sf))


@query(f"with {BLK} select cluster, {_STATS} group by cluster")
def dup_stats_by_cluster(spark, sf):
    return B.dup_stats(full(spark, sf), ("cluster",))


_COMPOSITE = f"""comp as (select fragment, md5(string_agg(m, '' order by pos)) as digest from (select fragment, pos, md5(b[(pos * {SIZE} + 1):(pos * {SIZE} + {SIZE})]) as m from (select fragment, b, unnest(range(0, n // {SIZE} + 1)) as pos from obj)) group by 1)"""


@query(f"with {OBJ}, {_COMPOSITE} select fragment, digest from comp")
def composite_digest(spark, sf):
    return B.composite(objects(spark, sf), SIZE, keep=("fragment",))


@query(f"with {OBJ} select fragment, n // {SIZE} as block_num, cast(n % {SIZE} > 0 as int) as has_last_block, case when n % {SIZE} > 0 then n - n % {SIZE} else -1 end as last_block_offset, cast(n % {SIZE} as int) as last_block_size from obj")
def block_layout(spark, sf):
    return B.layout(objects(spark, sf), SIZE, keep=("fragment",))


@query(f"with {BLK}, f as (select fragment, row_number() over (partition by cluster order by fragment) as r, cluster from obj), a as (select blk.cluster, pos, md5 from blk join f using (fragment) where r = 1 and is_full), b as (select blk.cluster, pos, md5 from blk join f using (fragment) where r = 2 and is_full) select a.cluster, a.pos, a.md5 as md5_a, b.md5 as md5_b from a join b on a.cluster = b.cluster and a.pos = b.pos where a.md5 <> b.md5")
def block_diff(spark, sf):
    o = objects(spark, sf)
    first = o.select("cluster", "fragment").withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("fragment"))).where("r <= 2")
    b = B.fixed_blocks(o.join(first.select("fragment", "r"), "fragment"), SIZE, keep=("cluster", "r")).where("is_full")
    left, right = (b.where(F.col("r") == i).select("cluster", "pos", F.col("md5").alias(f"md5_{c}")) for i, c in ((1, "a"), (2, "b")))
    return left.join(right, ["cluster", "pos"]).where("md5_a <> md5_b")


@query(f"with {BLK} select md5 from (select md5, row_number() over (order by md5) as r from (select distinct md5 from blk where is_full)) where r % 10 = 1")
def every_tenth_block(spark, sf):
    return B.every_kth(full(spark, sf), 10)


@query(f"with {BLK} select fragment, pos, byte_offset, md5 from blk where pos > 0 and md5 in (select md5 from blk where pos = 0)")
def block_lookup(spark, sf):
    b = materialize(blocks(spark, sf), "blocks")
    return B.find_blocks(b.where("pos > 0"), b.where("pos = 0")).select("fragment", "pos", "byte_offset", "md5")


@query(f"with {BLK} select count(*) as total_blocks, count(distinct data) as unique_blocks, 128 as digits from blk where is_full")
def sha512_blocks(spark, sf):
    b = blocks(spark, sf, with_data=True).where("is_full").select(F.sha2("data", 512).alias("digest"))
    per = b.groupBy("digest").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_blocks"), F.count("*").alias("unique_blocks"), F.coalesce(F.max(F.length("digest")), F.lit(128)).alias("digits"))


@query(f"with {OBJ} select fragment, type from obj")
def shuffle_fragments(spark, sf):
    return B.shuffled(objects(spark, sf).select("fragment", "type"), "fragment", 7)


# --- sketches and pairs ----------------------------------------------------------------------------------------------


@query(f"with {BLK}, {LOG} select o.fragment, coalesce(simhash, repeat('0', 32)) as simhash from obj o left join sim using (fragment)")
def simhash_log(spark, sf):
    return S.block_simhash(B.drop_blank(full(spark, sf), SIZE), ("fragment",), "log", objects(spark, sf))


@query(f"with {BLK}, feat as (select fragment, md5, count(*) * 4096 as weight from blk where md5 <> md5(unhex(repeat('00', {SIZE}))) group by 1, 2), {bits_sql('feat', 'fragment')} select fragment, simhash from sim")
def simhash_count(spark, sf):
    return S.block_simhash(B.drop_blank(blocks(spark, sf), SIZE), ("fragment",), "count4096")


@query(f"with {OBJ}, {_COMPOSITE}, feat as (select cluster, digest as md5, sum(n) as weight from comp join obj using (fragment) group by 1, 2), {bits_sql('feat', 'cluster')} select cluster, simhash from sim")
def simhash_file(spark, sf):
    o = objects(spark, sf).withColumn("n", F.octet_length("bytes"))
    files_ = B.composite(o, SIZE, keep=("cluster", "n")).groupBy("cluster", F.col("digest").alias("md5")).agg(F.sum("n").alias("weight"))
    return S.simhash128(files_, ("cluster",))


def sims(spark, sf) -> DataFrame:
    return materialize(S.block_simhash(B.drop_blank(full(spark, sf), SIZE), ("fragment",), "log"), "sims")


PAIRS = f"with {BLK}, {LOG}, pair as (select a.fragment as a, b.fragment as b, {dist_sql('a.simhash', 'b.simhash')} as distance from sim a join sim b on a.fragment < b.fragment)"


@query(PAIRS + f" select a, b, distance from pair where distance <= {EPS}")
def hamming_pairs(spark, sf):
    return P.hamming_pairs(sims(spark, sf), EPS, "fragment")


@query(PAIRS + " select a, b, distance from pair where distance <= 7")
def hamming_pairs_banded(spark, sf):
    return P.hamming_pairs(sims(spark, sf), 7, "fragment")


def dbscan_sql(least: int) -> str:
    return PAIRS.replace("with ", "with recursive ", 1) + f""", near as materialized (select a, b from pair where distance <= {EPS} union all select b, a from pair where distance <= {EPS}),
core as (select fragment as id from sim left join (select a, count(*) as d from near group by 1) on a = fragment where coalesce(d, 0) + 1 >= {least}),
edge as materialized (select a, b from near where a in (select id from core) and b in (select id from core)),
reach(id, root) as (select id, id from core union select e.b, r.root from reach r join edge e on e.a = r.id),
rooted as (select id, min(root) as root from reach group by 1),
lab as (select root, cast(row_number() over (order by root) - 1 as int) as label from (select distinct root from rooted)),
own as (select id, label from rooted join lab using (root)),
border as (select n.a as id, min(label) as label from near n join own on own.id = n.b group by 1)
select s.fragment as id, coalesce(own.label, border.label, -1) as label from sim s left join own on own.id = s.fragment left join border on border.id = s.fragment"""


def _dbscan(spark, sf, least: int) -> DataFrame:
    """Each digest stands for its copies, which share its neighbours and so its label, under their smallest fragment."""
    s = sims(spark, sf)
    points = materialize(s.where("simhash is not null").groupBy("simhash").agg(F.min("fragment").alias("id"), F.count("*").alias("n")), "points")
    labels = C.dbscan(points, materialize(P.hamming_pairs(points, EPS), "pairs"), EPS, least, weight="n")
    return s.join(points, "simhash").join(labels, "id").select(F.col("fragment").alias("id"), "label")


@query(dbscan_sql(1))
def dbscan_ms1(spark, sf):
    return _dbscan(spark, sf, 1)


@query(dbscan_sql(2))
def dbscan_ms2(spark, sf):
    return _dbscan(spark, sf, 2)


@query(dbscan_sql(5))
def dbscan_ms5(spark, sf):
    return _dbscan(spark, sf, 5)


SETS = f"with {BLK}, s as (select distinct fragment, md5 from blk), c as (select fragment, count(*) as n from s group by 1), common as (select x.fragment as a, y.fragment as b, count(*) as k from s x join s y on x.md5 = y.md5 and x.fragment < y.fragment group by 1, 2)"


@query(SETS + " select a, b, round(2 * k / (x.n + y.n), 6) as dice from common join c x on x.fragment = a join c y on y.fragment = b")
def dice_pairs(spark, sf):
    return P.dice_pairs(blocks(spark, sf), "fragment")


@query(SETS + " select a, b, round(k / (x.n + y.n - k), 6) as jaccard from common join c x on x.fragment = a join c y on y.fragment = b")
def jaccard_pairs(spark, sf):
    return P.jaccard_pairs(blocks(spark, sf), "fragment")


@query(f"with {BLK}, a as (select distinct md5 from blk where cluster = 0), b as (select distinct md5 from blk where cluster = 1) select (select count(*) from (select * from a intersect select * from b)) as common, (select count(*) from (select * from a union select * from b)) as either")
def set_sizes(spark, sf):
    b = blocks(spark, sf)
    one, two = (b.where(F.col("cluster") == i).select("md5").distinct() for i in (0, 1))
    common, either = (x.agg(F.count("*").alias(n)) for x, n in ((one.intersect(two), "common"), (one.union(two).distinct(), "either")))
    return common.crossJoin(either)


_SIG = "least({m}, min((((a::hugeint * hv + b) % 18446744073709551616) % {p}) & {m}))".format(m=S.MAX, p=S.PRIME)
_HV = "hv as (select distinct fragment, cluster, cast(concat('0x', substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2)) as hugeint) as hv from (select fragment, cluster, sha1(md5) as h from blk))"
_PERM = "perm(i, a, b) as (values " + ", ".join(f"({i}, {a}::hugeint, {b}::hugeint)" for i, (a, b) in enumerate(S.permutations(PERMS))) + ")"
SIG = f"with {BLK}, {_HV}, {_PERM}, sig as (select fragment, i, cast({_SIG} as bigint) as v from hv, perm group by 1, 2)"


def signatures(spark, sf) -> DataFrame:
    """Signatures of the documents' block digests, computed where the text is: nothing is shuffled."""
    o = objects(spark, sf).where(F.octet_length("bytes") > 0)
    block = lambda i: F.md5(F.substring(F.col("bytes"), (i * SIZE + 1).cast("int"), F.lit(SIZE)))
    items = F.array_distinct(F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("bytes") - 1) / SIZE).cast("int")), block))
    return o.select("cluster", "fragment", S.minhash(PERMS)(items).alias("sig"))


@query(SIG + " select fragment, string_agg(v, ',' order by i) as signature from sig group by 1")
def minhash_sig(spark, sf):
    return signatures(spark, sf).select("fragment", F.array_join(F.col("sig").cast("array<string>"), ",").alias("signature"))


@query(SIG + f" select a.fragment as a, b.fragment as b, round(count(*) / {PERMS}, 6) as jaccard from sig a join sig b on a.i = b.i and a.v = b.v and a.fragment < b.fragment group by 1, 2")
def minhash_pairs(spark, sf):
    return P.signature_pairs(materialize(signatures(spark, sf), "sigs"), "fragment")


@query(SIG + f" select fragment, round({PERMS} / sum(v / {float(S.MAX)}) - 1, 6) as distinct_blocks from sig group by 1")
def minhash_count(spark, sf):
    return signatures(spark, sf).select("fragment", F.round(S.cardinality(F.col("sig")), 6).alias("distinct_blocks"))


@query(SIG + ", c as (select distinct cluster, fragment from blk), u as (select cluster, i, min(v) as v from sig join c using (fragment) group by 1, 2) select cluster, string_agg(v, ',' order by i) as signature from u group by 1")
def minhash_union(spark, sf):
    u = S.union(signatures(spark, sf), ("cluster",))
    return u.select("cluster", F.array_join(F.col("sig").cast("array<string>"), ",").alias("signature"))


# --- clusters --------------------------------------------------------------------------------------------------------


@query(f"with {OBJ} select fragment, type, type not in (0, 1, 6, 8) as is_fs from obj")
def fs_filter(spark, sf):
    return objects(spark, sf).select("fragment", "type", C.is_fs(F.col("type")).alias("is_fs"))


@query(f"with {OBJ} select type as label, count(*) as n, cast(sum((n + 511) // 512) as bigint) as sectors from obj where type in (0, 1, 6, 8) group by 1")
def nonfs_groups(spark, sf):
    o = objects(spark, sf).where(~C.is_fs(F.col("type")))
    return o.groupBy(C.non_fs_label(F.col("type"), None).alias("label")).agg(F.count("*").alias("n"), F.sum(B.sectors(F.octet_length("bytes"))).alias("sectors"))


SPLIT, MERGE = 100, 900
MEMBERS = f"{OBJ}, mem as (select cluster as label, fragment as item, (n + 511) // 512 as size, row_number() over (partition by cluster order by fragment) as r from obj)"


def members(spark, sf) -> DataFrame:
    return objects(spark, sf).select(F.col("cluster").alias("label"), F.col("fragment").alias("item"), F.col("fragment").alias("ord"), B.sectors(F.octet_length("bytes")).alias("size"))


@query(f"""with recursive {MEMBERS}, big as (select label from mem group by 1 having count(*) > 1 and sum(size) > {SPLIT}),
m as materialized (select mem.* from mem join big using (label)),
fold(label, item, r, bin, run) as (select label, item, r, 0, size from m where r = 1 union all select m.label, m.item, m.r, case when f.run + m.size > {SPLIT} then f.bin + 1 else f.bin end, case when f.run + m.size > {SPLIT} then m.size else f.run + m.size end from fold f join m on m.label = f.label and m.r = f.r + 1),
per as (select label, max(bin) + 1 as b from fold group by 1), off as (select label, sum(b) over (order by label) - b as o from per)
select cast((select max(label) from mem) + 1 + o + bin as bigint) as label, item from fold join off using (label) union all select label, item from mem where label not in (select label from big)""")
def cluster_split(spark, sf):
    return C.split_clusters(members(spark, sf), SPLIT)


@query(f"""with recursive {MEMBERS}, c as (select label, sum(size) as size from mem group by 1), small as materialized (select label, size, row_number() over (order by size, label) as r from c where size <= {MERGE / 2}),
fold(label, r, bin, run) as (select label, r, 0, size from small where r = 1 union all select s.label, s.r, case when f.run + s.size > {MERGE} then f.bin + 1 else f.bin end, case when f.run + s.size > {MERGE} then s.size else f.run + s.size end from fold f join small s on s.r = f.r + 1)
select cast(case when bin is null or (select count(*) from small) < 2 then mem.label else (select max(label) from mem) + 1 + bin end as bigint) as label, item from mem left join fold using (label)""")
def cluster_merge(spark, sf):
    return C.merge_clusters(members(spark, sf), MERGE)


@query(f"""with {BLK}, {LOG}, lab as (select cluster as label, simhash from sim join obj using (fragment)),
cbit as (select label, i, sum(case when (cast(concat('0x', simhash[(i // 4 + 1):(i // 4 + 1)]) as int) >> (3 - i % 4)) & 1 = 1 then 1 else -1 end) as s from lab, range(128) t(i) group by label, i),
cnib as (select label, i // 4 as j, cast(sum(case when s > 0 then 1 << (3 - i % 4) else 0 end) as int) as v from cbit group by 1, 2),
cent as (select label, string_agg(substr('0123456789abcdef', v + 1, 1), '' order by j) as centroid from cnib group by 1),
inn as (select avg(d) as inner_ from (select label, avg({dist_sql('simhash', 'centroid')}) as d from lab join cent using (label) group by 1)),
cross_ as (select a.label as x, b.label as y, avg({dist_sql('a.simhash', 'b.simhash')}) as d from lab a join lab b on a.label <> b.label group by 1, 2)
select (select count(*) from cent) as clusters, (select round(inner_, 6) from inn) as "inner", (select round(sum(d) / ((select count(*) from cent) * (select count(*) from cent)), 6) from cross_) as "outer" """)
def cluster_score(spark, sf):
    s = sims(spark, sf).join(objects(spark, sf).select("fragment", F.col("cluster").alias("label")), "fragment")
    return C.cluster_score(materialize(s.select("label", "simhash"), "members"))


@query(None)
def affinity(spark, sf):
    s = sims(spark, sf).join(objects(spark, sf).select("fragment", "cluster"), "fragment")
    return C.affinity(s, "cluster", "fragment")


@query(None)
def kmeans17(spark, sf):
    s = sims(spark, sf)
    return C.kmeans(s.withColumn("vector", C.bits_vector(F.col("simhash"))), 17, 9, "fragment")


@query(f"with {OBJ}, t as (select cluster, type, count(*)::double as n from obj group by 1, 2), s as (select (select sum(n * (n - 1) / 2) from t) as nij, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by cluster)) as ai, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by type)) as bj, (select sum(n) * (sum(n) - 1) / 2 from t) as every_) select round(case when (ai + bj) / 2 = ai * bj / every_ then 1.0 else (nij - ai * bj / every_) / ((ai + bj) / 2 - ai * bj / every_) end, 6) as ari from s")
def adjusted_rand(spark, sf):
    return C.adjusted_rand(objects(spark, sf).select("cluster", "type"), "cluster", "type")


@query(f"""with {BLK}, {LOG}, lab as (select cluster as label, simhash from sim join obj using (fragment)),
one as (select label, i, sum((cast(concat('0x', simhash[(i // 4 + 1):(i // 4 + 1)]) as int) >> (3 - i % 4)) & 1)::double as s, count(*)::double as n from lab, range(128) t(i) group by label, i),
per as (select i, sum(s * s / n) as sq, sum(s) as x, sum(s) * sum(s) as t, sum(n) as n, count(*) as k from one group by i),
total as (select sum(sq) as sq, sum(x) as x, sum(t) as t, max(n) as n, max(k) as k from per)
select round(case when k > 1 and x - sq > 0 then ((sq - t / n) / (k - 1)) / ((x - sq) / (n - k)) end, 6) as score from total""")
def calinski_harabasz(spark, sf):
    s = sims(spark, sf).join(objects(spark, sf).select("fragment", F.col("cluster").alias("label")), "fragment")
    return C.calinski_harabasz(s.select("label", "simhash"))


def image_rows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Images (clusters) as id with their similarity rows, and the Dice similarities behind these."""
    sets = materialize(blocks(spark, sf).select(F.col("cluster").alias("id"), "md5").distinct(), "sets")
    pairs = materialize(P.dice_pairs(sets), "dice")
    return C.similarity_rows(sets.select("id").distinct(), pairs, "dice"), pairs


@query(f"with {BLK}, s as (select distinct cluster, md5 from blk), c as (select cluster, count(*) as n from s group by 1), common as (select x.cluster as a, y.cluster as b, count(*) as k from s x join s y using (md5) group by 1, 2) select a.cluster as id, string_agg(cast(case when a.cluster = b.cluster then 1000000 else coalesce(round(round(2 * k / (a.n + b.n), 6) * 1000000), 0) end as bigint), ',' order by b.cluster) as millionths from c a cross join c b left join common on common.a = a.cluster and common.b = b.cluster group by 1")
def similarity_rows(spark, sf):
    rows, _ = image_rows(spark, sf)
    return rows.select("id", F.array_join(F.transform("vector", lambda v: F.round(v * 1_000_000).cast("long").cast("string")), ",").alias("millionths"))


def _image_labels(spark, sf, k: int, seed: int = 9) -> DataFrame:
    rows, _ = image_rows(spark, sf)
    return C.kmeans(rows, k, seed)


@query(None)
def kmeans12(spark, sf):
    return _image_labels(spark, sf, 12)


@query(None)
def spectral12(spark, sf):
    rows, pairs = image_rows(spark, sf)
    return C.spectral(rows, pairs, "dice", 12)


# --- dedup and rebuild -----------------------------------------------------------------------------------------------

FIRST = """, f as (select {p}, md5, fragment, pos, row_number() over (partition by {p}, md5 order by fragment, pos) as r from blk where is_full), ids as (select {p}, md5, fragment, pos, row_number() over (partition by {p} order by fragment, pos) - 1 as block_id from f where r = 1)"""


@query(f"with {BLK}" + FIRST.format(p="cluster") + " select cluster, md5, block_id from ids")
def local_dedup(spark, sf):
    return D.first_ids(full(spark, sf)).select("cluster", "md5", "block_id")


@query(f"with {BLK}" + FIRST.format(p="cluster") + " select blk.cluster, blk.fragment, blk.pos, block_id from blk join ids on ids.cluster = blk.cluster and ids.md5 = blk.md5 where is_full")
def recipe(spark, sf):
    return D.local_dedup(full(spark, sf))


@query("with " + BLK.replace("select cluster, fragment, pos", "select 0 as cluster, fragment, pos") + FIRST.format(p="cluster") + " select md5, block_id from ids")
def global_dedup(spark, sf):
    return D.first_ids(full(spark, sf).withColumn("cluster", F.lit(0))).select("md5", "block_id")


@query(f"with {BLK.replace('select cluster, fragment, pos', 'select fragment as cluster, fragment, pos')}" + FIRST.format(p="cluster") + " select cluster as fragment, md5, block_id from ids")
def single_file_dedup(spark, sf):
    own = full(spark, sf).withColumn("cluster", F.col("fragment"))
    return D.first_ids(own).select(F.col("cluster").alias("fragment"), "md5", "block_id")


@query(f"with {BLK.replace('select cluster, fragment, pos', 'select cast(fragment % 10 as bigint) as cluster, fragment, pos')}" + FIRST.format(p="cluster") + " select cluster as label, md5, block_id from ids where cluster in (0, 1, 6, 8)")
def nonfs_dedup(spark, sf):
    o = objects(spark, sf).where(~C.is_fs(F.col("type"))).withColumn("cluster", C.non_fs_label(F.col("type"), None).cast("long"))
    b = B.fixed_blocks(o, SIZE, keep=("cluster", "fragment")).where("is_full")
    return D.first_ids(b).select(F.col("cluster").alias("label"), "md5", "block_id")


@query(f"""with {BLK}, {_COMPOSITE}, k as (select cluster, fragment, n, min(fragment) over (partition by cluster, digest) as keeper from comp join obj using (fragment)),
f as (select blk.cluster, md5, fragment, row_number() over (partition by blk.cluster, md5 order by fragment, pos) as r from blk join k using (fragment) where is_full and fragment = keeper and k.n >= {SIZE}),
c as (select fragment, count(*) as new_blocks from f where r = 1 group by 1),
h as (select *, case when fragment <> keeper then 'copy' when n < {SIZE} then 'file' else 'blocks' end as stored_as from k left join c using (fragment))
select cluster, fragment, keeper, stored_as, cast(case when stored_as = 'blocks' then n // {SIZE} else 0 end as bigint) as block_num, cast(case when stored_as = 'blocks' then coalesce(new_blocks, 0) else 0 end as bigint) as new_blocks, cast(case stored_as when 'copy' then 0 when 'file' then n else n % {SIZE} end as bigint) as last_size from h""")
def file_block_dedup(spark, sf):
    o = objects(spark, sf).withColumn("size", F.octet_length("bytes").cast("long"))
    whole = materialize(B.composite(o, SIZE, keep=("cluster", "fragment", "size")), "digests")
    return D.file_block_dedup(whole, blocks(spark, sf), SIZE)


@query(None)
def kmeans_dedup(spark, sf):
    labels = _image_labels(spark, sf, 17).select(F.col("id").alias("cluster"), "label")
    b = full(spark, sf).join(F.broadcast(labels), "cluster")  # one label an image; images are few (similarity_rows)
    return D.first_ids(b, "label").select("label", "md5", "block_id")


PART = 1 << 16


@query(f"with {OBJ}, place as (select cluster, b, n, coalesce(sum(n) over (partition by cluster order by fragment rows between unbounded preceding and 1 preceding), 0)::bigint as o from obj where n > 0), cut as (select cluster, part, o, b[(greatest(part * {PART} - o, 0) + 1)::bigint:least(part * {PART} + {PART} - o, n)::bigint] as piece from (select *, unnest(range(o // {PART}, (o + n - 1) // {PART} + 1)) as part from place)) select cluster as image, part, cast(sum(octet_length(piece)) as bigint) as size, md5(string_agg(hex(piece), '' order by o)) as md5 from cut group by 1, 2")
def merge_parts(spark, sf):
    o = objects(spark, sf).select("cluster", "fragment", "bytes", F.octet_length("bytes").cast("long").alias("n")).where("n > 0")
    # offsets in two levels: inside buckets of fragments, and over the buckets of an image
    o = o.withColumn("bucket", F.floor(F.col("fragment") / D.BUCKET))
    sizes = materialize(o.select("cluster", "fragment", "bucket", "n"), "sizes")
    inside = sizes.withColumn("i", F.sum("n").over(Window.partitionBy("cluster", "bucket").orderBy("fragment")) - F.col("n"))
    sums = sizes.groupBy("cluster", "bucket").agg(F.sum("n").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("cluster").orderBy("bucket")) - F.col("s")).drop("s")
    offsets = inside.join(before, ["cluster", "bucket"]).select("fragment", (F.col("before") + F.col("i")).alias("byte_offset"))
    placed = o.join(offsets, "fragment").select(F.col("cluster").alias("image"), "byte_offset", F.col("bytes").alias("data"))
    got = D.merge_parts(placed, PART)
    return got.select("image", "part", F.octet_length("data").cast("long").alias("size"), F.md5(F.hex("data")).alias("md5"))


@query(f"with {OBJ} select concat('f', fragment) as name, concat('cluster-', cluster, '.json') as dedup_map_json, cast(n as bigint) as size, case type when 8 then -1 else type end as type from obj")
def json_sidecars(spark, sf):
    """Fragments and their cluster map written as JSON, read back by their schemas and joined by name."""
    o = objects(spark, sf).select(F.concat(F.lit("f"), "fragment").alias("name"), "cluster", F.octet_length("bytes").cast("long").alias("size"), F.when(F.col("type") != 8, F.col("type")).alias("type"))
    frags, maps = new_path(spark, "fragments"), new_path(spark, "map")
    files.write_json(o, frags)
    files.write_json(files.cluster_map(o), maps)
    one = files.read_json(spark, frags, "name string, cluster long, size long, type int")
    return one.join(files.read_json(spark, maps, "name string, dedup_map_json string"), "name").select("name", "dedup_map_json", "size", F.coalesce("type", F.lit(-1)).alias("type"))


@query("select concat('/', lang, '/', doc_id, '.txt') as path, cast(case when doc_id % 2 = 0 then 420 else 493 end as int) as mode, octet_length(encode(text)) as size, md5(text) as md5 from documents")
def package_roundtrip(spark, sf):
    """Packages of a hundred documents, deduplicated inside, and unpacked again with paths and modes."""
    d = table(spark, sf, "documents")
    mode = F.when(F.col("doc_id") % 2 == 0, 0o644).otherwise(0o755)
    rows = d.select(F.floor(F.col("doc_id") / 100).alias("package"), F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), mode.alias("mode"), F.encode("text", "UTF-8").alias("data"))
    got = files.unpacked(files.packages(rows, block=SIZE))
    return got.select("path", "mode", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("md5"))


@query("select doc_id as fragment, md5(text) as md5, octet_length(encode(text)) as size from documents where octet_length(encode(text)) > 0")
def rebuild_check(spark, sf):
    base, recipes, tails = D.store(blocks(spark, sf, with_data=True))
    got = D.rebuild(base, recipes, tails)
    return got.select("fragment", F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("size"))


_FILES = f"""{OBJ}, {_COMPOSITE}, files as (select digest, fragment % 50 as inode, concat('/d/', fragment) as path, case when fragment % 7 = 3 then 's' end as link, n as size from comp join obj using (fragment)),
rk as (select *, row_number() over (partition by digest, inode order by path) as r from files)"""


@query(f"""with {_FILES} select digest, greatest(count(distinct case when link is null then inode end), 1) as num,
coalesce(string_agg(case when link is null and r = 1 then path end, ',' order by path), '') as real_dir, coalesce(string_agg(case when link is null and r > 1 then path end, ',' order by path), '') as h_link,
coalesce(string_agg(case when link = 's' then path end, ',' order by path), '') as s_link, max(size) as size from rk group by 1""")
def file_groups(spark, sf):
    o = objects(spark, sf).withColumn("size", F.octet_length("bytes").cast("long"))
    listed = B.composite(o, SIZE, keep=("fragment", "size")).select("digest", (F.col("fragment") % 50).alias("inode"), F.concat(F.lit("/d/"), "fragment").alias("path"), F.when(F.col("fragment") % 7 == 3, "s").alias("link"), "size")
    g = D.file_groups(listed)
    return g.select("digest", "num", *[F.array_join(c, ",").alias(c) for c in ("real_dir", "h_link", "s_link")], "size")


@query(f"with {OBJ}, {_COMPOSITE}, x as (select cluster, fragment, digest, n, row_number() over (partition by cluster, digest order by fragment) as r from comp join obj using (fragment)) select cluster, fragment, digest, cast(n as bigint) as size, case when n < 4096 then 'file' else 'blocks' end as stored_as from x where r = 1")
def small_file_split(spark, sf):
    o = objects(spark, sf).withColumn("size", F.octet_length("bytes").cast("long"))
    return D.file_dedup(B.composite(o, SIZE, keep=("cluster", "fragment", "size")), ("cluster",)).select("cluster", "fragment", "digest", "size", "stored_as")


@query(f"with {OBJ} select cluster, fragment, row_number() over (partition by cluster order by fragment) as nb, cast(coalesce(sum((n + 511) // 512) over (partition by cluster order by fragment rows between unbounded preceding and 1 preceding), 0) as bigint) as sector_offset, case type when 0 then 8 when 7 then 2 when 6 then 4 else 8 end as ftype from obj")
def fragment_layout(spark, sf):
    w = Window.partitionBy("cluster").orderBy("fragment")
    o = objects(spark, sf).select("cluster", "fragment", "type", B.sectors(F.octet_length("bytes")).alias("s"))
    return o.select("cluster", "fragment", F.row_number().over(w).alias("nb"), F.coalesce(F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sector_offset"), disks.fragment_type_col(F.col("type")).alias("ftype"))


# --- functions -------------------------------------------------------------------------------------------------------


def _hash_sql(name: str, start: int, step: str) -> str:
    codes = "list_transform(range(1, length(url) + 1), lambda i: ord(substr(url, i, 1))::bigint)"
    return f"cast(list_reduce(list_prepend({start}::bigint, {codes}), lambda h, c: ({step}) & 4294967295) & 2147483647 as bigint) as {name}"


def _wide_sql(name: str, start: int, step: str) -> str:
    """A fold whose state h has 64 bits: the hash below, something else above bit 32. i counts from 0 in ``step``."""
    codes = "list_transform(range(1, length(url) + 1), lambda j: ord(substr(url, j, 1))::hugeint + ((j - 1)::hugeint << 32))"
    body = step.replace("{c}", "(x & 4294967295)").replace("{i}", "(x >> 32)").replace("{h}", "(h & 4294967295)").replace("{a}", "(h >> 32)")
    return f"cast(list_reduce(list_prepend({start}::hugeint, {codes}), lambda h, x: {body}) & 2147483647 as bigint) as {name}"


_CODES = [
    _hash_sql("simple", 0, "h * 31 + c"),
    _hash_sql("js", 1315423911, "xor(h, (((h << 5) & 4294967295) + c + (h >> 2)) & 4294967295)"),
    _hash_sql("bkdr", 0, "h * 131 + c"),
    _hash_sql("djb", 5381, "h * 33 + c"),
    _hash_sql("sdbm", 0, "h * 65599 + c"),
    _wide_sql("rs", 63689 << 32, "(({h} * {a} + {c}) & 4294967295) + ((({a} * 378551) & 4294967295) << 32)"),
    *[_hash_sql(n, 0, "xor((h << 4) + c, (((h << 4) + c) & 4026531840) >> 24) & 268435455") for n in ("pjw", "elf")],
    _wide_sql("ap", 0, "case when {i} % 2 = 0 then xor({h}, xor(xor({h} << 7, {c}), {h} >> 3)) & 4294967295 else xor(xor({h}, xor(xor({h} << 11, {c}), {h} >> 5)), 4294967295::hugeint) & 4294967295 end"),
    "cast(65535 - coalesce(list_sum(list_transform(range(1, length(url) + 1), lambda j: ord(substr(url, j, 1)) * case when j % 2 = 1 then 1 else 256 end)) - 1, -1) % 65535 - 1 as bigint) as crc",
    "cast(list_reduce(list_prepend(0::hugeint, list_transform(range(0, (length(url) + 1) // 2), lambda w: (ord(substr(url, 2 * w + 1, 1)) + 256 * case when 2 * w + 2 <= length(url) then ord(substr(url, 2 * w + 2, 1)) else 0 end)::hugeint << (w % 16)::int)), lambda h, x: xor(h, x)) & 4294967295 as bigint) as \"table\"",
]


@query("select page_id, " + ", ".join(_CODES) + " from pages")
def string_hashes(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", *[digests.string_hash(n)(F.col("url")).alias(n) for n in digests.STRING_HASHES])


@query("select page_id, regexp_extract(url, '([^/]*)$', 1) as file_name, cast(contains(html, 'usr') as boolean) as has_usr, 4::int as kind from pages")
def path_parts(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", digests.file_name(F.col("url")).alias("file_name"), F.contains("html", F.lit("usr")).alias("has_usr"), disks.mounted_type(F.col("html"), F.lit(9)).alias("kind"))


_NTFS = " + ".join(f"cast(contains(html, '{n}') as int)" for n in disks.NTFS_NAMES)
_LINUX = " + ".join(f"cast(contains(html, '{n}') as int)" for n in disks.LINUX_NAMES)


@query(f"select page_id, case page_id % 3 when 0 then case when {_NTFS} > 4 then 2 else 3 end when 1 then case when {_LINUX} > 5 then 0 else 1 end else 4 end as mounted from pages")
def mounted_type(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, 2).when(F.col("page_id") % 3 == 1, 5).otherwise(8)
    return table(spark, sf, "pages").select("page_id", disks.mounted_type(F.col("html"), kind).alias("mounted"))


@query("select event_type, count(*) as n, round(max(value) / 1024, 9) as max_mb, round(avg(value) / 1024, 6) as avg_mb from events group by 1")
def rss_stats(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value") / 1024, 9).alias("max_mb"), F.round(F.avg("value") / 1024, 6).alias("avg_mb"))


@query("select cast(y as bigint) as year, round(pow(1.3, y - 2010) * 175 / pow(1.3, 15), 6) as size from range(2010, 2026) t(y)")
def growth_series(spark, sf):
    return spark.range(2010, 2026).select(F.col("id").alias("year"), F.round(F.pow(F.lit(1.3), F.col("id") - 2010) * 175 / F.pow(F.lit(1.3), F.lit(15)), 6).alias("size"))


def _matrix() -> F.Column:
    e = F.col("embedding").cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(e, r * 8 + 1, 8))


_ROW = "list_aggregate(embedding[(r * 8 + 1):(r * 8 + 8)]::double[], 'avg')"


@query(f"select vec_id, array_to_string(list_transform(range(0, 64), lambda i: case when embedding[i + 1]::double >= list_aggregate(embedding[(i // 8 * 8 + 1):(i // 8 * 8 + 8)]::double[], 'sum') / 8 then '1' else '0' end), '') as bits from embeddings")
def phash(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", digests.perceptual_bits(_matrix()).alias("bits"))


@query(None)
def change_points(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("screen"), F.col("vec_id").alias("frame"), digests.perceptual_bits(_matrix()).alias("bits"))
    return streams.change_points(e)


@query("select doc_id, octet_length(encode(text)) as size, md5(text) as md5 from documents")
def zlib_roundtrip(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", digests.inflate(digests.deflate(F.encode("text", "UTF-8"))).alias("b"))
    return d.select("doc_id", F.octet_length("b").cast("long").alias("size"), F.md5("b").alias("md5"))


def sample_disk(kind: str) -> bytes:
    """Small generated disk images."""
    import struct

    def sector(entries, mark=b"\x55\xaa"):
        body = b"".join(struct.pack("<4sB3xII", b"", t, s, n) for t, s, n in entries).ljust(64, b"\0")
        return bytes(446) + body + mark

    if kind == "mbr":
        return sector([(0x83, 64, 448), (0x07, 512, 1536)]) + bytes(2047 * 512)
    if kind == "gap":
        return sector([(0x83, 64, 448), (0x07, 512, 1536)]) + bytes(2147 * 512)
    if kind == "gpt":
        return sector([]) + b"EFI PART".ljust(512, b"\0") + bytes(100 * 512)
    if kind == "ext":
        data = bytearray(sector([(0x83, 64, 100), (0x0B, 164, 100), (0x07, 264, 100), (0x05, 364, 1000)]) + bytes(1363 * 512))
        data[364 * 512 : 365 * 512] = sector([(0x83, 10, 300), (0x05, 400, 500)])
        data[764 * 512 : 765 * 512] = sector([(0x82, 20, 480)])
        return bytes(data)
    return bytes(1000)


_SPLIT = """select * from (values ('ext.raw', 0, 0::bigint, 64::bigint, 0, 1), ('ext.raw', 1, 64, 100, 131, 5), ('ext.raw', 2, 164, 100, 11, 4), ('ext.raw', 3, 264, 100, 7, 2), ('ext.raw', 4, 364, 10, 0, 1), ('ext.raw', 5, 374, 300, 131, 5), ('ext.raw', 6, 764, 20, 0, 1), ('ext.raw', 7, 784, 480, 130, 6),
('gap.raw', 0, 0, 64, 0, 1), ('gap.raw', 1, 64, 448, 131, 5), ('gap.raw', 2, 512, 1536, 7, 2), ('gap.raw', 3, 2048, 100, 0, 8), ('mbr.raw', 0, 0, 64, 0, 1), ('mbr.raw', 1, 64, 448, 131, 5), ('mbr.raw', 2, 512, 1536, 7, 2), ('unknown.raw', 0, 0, 2, 0, 7)) t(name, infile_nb, "offset", sectors, signature, type)"""


@query(_SPLIT)
def image_split(spark, sf):
    rows = [(f"{k}.raw", bytearray(sample_disk(k))) for k in ("mbr", "gap", "gpt", "ext", "unknown")]
    held = spark.createDataFrame(rows, T.StructType([T.StructField("name", T.StringType()), T.StructField("data", T.BinaryType())]))
    return disks.split_images(held)


@query(_SPLIT.replace(") t(name", ", ('disk.vdi', 0, 0, 4096, 0, 0), ('disk.vdi', 1, 4096, 64, 0, 1), ('disk.vdi', 2, 4160, 448, 131, 5), ('disk.vdi', 3, 4608, 1536, 7, 2)) t(name"))
def image_fragments(spark, sf):
    """The generated images and a VDI file, written to the shared folder and split by reading their boot records only."""
    folder = new_path(spark, "images")
    data = {f"{k}.raw": sample_disk(k) for k in ("mbr", "gap", "gpt", "ext", "unknown")} | {"disk.vdi": bytes(disks.VDI_HEADER) + sample_disk("mbr")}
    store, at = images.open_file(folder)
    store.create_dir(at, recursive=True)
    for name, content in data.items():
        with store.open_output_stream(f"{at}/{name}") as f:
            f.write(content)
    spark.dataSource.register(images.ImageFragments)
    got = spark.read.format("image_fragments").option("path", folder).load()
    return got.select(F.substring_index("path", "/", -1).alias("name"), "infile_nb", "offset", "sectors", "signature", "type")


@query("select page_id, cast(case when page_id % 5 = 4 then 5 when page_id % 5 = 0 then 2 else case page_id % 7 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 when 4 then 4 when 5 then 0 else 5 end end as int) as img_type, cast(case page_id % 5 when 1 then 0 when 2 then 1 when 3 then 2 else 3 end as int) as disk_type from pages")
def image_types(spark, sf):
    """Images named after the pages: a qcow2 head, an MBR, a GPT, an LVM label, or too short, by page_id."""
    zeros = lambda n: F.lit(bytes(n))
    heads = {0: F.concat(F.lit(b"QFI\xfb"), zeros(1020)), 1: F.concat(zeros(510), F.lit(b"\x55\xaa"), zeros(512)), 2: F.concat(zeros(510), F.lit(b"\x55\xaaEFI PART"), zeros(504)), 3: F.concat(zeros(512), F.lit(b"LABELONE"), zeros(504)), 4: zeros(100)}
    name = lambda suffix: F.concat("url", F.lit(suffix))
    head, path = heads[4], name(".html")
    for k in range(4):
        head = F.when(F.col("page_id") % 5 == k, heads[k]).otherwise(head)
    for k, suffix in enumerate((".raw", ".vmdk", ".qcow2", ".vhd", ".vdi", ".RAW")):
        path = F.when(F.col("page_id") % 7 == k, name(suffix)).otherwise(path)
    p = table(spark, sf, "pages").select("page_id", path.alias("name"), head.alias("b"))
    return p.select("page_id", disks.image_type(F.col("name"), F.col("b"), F.octet_length("b")).alias("img_type"), disks.disk_type(F.col("b")).alias("disk_type"))


@query(f"with {BLK}, t as (select md5, min(fragment) as v from blk where cluster = 0 group by 1), u as (select md5, max(fragment) as v from blk where cluster = 1 group by 1), r as (select distinct md5 from blk where cluster = 2) select md5, v from (select * from u union all select * from t where md5 not in (select md5 from u)) where md5 not in (select md5 from r)")
def index_upsert(spark, sf):
    b = blocks(spark, sf)
    old = b.where("cluster = 0").groupBy("md5").agg(F.min("fragment").alias("v"))
    new = b.where("cluster = 1").select("md5", F.col("fragment").alias("v"))
    return D.remove(D.upsert(old, new, "md5", "v"), b.where("cluster = 2").select("md5").distinct(), "md5")


# --- streams ---------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf}/{name}.parquet*")


@query("select time_bucket(interval '1 hour', ts) as start, count(*) as n, round(avg(value), 6) as avg_value, max(value) as max_value from events group by 1")
def stream_rss(spark, sf):
    s = streams.windowed_usage(_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    out = streams.drain(s, f"rss_{uuid.uuid4().hex}", "complete", new_path(spark, "stream"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "avg_value", "max_value")


@query(f"with {BLK} select distinct md5 from blk where is_full")
def stream_dedup(spark, sf):
    d = _stream(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("bytes"))
    b = B.fixed_blocks(d, SIZE).where("is_full").select("md5")
    return streams.drain(streams.new_blocks(b), f"dedup_{uuid.uuid4().hex}", "append", new_path(spark, "stream")).select("md5")
