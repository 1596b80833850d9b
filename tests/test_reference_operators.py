"""Golden vectors, brute force and round trips for the similarity-dedup operators."""

import os
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.functions import digests, disks
from siftloom.operators import blocks as B
from siftloom.operators import cluster as C
from siftloom.operators import dedup as D
from siftloom.operators import pairs as P
from siftloom.operators import sketches as S
from siftloom.operators.components import components
from siftloom.plans import catalog
from siftloom.sources import descr, files
from siftloom.sources.images import ImageBlocks, ImageFragments
from siftloom.streaming import streams

A, BB, CC, Z = (bytes([c]) * 4096 for c in (65, 66, 67, 0))
MD5 = {"A": "82a7348c2e03731109d0cf45a7325b88", "B": "c14ca970915e6422b94faaf895fab3aa", "C": "1bfe8f3ef8ccab741404f07f238c88dc"}


def frame(spark, rows):
    return spark.createDataFrame([(0, i, bytearray(b)) for i, b in enumerate(rows)], "cluster long, fragment long, bytes binary")


def sim(spark, data):
    f = frame(spark, [data])
    b = B.drop_blank(B.fixed_blocks(f, 4096, keep=("fragment",)).where("is_full"), 4096)
    return S.block_simhash(b, ("fragment",), everyone=f).first()["simhash"]


def test_simhash_golden(spark):
    assert sim(spark, A) == MD5["A"]
    assert sim(spark, A + BB) == "800420000002600009408a4085321388"
    assert sim(spark, A + BB + BB) == MD5["B"]
    assert sim(spark, A + BB + CC + Z + Z) == "83eead3cb84e63301944ea7da7ba9b88"
    assert sim(spark, Z + Z) == "0" * 32


def test_simhash_sums_against_brute_force(spark):
    rng = np.random.RandomState(3)
    rows = [(int(k) if k else None, rng.bytes(16).hex() if rng.rand() < 0.95 else None, int(rng.randint(0, 9))) for k in rng.randint(0, 12, 6000)]
    sums: dict = {}
    for k, d, w in rows:
        if d:
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(d), np.uint8)).astype(int)
            sums[k] = sums.get(k, 0) + (2 * bits - 1) * w
    want = {k: np.packbits(v > 0).tobytes().hex() for k, v in sums.items()}
    df = spark.createDataFrame(rows, "k long, md5 string, weight long").repartition(3)
    out = S.simhash128(df, ("k",))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # 64 rows a digest
    assert {r.k: r.simhash for r in out.collect()} == want
    assert {r.k: r.simhash for r in S.simhash128(df.coalesce(1), ("k",), whole=True).collect()} == want


def test_blank_digests_and_tail(spark):
    assert spark.range(1).select(digests.blank_digest(4096).alias("d")).first()["d"] == "620f0b67a91f7f74151bc5be745b7110"
    r = B.layout(frame(spark, [A * 3 + b"x" * 17]), 4096).first()
    assert (r.block_num, r.has_last_block, r.last_block_offset, r.last_block_size) == (3, 1, 12288, 17)


def test_dup_chain_and_rebuild(spark):
    f = frame(spark, [A + BB, A + BB + CC + b"tail", b"", b"short"])
    b = B.fixed_blocks(f, 4096, keep=("cluster", "fragment"), with_data=True)
    base, recipes, tails = D.store(b)
    assert [r.block_id for r in recipes.orderBy("fragment", "pos").collect()] == [0, 1, 0, 1, 2]
    assert B.dup_stats(b.where("is_full")).first()["dup_rate"] == 0.4
    got = {r.fragment: bytes(r.data) for r in D.rebuild(base, recipes, tails).collect()}
    assert got == {0: A + BB, 1: A + BB + CC + b"tail", 3: b"short"}


def test_string_hashes():
    want = {"simple": 352721933, "rs": 1894361383, "js": 375521732, "pjw": 86206750, "elf": 86206750, "bkdr": 1338371925, "sdbm": 1219289037, "djb": 1376753482, "ap": 1804095569, "crc": 28964, "table": 562580}
    assert {k: f(b"deduplication") for k, f in digests.STRING_HASHES.items()} == want


def test_minhash_golden(spark):
    assert S.signature({"a", "b"}, S.permutations(4)).tolist() == [297616339, 142712514, 1081647660, 1135903111]
    p = S.permutations(255)
    a, b = (S.signature(set(x), p) for x in ("abc", "bcd"))
    assert abs((a == b).mean() - 0.46666) < 1e-4
    df = spark.createDataFrame([(a.astype(int).tolist(),)], "sig array<long>")
    assert df.select(S.cardinality(F.col("sig")).alias("n")).first()["n"] == pytest.approx(2.854883219746452)


def test_next_fit_and_merge(spark):
    assert C.next_fit([60, 50, 40, 120, 10], 100) == [0, 1, 1, 2, 3]
    m = spark.createDataFrame([(i, i, i, s) for i, s in enumerate([10, 20, 30, 45])], "label long, item long, ord long, size long")
    got = {r.item: r.label for r in C.merge_clusters(m, 100).collect()}
    assert got[0] == got[1] == got[2] != got[3]


def test_components_matches_union_find(spark):
    rng = np.random.RandomState(3)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)]
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dbscan_border(spark):
    pts = spark.createDataFrame([(i,) for i in range(7)], "id long")
    pairs = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 4, 1), (4, 5, 1)], "a long, b long, distance int")
    got = {r.id: r.label for r in C.dbscan(pts, pairs, 1, 5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: -1, 6: -1}


def test_affinity_groups():
    x = np.array([0, 1, 2, 50, 51, 52])
    labels = C.affinity_labels(-np.abs(x[:, None] - x[None]), -20)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1]
    assert C.agglomerative_labels(np.abs(x[:, None] - x[None]), 2).tolist() == [0, 0, 0, 1, 1, 1]
    assert C.mean_shift_labels(x[:, None].astype(float), 10).tolist() == [0, 0, 0, 1, 1, 1]


def test_affinity_of_large_groups_is_shared(spark):
    rng = np.random.RandomState(4)
    base = rng.randint(0, 2, (6, 128))
    rows = []
    for i in range(90):
        b = base[i % 6].copy()
        b[rng.randint(0, 128, rng.randint(1, 12))] ^= 1
        rows.append((i % 2 if i < 80 else 2, i, np.packbits(b).tobytes().hex()))
    df = spark.createDataFrame(rows, "cluster int, id long, simhash string")
    one = {(r.cluster, r.id): r.label for r in C.affinity(df, preference=-60.0).collect()}
    assert len(one) == 90 and len({v for (c, _), v in one.items() if c == 0}) > 1
    assert {(r.cluster, r.id): r.label for r in C.affinity(df, preference=-60.0, max_points=20).collect()} == one  # refused before


def test_banded_pairs_equal_theta(spark):
    rng = np.random.RandomState(0)
    base = rng.randint(0, 2, 128)
    rows = []
    for i in range(40):
        b = base.copy()
        b[rng.randint(0, 128, rng.randint(0, 9))] ^= 1
        rows.append((i, np.packbits(b).tobytes().hex()))
    df = spark.createDataFrame(rows, "id long, simhash string")
    band = {(r.a, r.b): r.distance for r in P.hamming_pairs(df, 7).collect()}
    every = {(r.a, r.b): r.distance for r in P.hamming_pairs(df, None).where("distance <= 7").collect()}
    assert band == every and band


def test_wide_pairs_chunk_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST", 64)  # several chunks
    rng = np.random.RandomState(1)
    base = rng.randint(0, 2, (30, 128))
    rows = []
    for i in range(500):
        b = base[i % 30].copy()
        b[rng.randint(0, 128, rng.randint(0, 25))] ^= 1
        rows.append((i * 7 % 500, np.packbits(b).tobytes().hex()))
    df = spark.createDataFrame([*rows, (900, rows[0][1]), (901, rows[0][1]), (902, None)], "id long, simhash string")
    out = P.hamming_pairs(df, 20)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # rows of all pairs
    got = [(r.a, r.b, r.distance) for r in out.collect()]
    every = [(r.a, r.b, r.distance) for r in P.hamming_pairs(df, None).where("distance <= 20").collect()]
    assert sorted(got) == sorted(every) and (900, 901, 0) in got and len(got) > 500
    names = P.hamming_pairs(df.selectExpr("cast(id as string) as id", "simhash"), 20)
    assert sorted((r.a, r.b, r.distance) for r in names.collect()) == sorted((*sorted((str(a), str(b))), d) for a, b, d in every)
    assert P.hamming_pairs(df.limit(0), 20).count() == 0


def test_dbscan_weights_stand_for_copies(spark):
    rng = np.random.RandomState(2)
    place = [int(x) for x in rng.randint(0, 60, 80)]
    every = spark.createDataFrame([(i,) for i in range(80)], "id long")
    pairs = spark.createDataFrame([(i, j, abs(place[i] - place[j])) for i in range(80) for j in range(i + 1, 80)], "a long, b long, distance int")
    first = {p: place.index(p) for p in place}
    few = spark.createDataFrame([(i, place.count(p)) for p, i in first.items()], "id long, n long")
    less = pairs.where(F.col("a").isin(list(first.values())) & F.col("b").isin(list(first.values())))
    for least in (1, 2, 5):
        want = {r.id: r.label for r in C.dbscan(every, pairs, 1, least).collect()}
        got = {r.id: r.label for r in C.dbscan(few, less, 1, least, weight="n").collect()}
        assert want == {i: got[first[p]] for i, p in enumerate(place)}


def test_file_groups(spark):
    rows = [("d", 1, "/a", None, 5), ("d", 1, "/b", None, 5), ("d", 2, "/c", None, 5), ("d", 1, "/l", "s", 5)]
    r = D.file_groups(spark.createDataFrame(rows, "digest string, inode long, path string, link string, size long")).first()
    assert (r["num"], r.real_dir, r.h_link, r.s_link) == (2, ["/a", "/c"], ["/b"], ["/l"])


def test_change_points(spark):
    a = "0" * 1000
    f = [(0, 0, a), (0, 1, a), (0, 2, "1" * 5 + a[5:]), (0, 3, "1" * 20 + a[20:])]
    df = spark.createDataFrame(f, "screen int, frame long, bits string")
    assert [r.frame for r in streams.change_points(df).collect()] == [3]


def test_drained_stream_is_not_in_the_driver(spark, tmp_path):
    spark.range(3000).selectExpr("cast(id % 700 as string) as md5").repartition(3).write.parquet(str(tmp_path / "in"))
    got = streams.drain(streams.new_blocks(spark.readStream.schema("md5 string").parquet(str(tmp_path / "in"))), "drained_test")
    assert not spark.catalog.tableExists("drained_test")  # a memory table: rows in the driver
    assert sorted(r.md5 for r in got.collect()) == sorted(str(i) for i in range(700))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_disks():
    def kinds(k):
        d = catalog.sample_disk(k)
        return [x[3] for x in disks.fragments(len(d), lambda o, n: d[o : o + n])]

    assert kinds("mbr") == [1, 5, 2] and kinds("gap") == [1, 5, 2, 8] and kinds("gpt") == [] and kinds("unknown") == [7]
    assert disks.fragment_type(0x0B) == 4 and disks.fragment_type(0x0B, compat=False) == 3


def test_image_type(spark):
    df = spark.createDataFrame([("a.raw", bytearray(b"QFI\xfb" + bytes(600))), ("tiny.vmdk", bytearray(10)), ("x.vdi", bytearray(600))], "n string, b binary")
    assert [r.t for r in df.select(disks.image_type(F.col("n"), F.col("b"), F.octet_length("b")).alias("t")).collect()] == [2, 5, 4]


def test_descriptor_and_package(spark, tmp_path):
    head = dict(zip(descr.IMAGE_FIELDS, (1, 0, 2048, "i.raw", "/p", 0, 0, 0), strict=True))
    frag = dict(zip(descr.FRAGMENT_FIELDS, (7, 1, 64, 100, 0x83, 5, b"\1" * 16, "f", "/p", "s", "NULL"), strict=True))
    data = descr.with_simhash(descr.encode(head, [frag]), 0, b"\2" * 16)
    assert len(data) == 540 + 1072
    (tmp_path / "i.descr").write_bytes(data)
    r = descr.read_fragments(spark, str(tmp_path)).first()
    assert (r.img_name, r.fragment_size, bytes(r.simhash)) == ("i.raw", 100, b"\2" * 16)
    descr.write(descr.read_images(spark, str(tmp_path)).drop("path"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "i.raw.descr").read_bytes() == data
    content = [("a", A + BB + b"t"), ("b", BB + A), ("c", b"")]
    assert files.unpack(files.pack(content)) == content
    assert struct.unpack_from("<I", files.pack(content))[0] == files.PACKAGE_MAGIC


def test_image_blocks_source(spark, tmp_path):
    (tmp_path / "x.img").write_bytes(A + BB + Z + b"end")
    spark.dataSource.register(ImageBlocks)
    got = spark.read.format("image_blocks").options(path=str(tmp_path), split_bytes=4096, with_data="true").load().orderBy("pos").collect()
    assert [r.md5 for r in got][:2] == [MD5["A"], MD5["B"]] and not got[3].is_full and bytes(got[3].data) == b"end"


def test_image_fragments_source(spark, tmp_path):
    for k in ("mbr", "gap", "gpt", "ext", "unknown"):
        (tmp_path / f"{k}.raw").write_bytes(catalog.sample_disk(k))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.vdi").write_bytes(bytes(disks.VDI_HEADER) + catalog.sample_disk("mbr"))
    spark.dataSource.register(ImageFragments)
    got = {}
    for r in spark.read.format("image_fragments").option("path", str(tmp_path)).load().orderBy("path", "infile_nb").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.offset, r.sectors, r.type))
    assert got.pop("x.vdi") == [(0, 4096, 0), (4096, 64, 1), (4160, 448, 5), (4608, 1536, 2)]
    for name, rows in got.items():
        d = catalog.sample_disk(name[:-4])
        assert rows == [(o, n, t) for o, n, _, t in disks.fragments(len(d), lambda o, n: d[o : o + n])]
    assert set(got) == {"mbr.raw", "gap.raw", "ext.raw", "unknown.raw"}


def test_packages_keep_modes_and_directories(spark, tmp_path):
    rows = [(1, "/a/b.bin", 0o755, bytearray(A + BB + b"t")), (1, "/a/c/d", 0o600, bytearray(BB + A)), (2, "e", None, None)]
    df = spark.createDataFrame(rows, "package long, path string, mode int, data binary")
    got = files.unpacked(files.packages(df), keep=("package",))
    assert sorted((r.package, r.path, r.mode, bytes(r.data)) for r in got.collect()) == [(1, "/a/b.bin", 0o755, A + BB + b"t"), (1, "/a/c/d", 0o600, BB + A), (2, "e", 0o644, b"")]
    files.extract(got, str(tmp_path))
    assert (tmp_path / "a" / "c" / "d").read_bytes() == BB + A and (tmp_path / "a" / "b.bin").stat().st_mode & 0o777 == 0o755
    assert (tmp_path / "e").read_bytes() == b""
    with pytest.raises(Exception, match="outside"):
        files.extract(spark.createDataFrame([("../x", 0o644, bytearray(b""))], "path string, mode int, data binary"), str(tmp_path))
    assert files.packages(df.where("false")).count() == 0


def test_images_are_written_at_their_offsets(spark, tmp_path):
    rows = [("d/i.raw", 0, bytearray(A)), ("d/i.raw", 6000, bytearray(BB)), ("j.raw", 3, bytearray(b"x"))]
    files.write_images(spark.createDataFrame(rows, "image string, byte_offset long, data binary"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "d" / "i.raw").read_bytes() == A + bytes(6000 - 4096) + BB
    assert (tmp_path / "out" / "j.raw").read_bytes() == b"\0\0\0x"


def test_merge_parts_cuts_fragments(spark):
    data = bytes(range(256)) * 4
    cuts = [0, 3, 100, 100, 700, 1024]
    rows = [("i", a, bytearray(data[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [("n", 0, None)]
    got = D.merge_parts(spark.createDataFrame(rows, "image string, byte_offset long, data binary"), 256)
    assert {(r.image, r.part): bytes(r.data) for r in got.collect()} == {("i", k): data[256 * k : 256 * k + 256] for k in range(4)}


def test_file_block_dedup(spark):
    f = frame(spark, [A + BB, A + BB, BB + CC + b"x", b"tiny", b"tiny", b""]).withColumn("size", F.octet_length("bytes").cast("long"))
    whole = B.composite(f, 4096, keep=("cluster", "fragment", "size"))
    got = D.file_block_dedup(whole, B.fixed_blocks(f, 4096, keep=("cluster", "fragment")), 4096).orderBy("fragment").collect()
    assert [(r.keeper, r.stored_as, r.block_num, r.new_blocks, r.last_size) for r in got] == [(0, "blocks", 2, 2, 0), (0, "copy", 0, 0, 0), (2, "blocks", 2, 1, 1), (3, "file", 0, 0, 4), (3, "copy", 0, 0, 0), (5, "file", 0, 0, 0)]


def test_labels_from_similarities(spark):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9, 20)], "id long")
    near = [(1, 2), (1, 3), (2, 3), (7, 8), (7, 9), (8, 9)]
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in near], "a long, b long, dice double")
    rows = {r.id: r.vector for r in C.similarity_rows(ids, pairs, "dice").collect()}
    assert rows[2] == [0.9, 1.0, 0.9, 0, 0, 0, 0] and rows[20] == [0] * 6 + [1.0]
    of = {r.id: r.label for r in C.kmeans(C.similarity_rows(ids, pairs, "dice"), 3).collect()}
    assert of[1] == of[2] == of[3] and of[7] == of[8] == of[9] and len(set(of.values())) == 3
    of = {r.id: r.label for r in C.spectral(ids, pairs, "dice", 2).collect()}
    assert of[1] == of[2] == of[3] and of[7] == of[8] == of[9] and of[20] == -1
    none = C.similarity_rows(ids.where("false"), pairs, "dice")
    assert none.count() == 0 and C.kmeans(none, 3).count() == 0


def test_kmeans_dedup_covers_every_block(spark):
    """Labels come from K-means; inside each label ids are dense and every digest of its images occurs once."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = catalog.kmeans_dedup(spark, sf).collect()
    labels = {r.id: r.label for r in catalog._image_labels(spark, sf, 17).collect()}
    want = {(labels[r.cluster], r.md5) for r in catalog.full(spark, sf).collect()}
    assert {(r.label, r.md5) for r in got} == want and len(got) == len(want)
    for label in set(labels.values()):
        own = sorted(r.block_id for r in got if r.label == label)
        assert own == list(range(len(own)))


def test_block_samples(spark):
    md5s = [f"{i:032x}" for i in range(25)]
    df = spark.createDataFrame([(m,) for m in md5s * 2], "md5 string")
    assert sorted(r.md5 for r in B.every_kth(df, 10).collect()) == [md5s[0], md5s[10], md5s[20]]
    order = [r.md5 for r in B.shuffled(df.distinct(), "md5", 3).collect()]
    assert sorted(order) == md5s and order != md5s and order == [r.md5 for r in B.shuffled(df.distinct().repartition(3), "md5", 3).collect()]
    assert spark.createDataFrame([("NULL",), ("/mnt",)], "p string").select(C.has_path(F.col("p")).alias("x")).collect() == [(False,), (True,)]


def test_rss_log(spark):
    lines = spark.createDataFrame([("03:34:04 AM 0 1 2 3 4 2048 0.1 x",), ("date",)], "value string")
    assert [r.rss_mb for r in files.rss_log(lines).collect()] == [2.0]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in ("documents", "embeddings", "pages", "events"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), c.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    norm = lambda d: sorted(repr(tuple(round(float(v), 5) if isinstance(v, float) else str(v) for v in r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert norm(got) == norm(want)
