"""Disk images: kinds, partition tables, and their fragments."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTOR = 512
#: Fixed enumerations.
IMG_TYPES = {"raw": 0, "vmdk": 1, "qcow2": 2, "vhd": 3, "vdi": 4, "other": 5}
DISK_TYPES = {"mbr": 0, "gpt": 1, "pv": 2, "unknown": 3}
FRAGMENT_TYPES = {"img_header": 0, "boot_interval": 1, "ntfs": 2, "fat32": 3, "fat16": 4, "linux_normal": 5, "linux_swap": 6, "lvm": 7, "empty": 8, "other": 9}
#: Partition type byte -> fragment type.
SIGNATURES = {0x00: 8, 0x07: 2, 0x0B: 3, 0x0C: 3, 0x06: 4, 0x83: 5, 0x82: 6, 0x8E: 7}
EXTENDED = (0x05, 0x0F)
VDI_HEADER = 0x200000
VDI_SECTORS = 0x1000
#: Names at the root of installed systems.
NTFS_NAMES = ("Program Files", "ProgramData", "Windows", "Users", "pagefile.sys", "System Volume Information", "Recovery", "bootmgr")
LINUX_NAMES = ("bin", "boot", "dev", "etc", "home", "lib", "media", "mnt", "opt", "root", "sbin", "usr", "var")


def fragment_type(signature: int, compat: bool = True) -> int:
    """Type of a partition's signature; ``compat`` counts FAT32 as FAT16."""
    t = SIGNATURES.get(signature, FRAGMENT_TYPES["empty"])
    return FRAGMENT_TYPES["fat16"] if compat and t == FRAGMENT_TYPES["fat32"] else t


def fragment_type_col(signature: Column, compat: bool = True) -> Column:
    out = F.lit(FRAGMENT_TYPES["empty"])
    for s in SIGNATURES:
        out = F.when(signature == s, fragment_type(s, compat)).otherwise(out)
    return out


def image_type(name: Column, head: Column, size: Column) -> Column:
    """Kind by suffix; below a sector it is other; the qcow2 magic overrides the suffix."""
    by_suffix = F.lit(IMG_TYPES["other"])
    for suffix in ("raw", "vmdk", "qcow2", "vhd", "vdi"):
        by_suffix = F.when(F.lower(F.substring_index(name, ".", -1)) == suffix, IMG_TYPES[suffix]).otherwise(by_suffix)
    return F.when(size < SECTOR, IMG_TYPES["other"]).when(F.hex(F.substring(head, 1, 4)) == "514649FB", IMG_TYPES["qcow2"]).otherwise(by_suffix)


def is_image(kind: Column) -> Column:
    return kind != IMG_TYPES["other"]


def disk_type(head: Column) -> Column:
    """mbr or gpt where the first sector ends in 55AA (gpt: ``EFI PART`` follows), pv for ``LABELONE``, else unknown."""
    marked = F.hex(F.substring(head, SECTOR - 1, 2)) == "55AA"
    second = F.substring(head, SECTOR + 1, 8)
    return F.when(marked & (second == F.lit(b"EFI PART")), 1).when(marked, 0).when(second == F.lit(b"LABELONE"), 2).otherwise(3)


def mounted_type(listing: Column, kind: Column) -> Column:
    """windows_os (2) for ntfs with over 4 of 8 names, linux_os (0) for linux with over 5 of 13, else 3, 1 or unknown 4."""
    hits = lambda names: sum((F.when(F.instr(listing, n) > 0, 1).otherwise(0) for n in names), F.lit(0))
    return F.when(kind == 2, F.when(hits(NTFS_NAMES) > 4, 2).otherwise(3)).when(kind == 5, F.when(hits(LINUX_NAMES) > 5, 0).otherwise(1)).otherwise(4)


def is_os_path(path: Column) -> Column:
    return F.regexp_like(path, F.lit(r"(^|/)(bin|lib|lib64|sbin|usr|Windows)(/|$)"))


def _entries(sector: bytes) -> list[tuple[int, int, int]]:
    """(type, start, sectors) of the four entries of an MBR or EBR sector."""
    return [(sector[446 + 16 * i + 4], *struct.unpack_from("<II", sector, 446 + 16 * i + 8)) for i in range(4)]


def fragments(size: int, read: Callable[[int, int], bytes], vdi: bool = False, compat: bool = True, whole_gpt: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(offset, sectors, signature, type) of an image's fragments, in sectors; ``read(offset, n)`` reads bytes.

    Extended partitions are followed wherever they stand, boot records relative to the first; unused space at the end,
    and between fragments, is told from the greatest end. GPT disks give no fragment unless ``whole_gpt``.
    """
    base = VDI_SECTORS if vdi else 0
    if vdi:
        yield 0, VDI_SECTORS, 0, FRAGMENT_TYPES["img_header"]
    total = -(-size // SECTOR)
    head = read(base * SECTOR, 2 * SECTOR)
    marked = head[SECTOR - 2 : SECTOR] == b"\x55\xaa"
    if not marked:
        yield base, total - base, 0, FRAGMENT_TYPES["lvm"]
        return
    if head[SECTOR : SECTOR + 8] == b"EFI PART":
        if whole_gpt:
            yield base, total - base, 0, FRAGMENT_TYPES["other"]
        return
    table = _entries(head)
    first_zero = next((i for i, e in enumerate(table) if not e[1]), 4)
    used = table[:first_zero]
    if used:
        yield base, min(e[1] for e in used), 0, FRAGMENT_TYPES["boot_interval"]
    end = min((e[1] for e in used), default=0)
    for kind, start, count in used:
        if kind not in EXTENDED:
            yield base + start, count, kind, fragment_type(kind, compat)
            end = max(end, start + count)
            continue
        at, seen = start, set()
        while at not in seen and (base + at) * SECTOR + SECTOR <= size:
            seen.add(at)
            logical, following, *_ = _entries(read((base + at) * SECTOR, SECTOR))
            if not logical[2]:
                break
            yield base + at, logical[1], 0, FRAGMENT_TYPES["boot_interval"]
            yield base + at + logical[1], logical[2], logical[0], fragment_type(logical[0], compat)
            end = max(end, at + logical[1] + logical[2])
            if not following[1]:
                break
            at = start + following[1]
        end = max(end, start + count)
    if end < total - base:
        yield base + end, total - base - end, 0, FRAGMENT_TYPES["empty"]


def split_images(images: DataFrame, name: str = "name", data: str = "data", **options) -> DataFrame:
    """name, infile_nb, offset, sectors, signature, type of images that are held as binary cells (small images, tests).

    Large images are read by byte range: see ``ImageFragments`` in ``siftloom.sources.images``.
    """
    schema = "name string, infile_nb int, offset long, sectors long, signature int, type int"

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for n, d in zip(f["name"], f["data"], strict=True):
                b = bytes(d)
                got = fragments(len(b), lambda o, k, b=b: b[o : o + k], vdi=str(n).lower().endswith(".vdi"), **options)
                rows += [(n, i, *x) for i, x in enumerate(got)]
            yield pd.DataFrame(rows, columns=["name", "infile_nb", "offset", "sectors", "signature", "type"])

    return images.select(F.col(name).alias("name"), F.col(data).alias("data")).mapInPandas(run, schema)
