"""PLINK 1, BGEN and GCTA binary files through ``binaryFile`` and numpy, in blocks of variants."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def plink(spark: SparkSession, prefix: str, block_bytes: int = 32 << 20) -> DataFrame:
    """(variant_id, chromosome, position, ref, alt, sample_id, dosage) from prefix.bed, .bim and .fam; dosage counts allele 1 (``alt``).

    The genotype file is read once a block of variants, each task slicing its own bytes.
    """
    bim = spark.read.csv(f"{prefix}.bim", sep="\t", schema="chromosome string, variant_id string, cm double, position long, a1 string, a2 string")
    fam = [r[0].split()[1] for r in spark.read.text(f"{prefix}.fam").collect()]
    width = (len(fam) + 3) // 4
    ids = bim.select("variant_id", "chromosome", "position", "a1", "a2").collect()
    rows = max(1, block_bytes // max(1, width))
    blocks = spark.createDataFrame([(a, min(len(ids), a + rows)) for a in range(0, len(ids), rows)], "a long, b long")
    data = spark.read.format("binaryFile").load(f"{prefix}.bed").select("content")

    def decode(batches):
        code = np.array([2.0, np.nan, 1.0, 0.0])
        for pdf in batches:
            for a, b, content in zip(pdf["a"], pdf["b"], pdf["content"]):
                if bytes(content[:3]) != b"\x6c\x1b\x01":
                    raise ValueError("not a variant-major genotype file")
                raw = np.frombuffer(content, np.uint8, count=(b - a) * width, offset=3 + a * width).reshape(b - a, width)
                two = np.stack([(raw >> s) & 3 for s in (0, 2, 4, 6)], 2).reshape(b - a, -1)[:, : len(fam)]
                for k in range(b - a):
                    v = ids[a + k]
                    d = code[two[k]]
                    yield pd.DataFrame({"variant_id": v["variant_id"], "chromosome": v["chromosome"], "position": v["position"], "ref": v["a2"], "alt": v["a1"], "sample_id": fam, "dosage": d})

    out = blocks.crossJoin(F.broadcast(data)).repartition(max(1, len(ids) // rows)).mapInPandas(decode, "variant_id string, chromosome string, position long, ref string, alt string, sample_id string, dosage double")
    return out.withColumn("dosage", F.nanvl("dosage", F.lit(None).cast("double")))


def gcta_grm(spark: SparkSession, prefix: str) -> DataFrame:
    """(row, col, value) of prefix.grm.bin and prefix.grm.id: the lower triangle in single precision."""
    ids = [r[0].split()[1] for r in spark.read.text(f"{prefix}.grm.id").collect()]

    def decode(batches):
        for pdf in batches:
            for content in pdf["content"]:
                v = np.frombuffer(content, "<f4").astype(float)
                i, j = np.tril_indices(len(ids))
                if len(v) != len(i):
                    raise ValueError("the triangle and the ids do not match")
                yield pd.DataFrame({"row": np.array(ids)[i], "col": np.array(ids)[j], "value": v})

    return spark.read.format("binaryFile").load(f"{prefix}.grm.bin").select("content").mapInPandas(decode, "row string, col string, value double")


_BGEN = "variant_id string, chromosome string, position long, ref string, alt string, sample_id string, dosage double"


def _packed(data: bytes, bits: int, count: int) -> np.ndarray:
    """``count`` little-endian numbers of ``bits`` bits each."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count=count).astype(float)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: bits * count].reshape(count, bits)
    return flat.astype(float) @ (2.0 ** np.arange(bits))


def _bgen_dosages(block: bytes) -> np.ndarray:
    """Expected count of the second allele for each sample of a layout-2 genotype block; missing as NaN."""
    n, alleles = struct.unpack_from("<IH", block, 0)
    if alleles != 2:
        raise ValueError("only biallelic variants are read")
    ploidy = np.frombuffer(block, np.uint8, count=n, offset=8)
    if ((ploidy & 63) != 2).any():
        raise ValueError("only diploid samples are read")
    phased, bits = block[8 + n], block[9 + n]
    p = _packed(block[10 + n :], bits, 2 * n).reshape(n, 2) / (2.0**bits - 1)
    dose = (2 - p.sum(1)) if phased else p[:, 1] + 2 * (1 - p[:, 0] - p[:, 1])
    return np.where(ploidy & 128, np.nan, dose)


def _bgen_variants(data: bytes):
    """(id, chromosome, position, first allele, second allele, dosages) of every variant, and the sample ids."""
    offset, header, variants, n = struct.unpack_from("<IIII", data, 0)
    flags = struct.unpack_from("<I", data, header)[0]
    compression, layout = flags & 3, (flags >> 2) & 15
    if data[16:20] not in (b"bgen", b"\0\0\0\0") or layout != 2:
        raise ValueError("not a BGEN file of layout 2")
    ids = [f"sample_{i}" for i in range(n)]
    if flags >> 31:
        at, ids = 4 + header + 8, []
        for _ in range(n):
            size = struct.unpack_from("<H", data, at)[0]
            ids.append(data[at + 2 : at + 2 + size].decode())
            at += 2 + size
    at = offset + 4

    def text(width):
        nonlocal at
        size = struct.unpack_from("<H" if width == 2 else "<I", data, at)[0]
        at += width + size
        return data[at - size : at].decode()

    for _ in range(variants):
        own, rsid, chromosome = text(2), text(2), text(2)
        position, alleles = struct.unpack_from("<IH", data, at)
        at += 6
        names = [text(4) for _ in range(alleles)]
        size = struct.unpack_from("<I", data, at)[0]
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if compression == 1:
            block = zlib.decompress(block[4:])
        elif compression == 2:
            import zstandard

            block = zstandard.ZstdDecompressor().decompress(block[4:], max_output_size=struct.unpack_from("<I", block, 0)[0])
        yield rsid or own, chromosome, position, names, block, ids


def bgen(spark: SparkSession, path: str) -> DataFrame:
    """(variant_id, chromosome, position, ref, alt, sample_id, dosage) of layout-2 files; dosage counts the second allele.

    ``path`` may be a folder or a pattern: each file is one task, so cohorts are best kept in a file for each stretch of the genome.
    """

    def decode(batches):
        for pdf in batches:
            for content in pdf["content"]:
                for name, chromosome, position, alleles, block, ids in _bgen_variants(bytes(content)):
                    yield pd.DataFrame({"variant_id": name, "chromosome": chromosome, "position": position, "ref": alleles[0], "alt": alleles[1], "sample_id": ids, "dosage": _bgen_dosages(block)})

    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, _BGEN)
    return out.withColumn("dosage", F.nanvl("dosage", F.lit(None).cast("double")))
