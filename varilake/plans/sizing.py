"""How much memory reading and exporting take: estimates from the sizes of a data set."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from varilake.model import Genotypes

# Bytes of a stored genotype besides its texts (three whole numbers, two text offsets, a bit, three
# decimals), of one as exports read it, of a cell of a dense matrix; bounds of a chunk.
ROW_BYTES = 3 * 4 + 2 * 4 + 1 / 8 + 3 * 8
READ_BYTES = 20
CELL_BYTES = {"compact": 1, "plain": 4}
CHUNK_BOUNDS = (1_000, 500_000)


def chunk_size_for(available_gb: float, n_samples: int, fmt_chars: float = 25, sample_chars: float = 10, workers: int = 1) -> int:
    """Variants per chunk so that half of the memory holds one chunk per worker; several workers also hold the raw text twice."""
    per_genotype = ROW_BYTES + sample_chars + fmt_chars + (2 * (fmt_chars + 1) if workers > 1 else 0)
    fits = available_gb * 2**30 / 2 / max(1, workers) / (n_samples * per_genotype)
    return int(min(max(math.floor(fits), CHUNK_BOUNDS[0]), CHUNK_BOUNDS[1]))


def memory_estimate(data: Genotypes, keep_groups: list[str] | None = None, format: str = "individual", chunk_size: int = 50_000, lowmem: bool = False) -> dict[str, int]:
    """What an export would hold if it kept everything at once: n_var (biallelic SNVs), n_samples, n_pops, and bytes.

    format: individual (a dense matrix of both alleles), pop (counts per population), chunk (two chunks).
    """
    if format not in ("individual", "pop", "chunk"):
        raise ValueError("format must be individual, pop or chunk")
    groups = [r[0] for r in data.samples.orderBy("sample_idx").select("grp").collect()]
    keep = list(dict.fromkeys(groups)) if keep_groups is None else keep_groups
    n_samples, n_var = sum(g in keep for g in groups), data.variants.where("is_biallelic AND NOT is_indel").agg(F.count(F.lit(1))).first()[0]
    chunk = chunk_size * n_samples * READ_BYTES
    individual, pop = 2 * n_samples * n_var * CELL_BYTES["compact" if lowmem else "plain"], 2 * len(keep) * n_var * CELL_BYTES["plain"]
    peak = {"individual": individual + chunk, "pop": pop + chunk, "chunk": 2 * chunk}[format]
    return {"n_var": n_var, "n_samples": n_samples, "n_pops": len(keep), "chunk_bytes": chunk, "matrix_bytes": individual if format == "individual" else pop, "peak_bytes": peak}
