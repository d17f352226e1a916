"""Filling containers of fixed capacity with texts, by minimum bin slack.

Texts are measured in tokens of a public tokenizer. A text longer than a container is cut: its full pieces are
containers of their own, only the remainder is packed. Remainders are spread evenly over shards; in each, one container
after the other is given the fullest feasible combination of the texts left, found by subset-sum dynamic programming
over the lengths still available, held as the bits of an integer. A container begins with the longest text left if that
is longer than a seed; a shard is packed for several seeds, and the best packing is taken. Containers of a shard that
end up with room left over are emptied and their texts spread and packed again in rounds, until one shard holds all such
texts or a round leaves most of its texts as they were.
"""

from __future__ import annotations

import base64
import hashlib
import math
import sys
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varilake.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
"""Fixed value: how the vocabulary's tokenizer splits a text before merging."""
SHARD_ITEMS = 20_000
"""Texts that one task packs."""
SEEDS = (0.5, 1 / 3, 0.0)
"""Shares of the capacity above which the longest text left begins a container."""
WORTH = 0.75
"""Packing again goes on while a round leaves fewer than this share of the texts of the round before."""
MAX_VOCABULARY = 64 << 20
REPACK_BELOW = 0.995
"""Containers filled less than this are packed again together with those of other shards."""

_PLACED = "target_id INT, bin STRING, doc_id BIGINT, piece INT, n_tokens INT, fill INT"
_ENCODERS: dict[str, object] = {}


def _encoder(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    name = hashlib.md5(vocabulary).hexdigest()
    if name not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def read_vocabulary(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    """Read by the driver, at most MAX_VOCABULARY bytes, and sent to the tasks, which need no such folder."""
    data = Path(folder, vocabulary).read_bytes()
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(data)} bytes; at most {MAX_VOCABULARY}")
    return data


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens). Null texts are left out; the empty text has no tokens; texts are measured whole."""
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array([len(encode(t)) for t in b[1].to_pylist()], pa.int32())], names=[key, "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(count, f"{key} {kind}, n_tokens INT")


def fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """Lengths and how many of each, from left[length] available ones, whose sum is the largest not above room."""
    mask = (1 << (room + 1)) - 1
    reach, steps, target = 1, [], 1 << room
    for size in np.flatnonzero(left[: room + 1])[::-1]:
        size, copies, chunk = int(size), min(int(left[size]), room // int(size)), 1
        while copies > 0 and not reach & target:
            take = min(chunk, copies)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            copies, chunk = copies - take, 2 * chunk
        if reach & target:
            break
    total, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            total -= size * take
            chosen[size] = chosen.get(size, 0) + take
    return chosen


def pack(sizes: np.ndarray, capacity: int, seeds: tuple[float, ...] = SEEDS) -> np.ndarray:
    """The container number of each item; sizes from 1 to capacity. Equal items are taken in their order.

    Packed once for each of the seeds, and the packing with the fewest containers, the first of equals, is taken.
    """
    return min((_pack(sizes, capacity, seed * capacity) for seed in seeds), key=lambda bins: bins.max(initial=-1))


def _pack(sizes: np.ndarray, capacity: int, seed: float) -> np.ndarray:
    """A container begins with the longest text left if that is longer than seed, and is made as full as can be."""
    order = np.argsort(sizes, kind="stable")
    left = np.bincount(sizes, minlength=capacity + 1)
    nxt = np.concatenate([[0], np.cumsum(left)[:-1]])
    out = np.empty(len(sizes), dtype=np.int64)
    n_bin, longest, remaining = 0, capacity, len(sizes)
    while remaining:
        while not left[longest]:
            longest -= 1
        if longest > seed:
            left[longest] -= 1
            chosen = fullest(left, capacity - longest)
            left[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
        else:
            chosen = fullest(left, capacity)
        for size, n in chosen.items():
            out[order[nxt[size] : nxt[size] + n]] = n_bin
            nxt[size] += n
            left[size] -= n
            remaining -= n
        n_bin += 1
    return out


def _round(items: DataFrame, shards: DataFrame, name: str) -> DataFrame:
    """One packing of (target_id, capacity, doc_id, piece, n_tokens) in shards; shards: target_id, n_shards."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable")
        bins = pack(rows["n_tokens"].to_numpy(), int(rows["capacity"].iloc[0]))
        fill = np.bincount(bins, weights=rows["n_tokens"]).astype(np.int64)[bins]
        return pd.DataFrame({"target_id": rows["target_id"], "bin": [f"{name}{key[1]}-{b}" for b in bins], "doc_id": rows["doc_id"], "piece": rows["piece"], "n_tokens": rows["n_tokens"], "fill": fill})

    spread = items.join(F.broadcast(shards), "target_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(name)), F.col("n_shards")))
    return spread.groupBy("target_id", "shard").applyInPandas(packed, _PLACED)


def fill_containers(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS, again: float = REPACK_BELOW) -> DataFrame:
    """(target_id, bin, doc_id, piece, first_token, n_tokens): every text placed once for every target.

    targets: target_id, capacity_tokens, a few rows (at most 1,000, else an error). piece numbers the parts of a cut
    text from 0, first_token is where a part begins. A text of at most the capacity is never cut. The work of a task is
    bounded by shard_items, whatever the number of texts or of equal lengths. Null and empty texts need no room and are
    left out; rows that repeat are packed again; a target without a positive capacity is an error. Empty tables give
    no row. Deterministic: shards come from the ids, ties go by id.
    """
    plan = [(r[0], r[1]) for r in targets.select("target_id", "capacity_tokens").limit(1001).collect()]
    if len(plan) > 1000 or any(not c or c < 1 for _, c in plan):
        raise ValueError("targets must be at most 1,000 rows with positive capacities")
    spark = docs.sparkSession
    if not plan:
        return spark.createDataFrame([], f"target_id INT, bin STRING, {key} BIGINT, piece INT, first_token INT, n_tokens INT")
    sized = materialize(count_tokens(docs, key, text, folder, vocabulary).where("n_tokens > 0").withColumnRenamed(key, "doc_id"))
    caps = spark.createDataFrame(plan, "target_id INT, capacity INT")
    choices = F.array(*(F.struct(F.lit(t).cast("int").alias("target_id"), F.lit(c).cast("int").alias("capacity")) for t, c in plan))
    each = sized.withColumn("_t", F.explode(choices)).select("doc_id", "n_tokens", "_t.*")
    whole = F.expr("n_tokens DIV capacity").cast("int")
    full = each.where("n_tokens >= capacity").select(
        "target_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"), "doc_id", F.col("capacity").alias("n_tokens")
    ).select("target_id", F.concat(F.lit("w"), "doc_id", F.lit("-"), "piece").alias("bin"), "doc_id", "piece", "n_tokens")
    todo = each.where("n_tokens % capacity > 0").select("target_id", "capacity", "doc_id", whole.alias("piece"), (F.col("n_tokens") % F.col("capacity")).alias("n_tokens"))
    placed, k, before = [], 0, math.inf
    while True:
        n = {r[0]: r[1] for r in todo.groupBy("target_id").count().collect()}
        shards = {t: max(1, math.ceil(m / shard_items)) for t, m in n.items()}
        table = spark.createDataFrame([(t, s) for t, s in shards.items()], "target_id INT, n_shards INT")
        out = materialize(_round(todo, table, f"r{k}s")).join(F.broadcast(caps), "target_id").join(F.broadcast(table), "target_id")
        total = sum(n.values())
        final = all(x == 1 for x in shards.values()) or total > WORTH * before  # one shard each, or packing again gains little
        last = F.lit(True) if final else (F.col("n_shards") == 1) | (F.col("fill") >= again * F.col("capacity"))
        placed.append(out.where(last).select("target_id", "bin", "doc_id", "piece", "n_tokens"))
        todo, k, before = out.where(~last).select("target_id", "capacity", "doc_id", "piece", "n_tokens"), k + 1, total
        if final:
            break
    for p in placed:
        full = full.unionByName(p)
    return full.join(F.broadcast(caps), "target_id").select("target_id", "bin", F.col("doc_id").alias(key), "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "n_tokens")


def fill_report(docs: DataFrame, targets: DataFrame, **options: object) -> DataFrame:
    """(target_id, containers, least, fill): the containers of fill_containers, a number that no packing can be below, and
    the share of their room that is used. least counts the full pieces and, of the remainders, their room or those that
    are longer than half a container, whichever is more."""
    placed = fill_containers(docs, targets, **options).join(F.broadcast(targets.select("target_id", "capacity_tokens")), "target_id")
    bins = placed.groupBy("target_id", "capacity_tokens", "bin").agg(F.sum("n_tokens").cast("bigint").alias("used"), F.count_if(F.col("n_tokens") * 2 > F.col("capacity_tokens")).alias("large"))
    room = bins.groupBy("target_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"), F.sum("large").alias("large"))
    least = F.greatest(F.ceil(F.col("used") / F.col("capacity_tokens")), "large")
    return room.select("target_id", "containers", least.cast("bigint").alias("least"), (F.col("used") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
