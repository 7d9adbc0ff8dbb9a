"""Mixing sources to target weights: exact block quotas, split among output shards by a hypergeometric tree.

A document belongs to one of the blocks of its source. A source's target is met by whole passes over its blocks and one
partial pass of permuted blocks, whose last ones are chosen by subset sums so that their words come nearest to what is
left. The units (pass, block) of all sources are dealt to the output shards by a binary tree: each node draws, from a
multivariate hypergeometric distribution, how many units of every source go left. A shard gets disjoint runs of each
source's permuted units, and orders its own documents by a hash. Shards, and the blocks of a source, follow the number of
words. The driver holds a number for each source and shard, MOST_ENDS in all, never blocks or documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import Scratch

CAP, SEED = 3, 20260925
#: Words of a shard and of one of its runs; blocks of a source for each shard; shards and blocks at least; numbers that the
#: driver holds at most, by sources times shards: with more sources shards grow, and have more runs.
SHARD_WORDS, RUN_WORDS, BLOCKS_EACH, SHARDS, BLOCKS, MOST_ENDS = 1 << 27, 1 << 18, 16, 16, 1024, 1 << 20
#: Blocks before and behind the end of a partial pass that subset sums choose from; sums that are told apart.
CHOICE, SUMS = 64, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> dict[str | None, float]:
    """Each source's share of all words: by weights that repeat over the sources in code point order (null last); a
    share over cap times the source's size stops there and its excess is shared again by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {s: 0.0 for s in order}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def split_tree(units: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """How many units of each source each shard gets: rows are shards, columns sum to units."""
    out = np.zeros((shards, len(units)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        go = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left, rest, want = np.zeros_like(have), int(have.sum()), go
        for s, n in enumerate(have):  # one hypergeometric draw for each source, given those before it
            rest -= int(n)
            left[s] = rng.hypergeometric(int(n), rest, want) if want and n else 0
            want -= int(left[s])
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, shards, np.asarray(units, np.int64))
    return out


def _key(seed: int, *parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest(), "big")


def nearest(sizes: list[int], want: float) -> list[int]:
    """Indices of sizes whose sum comes nearest to want: exact up to SUMS in all, else of sizes rounded to a share of
    1 / SUMS of their sum. The reachable sums are the bits of a number for each size in turn."""
    unit = max(1, -(-sum(sizes) // SUMS))
    small = [-(-n // unit) if unit > 1 else n for n in sizes]
    reach = [1]
    for n in small:
        reach.append(reach[-1] | reach[-1] << n)
    goal = want / unit
    low = max(0, int(goal))
    below = (reach[-1] & ((1 << (low + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> (low + 1)
    up = low + (above & -above).bit_length() if above else None
    left = up if up is not None and up - goal < goal - below else below
    out = []
    for k in range(len(small) - 1, -1, -1):
        if not reach[k] >> left & 1:
            out.append(k)
            left -= small[k]
    return out[::-1]


def draw(words: list[int], order: list[int], want: float) -> list[int]:
    """Of blocks in a permuted order, those that are taken: the first ones up to CHOICE before their sum passes want, and
    of the next 2 * CHOICE those that bring it nearest to want."""
    total, end = 0, 0
    while end < len(order) and total + words[order[end]] <= want:
        total += words[order[end]]
        end += 1
    first = max(0, min(end - CHOICE, len(order) - 2 * CHOICE))
    choice = order[first : first + 2 * CHOICE]
    base = sum(words[b] for b in order[:first])
    return order[:first] + [choice[k] for k in nearest([words[b] for b in choice], want - base)]


def _choose(plan: dict[tuple[bool, str], float], seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none, source = bool(pdf["mix_none"].iloc[0]), pdf["mix_src"].iloc[0]
        words, target = pdf["words"].tolist(), plan[none, source]
        size = sum(words)
        passes = min(int(target // size), CAP) if size else 0
        name = pdf["mix_block"].tolist()
        order = sorted(range(len(words)), key=lambda k: _key(seed, none, source, name[k]))
        rows = [(none, source, name[b], p, p * len(order) + k) for p in range(passes) for k, b in enumerate(order)]
        part = draw(words, order, target - passes * size) if size and passes < CAP else []
        rows += [(none, source, name[b], passes, passes * len(order) + k) for k, b in enumerate(part)]
        return pd.DataFrame(rows, columns=["mix_none", "mix_src", "mix_block", "pass", "turn"]).astype({"mix_none": bool, "mix_src": object, "mix_block": "int64", "pass": "int32", "turn": "int64"})

    return run


def _deal(ends: dict[tuple[bool, str], np.ndarray]):
    """The shard of each unit: a source's turns up to its first end go to shard 0, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            turns, shard = t.column("turn").to_numpy(), np.zeros(t.num_rows, np.int32)
            source = np.array(list(zip(t.column("mix_none").to_pylist(), t.column("mix_src").to_pylist(), strict=True)) or [("", "")], dtype="O,O")[: t.num_rows]
            for key in set(source.tolist()):
                on = np.array([k == key for k in source.tolist()], bool)
                shard[on] = np.searchsorted(ends[key], turns[on], "right")
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("mix_none", "mix_src", "mix_block", "pass")), pa.array(shard)], ["mix_none", "mix_src", "mix_block", "pass", "shard"])

    return run


#: Block rows up to which they go to every executor; beyond it they are joined by a shuffle.
MOST_BROADCAST = 200_000
BY = ["mix_none", "mix_src", "mix_block"]


def _place(blocks: int, seed: int, doc_id: str = "doc_id", source: str = "source") -> list:
    """The key of a row's block: whether its source is null, the source, and a number by hash of doc_id."""
    name = F.col(source).cast("string")
    block = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit(seed)), F.lit(blocks))
    return [name.isNull().alias(BY[0]), F.coalesce(name, F.lit("")).alias(BY[1]), block.alias(BY[2])]


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def layout(words: int, sources: int) -> tuple[int, int, int]:
    """(shards, runs of a shard, blocks of a source) for so many words and sources."""
    shards = max(SHARDS, min(-(-words // SHARD_WORDS), max(1, MOST_ENDS // max(1, sources))))
    return shards, max(1, -(-words // (shards * RUN_WORDS))), max(BLOCKS, BLOCKS_EACH * shards)


def plan_blocks(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, blocks: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, int, int]:
    """(sizes of the documents, draws of each block, blocks of a source, runs of a shard): what the mix decides. The
    first two are written tables."""
    spark = docs.sparkSession
    store = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = store.keep(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size.alias("size")), "sized")
    name = F.col("source")
    found = sized.groupBy(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("src")).agg(F.sum("size").alias("n")).collect()
    sizes = {(r["none"], r["src"]): int(r["n"]) for r in found}
    made, runs, many = layout(sum(sizes.values()), len(sizes))
    shards, blocks = shards or made, blocks or many
    stats = store.keep(sized.select(*_place(blocks, seed), "size").groupBy(*BY).agg(F.sum("size").alias("words")), "blocks")
    aim = targets({None if none else s: n for (none, s), n in sizes.items()}, weights)
    plan = {k: aim[None if k[0] else k[1]] for k in sizes}
    units = store.keep(stats.groupBy(*BY[:2]).applyInPandas(_choose(plan, seed), "mix_none boolean, mix_src string, mix_block long, pass int, turn long"), "units")
    count = {(r[0], r[1]): r["count"] for r in units.groupBy(*BY[:2]).count().collect()}
    names = sorted(sizes, key=lambda k: (k[0], k[1].encode()))
    ends = np.cumsum(split_tree(np.array([count.get(k, 0) for k in names]), shards, seed), axis=0)
    dealt = units.mapInArrow(_deal({k: ends[:, i] for i, k in enumerate(names)}), "mix_none boolean, mix_src string, mix_block long, pass int, shard int")
    dealt = dealt.groupBy(*BY).agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("draws"))
    facts = spark.createDataFrame([(*k, sizes[k], plan[k]) for k in names], "mix_none boolean, mix_src string, source_size long, target double")
    empty = F.from_json(F.lit("[]"), "array<struct<pass:int,shard:int>>")
    draws = stats.join(dealt, BY, "left").join(facts, BY[:2]).select(*BY, "source_size", "target", F.coalesce("draws", empty).alias("draws"))
    return sized, store.keep(draws, "draws"), blocks, runs


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) mixed so that all words are shared among the sources by weight.

    Returns doc_id, source, size (words of the text; null text 0), source_size, target (of its source), draws: an array
    of struct(pass, shard), one entry for each time the mix takes the document, at most CAP. A null source is a source
    of its own, last in order. A source without words has target 0 and no draws. Rows that repeat a doc_id share a
    block and so are drawn together; a null doc_id has a block too. Reruns agree: everything follows from hashes.
    A source's size, target and shards' shares reach the driver, MOST_ENDS numbers at most while there are fewer than
    MOST_ENDS / SHARDS sources, and some numbers for each source beyond. Other columns are ignored; no rows give none.
    """
    sized, draws, blocks, _ = plan_blocks(docs, weights, shards, blocks, seed)
    out = sized.select("*", *_place(blocks, seed)).join(_bounded(draws), BY)
    return out.select("doc_id", "source", "size", "source_size", "target", "draws")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int | None = None, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as mix(docs) draws them, with docs' columns of whatever names, shuffled inside each
    shard: rows of one shard come in the order of a hash, cut into runs that follow each other and may lie in different
    partitions. Nulls, ties, repeats and empty tables are as in mix."""
    _, draws, blocks, runs = plan_blocks(docs, weights, shards, blocks, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash
    both = docs.select(row).select("row", *_place(blocks, seed, "row.doc_id", "row.source")).join(_bounded(draws.select(*BY, "draws")), BY)
    rank = F.shiftrightunsigned(F.xxhash64("row.doc_id", "draw.pass", F.lit(seed + 1)), 1)
    each = both.select("row", F.explode("draws").alias("draw")).select("row", "draw.shard", rank.alias("rank"))
    run = F.shiftright(F.shiftright("rank", 32) * F.lit(runs), 31)
    return each.repartition("shard", run).sortWithinPartitions("shard", "rank").select(*[F.col(f"row.`{c}`") for c in docs.columns])
