"""Near-duplicate documents by HyperMinHash.

A document's 64-bit shingle hashes fall into REGISTERS buckets; of the least value in each bucket the register keeps
the number of leading zeros (6 bits) and the MANTISSA bits after the leading one. Empty registers borrow from a full
one, chosen by a walk that is the same in every document, so small sets agree register by register with a probability
equal to their Jaccard similarity. BANDS bands of four registers find candidates: at a similarity of 0.75 a pair shares
no band with a probability under 1e-5.

Links are settled in three rounds, each of which only looks at what is still apart. Round 1 pairs each member with one
leader, the central member that it shares most buckets with. Round 2 pairs the members of buckets that still hold
several components with two leaders of the bucket. Before verification the estimate, corrected for registers that agree
by chance, drops hopeless pairs, and what is left is confirmed on the full shingle sets (of 64-bit hashes of shingles).
Round 3 takes the buckets that are split even now and compares every member outside the largest component with all
members, block against block: similar sketches of different components are confirmed on the full sets at once, and only
the links that join components leave the task. After each round linked components become one, by contraction of one link
for each two components. Exact copies of a shingle set are one class from the start and are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm import common

REGISTERS, MANTISSA, BANDS = 128, 10, 32
#: Estimates this far under the threshold, four standard errors, aren't verified.
MARGIN = 0.15
#: Members of a leader that are verified together; a leader with more is dealt out by salt.
PER_TASK = 500
#: Buckets of so many members are settled by round 2, where their only pair meets.
SETTLED = 2
#: Members of a bucket that round 3 compares as one block.
BLOCK = 512


def sketch(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers, one row of uint16 for each set; 0 for the empty set."""
    rows = len(offsets) - 1
    out = np.zeros((rows, REGISTERS), np.uint16)
    if not len(values):
        return out
    row = np.repeat(np.arange(rows), np.diff(offsets))
    bucket = (values >> np.uint64(57)).astype(np.int64)
    rest = common.mix(values) >> np.uint64(1) | np.uint64(1)
    key = row * REGISTERS + bucket
    order = np.argsort(key, kind="stable")
    key, rest = key[order], rest[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.minimum.reduceat(rest, at)
    top = np.frexp(least.astype(np.float64))[1]  # bits that are used; rounding up is the same everywhere
    zeros = np.clip(63 - top, 0, 62).astype(np.uint64)
    shift = np.clip(top - 1 - MANTISSA, 0, 63).astype(np.uint64)
    tail = (least >> shift) & np.uint64((1 << MANTISSA) - 1)
    flat = out.reshape(-1)
    flat[key[at]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | tail).astype(np.uint16)
    some = np.flatnonzero(np.diff(offsets) > 0)
    need_row, need_reg = np.nonzero(out[some] == 0)
    full, step = out[some] != 0, 0
    while len(need_row):
        step += 1
        donor = (common.mix(need_reg.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step)) >> np.uint64(57)).astype(np.int64)
        got = full[need_row, donor]
        out[some[need_row[got]], need_reg[got]] = out[some[need_row[got]], donor[got]]
        need_row, need_reg = need_row[~got], need_reg[~got]
    return out


LEVELS = np.arange(1, 41, dtype=np.float64)


def mass(n: np.ndarray) -> np.ndarray:
    """For sets of n shingles, the chance of each number of leading zeros in a register."""
    per = np.maximum(np.asarray(n, np.float64) / REGISTERS, 1.0)[..., None]
    return (1 - 2.0**-LEVELS) ** per - (1 - 2.0 ** -(LEVELS - 1)) ** per


def estimate(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray) -> np.ndarray:
    """Jaccard similarity from sketches x and y of sets with masses mx and my, less the agreement expected by chance."""
    agree = (x == y).mean(axis=-1)
    chance = (mx * my).sum(axis=-1) * 2.0**-MANTISSA
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.buffers(batch.column("text"))
        for a, b in common.slices(offsets, 1 << 20):
            at = offsets[a : b + 1]
            values, ends = common.shingles(data[at[0] : at[-1]], at - at[0])
            n = np.diff(ends)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(common.mix(values + np.uint64(s)))]) for s in (1, 2)]
            one, two = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
            regs = sketch(values, ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(one), pa.array(two), pa.array([r.tobytes() if k else None for r, k in zip(regs, n)], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two 64-bit digests of the shingle set, and the sketch (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signatures, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")


def bands(classes: DataFrame) -> DataFrame:
    """One row for each class and band: key, doc_id."""
    width = 2 * REGISTERS // BANDS
    keys = F.array(*[F.xxhash64(F.substring("sketch", width * b + 1, width), F.lit(b)) for b in range(BANDS)])
    return classes.select(F.posexplode(keys).alias("band", "key"), "doc_id")


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _shared(banded: DataFrame) -> DataFrame:
    """The band rows of buckets with more than one member, with the bucket's size n and the weight of the member: the
    sizes of its buckets in all, which is greatest for an original among its edited copies."""
    many = banded.join(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    return many.join(many.groupBy("doc_id").agg(F.sum("n").alias("weight")), "doc_id")


def _first_pairs(shared: DataFrame) -> DataFrame:
    """Each member once, with the one of its buckets' central members that it meets in most bands."""
    central = F.max(F.struct("weight", F.bitwise_not("doc_id").alias("m"))).alias("central")
    lead = shared.groupBy("key").agg(central).select("key", "central.weight", F.bitwise_not("central.m").alias("leader"))
    met = shared.drop("weight").join(lead, "key").where("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("times"), F.max("weight").alias("weight"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("times", "weight", F.bitwise_not("leader").alias("m"))).alias("best"))
    return best.select(F.bitwise_not("best.m").alias("a"), F.col("doc_id").alias("b"))


def _split(spread: DataFrame) -> DataFrame:
    """The rows of spread(key, component, ...) in buckets that hold several components."""
    keys = spread.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return spread.join(keys, "key", "left_semi")


def _second_pairs(split: DataFrame, tried: DataFrame) -> DataFrame:
    """Each member of a bucket that is still split with the bucket's central member, and with one that is least in an
    order of the band's own, where they are in other components and were no pair before."""
    other = F.min(F.struct(F.xxhash64("doc_id", "band").alias("h"), F.col("doc_id").alias("m"), F.col("component").alias("c"))).alias("other")
    central = F.max(F.struct("weight", F.bitwise_not("doc_id").alias("m"), F.col("component").alias("c"))).alias("central")
    lead = split.groupBy("key").agg(central, other)
    lead = lead.select("key", F.explode(F.array(F.struct(F.bitwise_not("central.m").alias("m"), "central.c"), F.struct("other.m", "other.c"))).alias("l"))
    pairs = split.join(lead, "key").where("component <> l.c").select(F.col("l.m").alias("a"), F.col("doc_id").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            est = estimate(x, y, mass(t.column("na").to_numpy()), mass(t.column("nb").to_numpy()))
            yield t.filter(pa.array(est >= threshold - MARGIN)).select(["a", "b"])

    return run


def _screen(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose estimated similarity, or whose ratio of set sizes, leaves the threshold possible."""
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return both.mapInArrow(_likely(threshold), "a long, b long")


def _verify(percent: int):
    def run(key, left, right):
        a, b = [], []
        if left.num_rows and right.num_rows:
            every, bounds = common.shingles(*common.buffers(left.column("text")))  # one text, unless a doc_id repeats
            data, offsets = common.buffers(right.column("rtext"))
            ids = right.column("b").to_numpy()
            for i, j in common.slices(offsets, 1 << 20):
                at = offsets[i : j + 1]
                values, ends = common.shingles(data[at[0] : at[-1]], at - at[0])
                ok = np.zeros(j - i, bool)
                for mine in filter(len, np.split(every, bounds[1:-1])):
                    hit = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
                    total = np.concatenate([[0], np.cumsum(hit)])
                    shared = total[ends[1:]] - total[ends[:-1]]
                    ok |= 100 * shared >= percent * (len(mine) + np.diff(ends) - shared)
                b += np.unique(ids[i:j][ok]).tolist()
            a = [key[0].as_py()] * len(b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def confirm(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs of which 100 * intersection >= percent * union holds on the full shingle sets.

    A leader's text goes once to each group of at most about PER_TASK of its partners.
    """
    texts = reps.select("doc_id", "text").hint("merge")
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).alias("salts")), "a")
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    right = salted.join(texts, salted.b == texts.doc_id).select(F.col("a").alias("ra"), F.col("salt").alias("rsalt"), "b", F.col("text").alias("rtext"))
    groups = salted.select("a", "salt").distinct()
    left = groups.join(texts, groups.a == texts.doc_id).select("a", "salt", "text")
    return left.groupBy("a", "salt").cogroup(right.groupBy("ra", "rsalt")).applyInArrow(_verify(percent), "a long, b long")


def components(links: DataFrame, store: common.Scratch, name: str) -> DataFrame:
    """node, component (the least node that is reachable) of every node of links(a, b).

    Each step sends every node to that neighbour, or itself, which is first in an order by hash, and goes on with the
    links between the nodes that were reached. They are fewer at each step, in stars and in chains alike, so the work of
    all steps stays in proportion to the links. Steps are written tables; the driver sees only counts.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
    edges = store.keep(links.select(*_pair("a", "b")).where("a <> b").distinct(), f"{name}-0")
    moves: list[DataFrame] = []
    while edges.count():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        near = ends.groupBy("node").agg(F.min(first("to")).alias("near"))
        move = store.keep(near.select("node", F.least("near", first("node"))["to"].alias("to")), f"{name}-move-{len(moves)}")
        moves.append(move)
        side = lambda k: move.select(F.col("node").alias(k), F.col("to").alias(f"to_{k}"))  # noqa: E731, B023
        edges = edges.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b").select(*_pair("to_a", "to_b")).distinct()
        edges = store.keep(edges, f"{name}-{len(moves)}")
        store.drop(f"{name}-{len(moves) - 1}")
    if not moves:
        return links.sparkSession.createDataFrame([], "node long, component long")
    end = moves.pop()
    for move in reversed(moves):
        later = end.select(F.col("node").alias("to"), F.col("to").alias("last"))
        end = move.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    end = store.keep(end, f"{name}-ends")
    least = end.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component"))
    return store.keep(end.join(least, "to").select("node", "component"), f"{name}-components")


def _joined(named: DataFrame, links: DataFrame, store: common.Scratch, name: str) -> DataFrame:
    """named(doc_id, component) after links(a, b) between its documents: linked components become one, under the least
    id. Only one link for each two components goes on."""
    side = lambda k: named.select(F.col("doc_id").alias(k), F.col("component").alias(f"c_{k}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    new = components(between, store, name).select(F.col("node").alias("component"), F.col("component").alias("new"))
    return store.keep(named.join(new, "component", "left").select("doc_id", F.coalesce("new", "component").alias("component")), f"{name}-named")


def _near(percent: int, band: int, left: tuple, right: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """For each member on the left, the members on the right of another component that may be similar enough, the most
    similar first; not those that it meets in an earlier band. A side: components, set sizes, sketches."""
    comp, n, regs = left
    comp2, n2, regs2 = right
    width = REGISTERS // BANDS
    early, early2 = (r[:, : width * band].reshape(len(r), band, width) for r in (regs, regs2))
    m, m2 = mass(n), mass(n2)
    for i in range(len(comp)):
        near = np.flatnonzero((comp2 != comp[i]) & (100 * np.minimum(n2, n[i]) >= percent * np.maximum(n2, n[i])))
        if band and len(near):
            near = near[~(early2[near] == early[i]).all(axis=2).any(axis=1)]
        if len(near):
            est = estimate(regs2[near], regs[i], m2[near], m[i])
            on = est >= percent / 100 - MARGIN
            near = near[on][np.argsort(-est[on], kind="stable")]
        if len(near):
            yield i, near


def _sight(percent: int):
    """The members of two blocks that have a candidate in the other one."""

    def run(key, left, right):
        found = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            side = lambda t: (t.column(1).to_numpy(), t.column(2).to_numpy(), np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(-1, REGISTERS))
            ids, ids2 = left.column(0).to_numpy(), right.column(0).to_numpy()
            rows, columns = [], np.zeros(len(ids2), bool)
            for i, near in _near(percent, key[1].as_py(), side(left), side(right)):
                rows.append(i)
                columns[near] = True
            found = np.union1d(ids[rows], ids2[columns]) if rows else found
        return pa.table({"key": pa.array([key[0].as_py()] * len(found), pa.int64()), "doc_id": pa.array(found, pa.int64())})

    return run


def _sets(t: pa.Table) -> tuple[np.ndarray, ...]:
    data, offsets = common.buffers(t.column(2))
    values, ends = common.shingles(data, offsets)
    return t.column(0).to_numpy(), t.column(1).to_numpy(), values, ends, sketch(values, ends)


def _meet(percent: int):
    """Confirmed links that join components, between the members of two blocks."""

    def run(key, left, right):
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids, comp, values, ends, regs = _sets(left)
            ids2, comp2, values2, ends2, regs2 = _sets(right)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, near in _near(percent, key[1].as_py(), (comp, np.diff(ends), regs), (comp2, np.diff(ends2), regs2)):
                own = values[ends[i] : ends[i + 1]]
                for j in near.tolist():
                    x, y = find(int(comp[i])), find(int(comp2[j]))
                    if x == y:
                        continue
                    other = values2[ends2[j] : ends2[j + 1]]
                    shared = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if 100 * shared >= percent * (len(own) + len(other) - shared):
                        root[max(x, y)] = min(x, y)
                        a.append(min(int(ids[i]), int(ids2[j])))
                        b.append(max(int(ids[i]), int(ids2[j])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _blocks(members: DataFrame, columns: list[str]):
    """Members of each bucket against each other, block by block: (left, right) grouped for a cogroup. The left holds
    those outside the bucket's largest component, the right all; a task gets two blocks of about BLOCK members, with
    doc_id, component and `columns` first."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", F.bitwise_not("component").alias("m"))).alias("top"), F.sum("c").alias("total"))
    main = main.select("key", F.bitwise_not("top.m").alias("main"), F.ceil((F.col("total") - F.col("top.c")) / BLOCK).alias("rows"), F.ceil(F.col("total") / BLOCK).alias("columns"))
    full = members.join(main, "key").where("rows > 0").withColumns({"row": F.pmod(F.xxhash64("doc_id"), "rows"), "column": F.pmod(F.xxhash64("doc_id", F.lit(1)), "columns")})
    place = ["key", "band", "row", "column"]
    left = full.where("component <> main").withColumn("column", F.explode(F.expr("sequence(0, columns - 1)"))).select("doc_id", "component", *columns, *place)
    right = full.withColumn("row", F.explode(F.expr("sequence(0, rows - 1)"))).select(*[F.col(c).alias(f"r_{c}") for c in ("doc_id", "component", *columns, *place)])
    return left.groupBy(*place).cogroup(right.groupBy(*[f"r_{c}" for c in place]))


def _joining_links(members: DataFrame, reps: DataFrame, percent: int, store: common.Scratch) -> DataFrame:
    """Round 3 over members(key, band, doc_id, component, n): sketches show who has a candidate in which bucket, and only
    those members' texts meet there."""
    sketched = members.join(reps.select("doc_id", "n_shingles", "sketch").hint("merge"), "doc_id")
    seen = store.keep(_blocks(sketched, ["n_shingles", "sketch"]).applyInArrow(_sight(percent), "key long, doc_id long").distinct(), "seen")
    there = members.join(seen, ["key", "doc_id"], "left_semi").join(reps.select("doc_id", "text").hint("merge"), "doc_id")
    return _blocks(there, ["text"]).applyInArrow(_meet(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Near-duplicate components of docs(doc_id, text, ...), linked at 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id = component_id). Texts that are
    null or have no word have no shingle, link with nothing and are kept. Rows that repeat a doc_id each get a row, by
    their own text; where that doc_id is the least of two texts' copies, both texts stand for it and it is linked where
    either is. Rows with a null doc_id get a null component, link with nothing and are kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    store = common.Scratch(docs.sparkSession, "neardup")
    threshold = percent / 100
    sig = store.keep(signatures(docs), "sig")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    by = ["n_shingles", "set_a", "set_b"]
    classes = store.keep(full.groupBy(*by).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "classes")
    shared = store.keep(_shared(bands(classes)), "shared")
    meeting = shared.select("doc_id").distinct()  # representatives of classes that share a band with another
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = classes.select("doc_id", "n_shingles", "sketch").join(meeting.hint("merge"), "doc_id", "left_semi")
    reps = store.keep(known.join(texts.hint("merge"), "doc_id"), "texts")  # joins of texts are the same at any size
    tried = store.keep(_first_pairs(shared), "tried")
    links = store.keep(confirm(_screen(tried, reps, threshold), reps, percent), "links")
    named = _joined(meeting.select("doc_id", F.col("doc_id").alias("component")), links, store, "first")

    split = store.keep(_split(shared.join(named, "doc_id")), "split")
    links = store.keep(confirm(_screen(_second_pairs(split, tried), reps, threshold), reps, percent), "more-links")
    named = _joined(named, links, store, "second")

    members = store.keep(_split(split.drop("component").where(F.col("n") > SETTLED).join(named, "doc_id")), "members")
    named = _joined(named, _joining_links(members, reps, percent, store), store, "last")
    for name in ("shared", "texts", "tried", "links", "split", "more-links", "members"):
        store.drop(name)

    facts = classes.join(named, "doc_id", "left").select(*by, F.coalesce("component", "doc_id").alias("component"))
    out = sig.drop("sketch").join(facts, by, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
