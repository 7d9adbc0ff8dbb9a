"""Top-k retrieval by TF-IDF cosine over character n-grams, by inverted indexes over blocks of targets.

Weights: 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1, with n and df of the targets alone, L2-normalized. A gram that no
target has counts in a query's norm, with df 0, unless `unseen` is off. Names and addresses combine as (1 - a) and a times their cosines, over the parts that
each record has.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions import pieces
from weftlink.functions import text as tx
from weftlink.sources.tables import stored

#: Targets in a block at most, queries in a block for each block of targets, and grams in a block.
PER_LIST, PER_BLOCK, CODES = 1 << 15, 1 << 11, 1 << 24
#: Numbers in a matrix of common grams at most; a gram is common from one in so many targets.
CELLS, COMMON = 1 << 22, 16
#: Bytes of texts that are packed at once, and queries that are asked at once.
PACKED, ASKED = 1 << 24, 1 << 11


@dataclass(frozen=True)
class RetrievalConfig:
    """low, high: characters of a gram; address_weight: share of the address (0: names alone); max_df: grams in more
    targets of a group join nothing (None: all do)."""

    top_k: int = 100
    low: int = 2
    high: int = 5
    min_similarity: float = 0.10
    address_weight: float = 0.0
    max_df: int | None = None
    unseen: bool = True


@dataclass(frozen=True)
class _Field:
    """A field that takes part: its column, the bag of its values, about how many grams it has, and its share."""

    column: Column
    bag: Callable
    size: Column
    share: float


def _parts(address_weight: float, of) -> list[_Field]:
    def field(name: str, made, share: float) -> _Field:
        column, bag, size = pieces.of_column(made)
        return _Field(column(F.col(name)), bag, size(F.col(name)).cast("long"), share)

    return [field("name", of, 1 - address_weight), field("address", tx.word_pairs, address_weight)] if address_weight else [field("name", of, 1.0)]


def _sizes(queries: DataFrame, targets: DataFrame, group: list[str], fields: list[_Field]) -> DataFrame:
    """(group, n, repeats, nt, nq): targets, whether an id has several rows, and blocks of targets and of queries."""
    codes = functools.reduce(operator.add, [f.size for f in fields])
    t = targets.groupBy("candidate_entity_id", *group).agg(F.count("*").alias("rows"), F.sum(codes).alias("codes"))
    t = t.groupBy(*group).agg(F.sum("rows").alias("n"), (F.max("rows") > 1).alias("repeats"), F.sum("codes").alias("codes"))
    t = t.withColumn("nt", F.greatest(F.ceil(F.col("n") / PER_LIST), F.ceil(F.col("codes") / CODES), F.lit(1))).drop("codes")
    q = queries.groupBy(*[g for g in group if g != "candidate_source"]).agg(F.count("*").alias("many"), F.sum(codes).alias("codes"))
    both = t.join(q, "country") if "country" in group else t.crossJoin(q)
    blocks = F.greatest(F.ceil(F.col("many") / (PER_BLOCK * F.col("nt"))), F.ceil(F.col("codes") / (4 * CODES)), F.lit(1))
    return both.select(*group, "n", "repeats", "nt", blocks.alias("nq"))


def _postings(bag: pieces.Bag, known: np.ndarray, df: np.ndarray, n: int, count: int, unseen: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code's place in known, weight) of unit vectors, in the order of rows. Codes that no target has only count in
    the norm, if unseen."""
    codes, row, at, tf = bag
    place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0)).astype(np.int32)
    met = known[place] == codes if len(known) else np.zeros(len(codes), bool)
    idf = np.log((1.0 + n) / (1.0 + (np.where(met, df[place], 0) if len(known) else 0))) + 1
    if not unseen:
        fine = met[at]
        row, at, tf = row[fine], at[fine], tf[fine]
    weight = np.log(tf)
    weight += 1
    if len(codes):
        weight *= idf[at]
    weight /= np.sqrt(np.bincount(row, weight * weight, count))[row]
    fine = met[at] if len(codes) else np.zeros(0, bool)
    return row[fine], place[at[fine]], weight[fine]


def _nearest(acc: np.ndarray, own: np.ndarray, w: np.ndarray, first: np.ndarray, rows: np.ndarray, wt: np.ndarray, by_row: tuple, low: float, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Targets whose cosine with a query can reach low and the top-th best, with exact cosines. acc: what the common grams
    add for each target; own, w: the query's other grams and their weights.

    Rare grams first. What the grams behind can add is bounded by their part's length, as a target's vector has length 1:
    once few targets can still reach `low` or the top-th best sum so far, the rest counts only for those."""
    count = len(acc)
    size = first[own + 1] - first[own]
    order = np.argsort(size, kind="stable")
    own, w, size = own[order], w[order], size[order]
    few = int(np.searchsorted(size, max(count // COMMON, 1), "right"))
    if few:  # all at once
        spots = pieces.spots(first[own[:few]], size[:few])
        acc += np.bincount(rows[spots], np.repeat(w[:few], size[:few]) * wt[spots], count)
    tail = (np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0.0)) * (1 + 1e-12)).tolist()
    behind, starts, ends, ws = np.append(np.cumsum(size[::-1])[::-1], 0).tolist(), first[own].tolist(), first[own + 1].tolist(), w.tolist()
    best = lambda: max(low, float(np.partition(acc, count - top)[count - top]) - 1e-8) if count > top else low
    i, work, hits = few, count, None
    while i < len(ws):
        if work >= count and behind[i] > count:
            work, hits = 0, np.flatnonzero(acc + tail[i] >= best())
            if len(hits) * 16 <= count:
                break
        a, b = starts[i], ends[i]
        acc[rows[a:b]] += ws[i] * wt[a:b]
        work += b - a
        i += 1
    else:
        hits = np.flatnonzero((acc > 0) & (acc >= best()))
    score = acc[hits]
    if i < len(ws) and len(hits):
        begin, place, weight, dense = by_row
        dense[own[i:]] = w[i:]
        n = begin[hits + 1] - begin[hits]
        hits, score, n = hits[n > 0], score[n > 0], n[n > 0]
        spots = pieces.spots(begin[hits], n)
        if len(hits):
            score = score + np.add.reduceat(weight[spots] * dense[place[spots]], np.cumsum(n) - n)
        dense[own[i:]] = 0.0
    least = low
    if len(score) > top:
        least = max(least, float(np.partition(score, len(score) - top)[len(score) - top]) - 1e-8)
    keep = (score >= least) & (score > 0)
    return hits[keep], score[keep]


def _sums(rows: np.ndarray, at: np.ndarray, weights: np.ndarray, edges: np.ndarray, first: np.ndarray, where: np.ndarray, wt: np.ndarray, common: np.ndarray, column: np.ndarray, count: int):
    """For each query in turn what the common grams add for all targets, by products of matrices, so many grams at once as
    fill one of CELLS numbers. first, where, wt: a gram's targets and weights; column: its place among common ones or -1."""
    wide = max(1, CELLS // max(count, 1))
    step = max(1, CELLS // max(count, wide, 1) // 2)
    for c in range(0, len(edges) - 1, step):
        last = min(c + step, len(edges) - 1)
        part = slice(edges[c], edges[last])
        spot = column[at[part]]
        sums = np.zeros((last - c, count))
        for g in range(0, len(common), wide):
            some = common[g : g + wide]
            here = np.flatnonzero((spot >= g) & (spot < g + wide))
            own, table = np.zeros((last - c, len(some))), np.zeros((len(some), count))
            own[rows[part][here] - c, spot[here] - g] = weights[part][here]
            n = first[some + 1] - first[some]
            spots = pieces.spots(first[some], n)
            table[np.repeat(np.arange(len(some)), n), where[spots]] = wt[spots]
            sums += own @ table
        yield from sums


def _classes(ids: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Class of each row, and each class's ids in order. Rows of one id are one record; records of equal texts are one class."""
    names, who = np.unique(ids, return_inverse=True)
    if len(names) < len(ids):
        first = np.full(len(names), -1, np.int64)
        first[who[::-1]] = np.arange(len(ids))[::-1]
        alone = np.bincount(who) == 1
        key = np.where(alone, same[first], 0)
        _, of = np.unique(np.stack([key, np.where(alone, -1, np.arange(len(names)))]), axis=1, return_inverse=True)
    else:
        key = np.empty(len(names), np.int64)
        key[who] = same
        _, of = np.unique(key, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    members = np.split(names[order], np.flatnonzero(np.diff(of[order])) + 1)
    return of[who], of, members


def _score(shares: list[float], config: RetrievalConfig):
    """Rows of one block of queries and one of targets, with their fields' codes, to (source1_entity_id,
    candidate_entity_id, candidate_source, cosine)."""
    meet = _meet(shares, [pieces.listed] * len(shares), config)

    def run(key, t):
        kind = t.column("kind").to_numpy()
        parts = {k: t.filter(pa.array(kind == k)) for k in (1, 2)}
        terms = [t.filter(pa.array((kind == 0) & (t.column("field").to_numpy() == f))) for f in range(len(shares))]
        return meet(key[0].as_py(), t.column("n")[0].as_py(), parts, [[np.concatenate([np.asarray(x, np.int64) for x in one.column(c).to_pylist()]) for c in ("c0", "df")] if one.num_rows else None for one in terms])

    return run


def _gathered(made: Callable):
    """made of as many batches as hold about PACKED bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= PACKED:
                yield from made(held)
                held, size = [], 0
        if held:
            yield from made(held)

    return run


def _pack(group: list[str]):
    """Rows of texts to one packed table for each block among them."""
    key = [*group, "block", "across", "n", "kind", "field"]

    def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        whose = list(zip(*[t.column(c).to_pylist() for c in key], strict=True))
        names = {k: i for i, k in enumerate(dict.fromkeys(whose))}
        code = np.array([names[k] for k in whose])
        for k, i in names.items():
            one = t.filter(pa.array(code == i)).drop_columns(key)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_table(one.combine_chunks())
            yield pa.RecordBatch.from_pydict({**{c: pa.array([v], t.schema.field(c).type) for c, v in zip(key, k, strict=True)}, "packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return _gathered(packed)


def _unpack(shares: list[float], bags: list[Callable], config: RetrievalConfig):
    """The packed tables of one block of queries and one of targets, and the group's frequencies, to what _score gives."""
    meet = _meet(shares, bags, config)

    def run(key, t):
        tables: dict = {}
        for kind, field, packed in zip(*[t.column(c).to_pylist() for c in ("kind", "field", "packed")], strict=True):
            tables.setdefault((kind, field), []).append(pa.ipc.open_stream(packed).read_all())
        n, t = t.column("n")[0].as_py(), None
        tables = {k: pa.concat_tables(v) for k, v in tables.items()}
        terms = [tables.get((0, f)) for f in range(len(shares))]
        return meet(key[0].as_py(), n, {k: tables.pop((k, -1), None) for k in (1, 2)}, [one and [one.column(c).to_numpy() for c in ("code", "df")] for one in terms])

    return run


def _count(group: list[str], bags: list[Callable], asked: bool, repeats: bool):
    """Rows of records to how many have each gram; with repeats, to a row for each id and gram."""

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        whose = list(zip(*[t.column(c).to_pylist() for c in group], strict=True))
        names = {k: i for i, k in enumerate(dict.fromkeys(whose))}
        code = np.array([names[k] for k in whose])
        for k, i in names.items():
            one = t.filter(pa.array(code == i))
            for f, bag in enumerate(bags):
                texts = pa.concat_arrays(one.column(f"c{f}").chunks)
                # of queries only which grams there are: all in one row
                codes, row, at, _ = bag(texts, (np.zeros if asked else np.arange)(one.num_rows, dtype=np.int32))
                if repeats and not asked:
                    codes, ids, df = codes[at], one.column("id").take(pa.array(row)).combine_chunks(), np.ones(len(at), np.int64)
                else:
                    ids, df = pa.nulls(len(codes), pa.string()), np.zeros(len(codes), np.int64) if asked else np.bincount(at, minlength=len(codes))
                rows = {**{c: pa.array([v] * len(codes), pa.string()) for c, v in zip(group, k, strict=True)}, "field": pa.array(np.full(len(codes), f, np.int32)), "code": pa.array(codes), "id": ids, "df": pa.array(df), "asked": pa.array(np.full(len(codes), int(asked), np.int32))}
                yield from pa.table(rows).to_batches(max_chunksize=1 << 16)

    return _gathered(counted)


def _meet(shares: list[float], bags: list[Callable], config: RetrievalConfig):
    """bags: of a field's values and their rows."""
    low, out = max(config.min_similarity - 1e-8, 0.0), ("source1_entity_id", "candidate_entity_id", "candidate_source", "cosine")

    def meet(source: str, n: int, parts: dict, terms: list) -> pa.Table:
        if any(parts[k] is None or not parts[k].num_rows for k in (1, 2)):
            return pa.table({c: pa.array([], pa.float64() if c == "cosine" else pa.string()) for c in out})
        sides = {}
        for k in (1, 2):
            ids = np.array(parts[k].column("id").to_pylist(), object)
            row, of, members = _classes(ids, parts[k].column("same").to_numpy())
            # a class's vector is that of its first id, whose rows count together
            names, who = np.unique(ids, return_inverse=True)
            lead = np.zeros(len(names), bool)
            lead[np.unique(of, return_index=True)[1]] = True
            rows = np.flatnonzero(lead[who])
            rows = rows[np.argsort(row[rows], kind="stable")]
            sides[k] = rows, row[rows].astype(np.int32), members, np.bincount(of)
        known: list[tuple] = []

        def bag(k: int, f: int, some: slice) -> pieces.Bag:
            values = parts[k].column(f"c{f}").take(pa.array(sides[k][0][some]))
            return bags[f](pa.concat_arrays(values.chunks), sides[k][1][some])

        def vectors(k: int, some: slice, begin: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(row less begin, place, weight) of a side's rows, in the order of rows."""
            made, has = [], 0.0
            for f, share in enumerate(shares):
                found = bag(k, f, some)
                if k == 1:
                    known.append((*frequencies(f, found), known[-1][2] + len(known[-1][0]) if known else 0))
                codes, df, base = known[f]
                found = found[0], found[1] - np.int32(begin), *found[2:]
                has = has + share * (np.bincount(found[1], minlength=count) > 0)
                row, at, weight = _postings(found, codes, df, n, count, config.unseen or k == 1)
                del found
                if k == 2 and config.max_df:
                    fine = df[at] <= config.max_df
                    row, at, weight = row[fine], at[fine], weight[fine]
                if len(shares) > 1:
                    weight *= np.sqrt(share)
                made.append((row, at + np.int32(base), weight))
            if len(made) == 1:
                return made[0]  # in the order of rows
            row, at, weight = (np.concatenate(x) for x in zip(*made, strict=True))
            del made
            weight /= np.sqrt(has[row])
            order = pieces.stable(row)
            return row[order], at[order], weight[order]

        def frequencies(f: int, found: pieces.Bag) -> tuple[np.ndarray, np.ndarray]:
            """Codes in order and how many of the group's targets have them."""
            if not terms[f]:  # the block holds all targets of its group
                return found[0], np.bincount(found[2], sides[1][3][found[1]], len(found[0])).astype(np.int64)
            codes, df = terms[f]
            terms[f] = True
            alone = np.setdiff1d(found[0], codes)
            codes, df = np.concatenate([codes, alone]), np.concatenate([df, np.ones(len(alone), np.int64)])
            order = np.argsort(codes)
            return codes[order], df[order]

        count, names = len(sides[1][2]), sides[1][2]
        tr, ta, tw = vectors(1, slice(None), 0, count)
        parts[1], base = None, sum(len(codes) for codes, _, _ in known)
        by_row = np.searchsorted(tr, np.arange(count + 1)), ta, tw, np.zeros(base)
        order = pieces.stable(ta)
        first, rows, wt = np.append(0, np.cumsum(np.bincount(ta, minlength=base))), tr[order], tw[order]
        del order, tr
        size = np.diff(first)
        common = np.flatnonzero(size > count // COMMON) if count <= CELLS else np.zeros(0, np.int64)
        column = np.full(base, -1, np.int32)
        column[common] = np.arange(len(common))
        left, right, cosine = [], [], []
        for start in range(0, len(sides[2][2]), ASKED):
            asked = sides[2][2][start : start + ASKED]
            some = slice(*np.searchsorted(sides[2][1], [start, start + len(asked)]))
            qr, qa, qw = vectors(2, some, start, len(asked))
            edge = np.searchsorted(qr, np.arange(len(asked) + 1))
            sums = _sums(qr, qa, qw, edge, first, rows, wt, common, column, count)
            for c, (queries, acc) in enumerate(zip(asked, sums, strict=True)):
                a, b = edge[c], edge[c + 1]
                if a == b:
                    continue
                rare = column[qa[a:b]] < 0
                hits, score = _nearest(acc, qa[a:b][rare], qw[a:b][rare], first, rows, wt, by_row, low, config.top_k)
                if not len(hits):
                    continue
                ids = np.concatenate([names[h][: config.top_k] for h in hits])
                each = np.repeat(score, [min(len(names[h]), config.top_k) for h in hits])
                if len(ids) > config.top_k:
                    keep = each >= np.partition(each, len(each) - config.top_k)[len(each) - config.top_k] - 1e-8
                    ids, each = ids[keep], each[keep]
                left.append(np.repeat(queries, len(ids)))
                right.append(np.tile(ids, len(queries)))
                cosine.append(np.tile(each, len(queries)))
        flat = [np.concatenate(x) if x else np.zeros(0, object) for x in (left, right)]
        return pa.table({
            out[0]: pa.array(flat[0], pa.string()), out[1]: pa.array(flat[1], pa.string()), out[2]: pa.array([source] * len(flat[0]), pa.string()),
            out[3]: pa.array(np.concatenate(cosine) if cosine else np.zeros(0), pa.float64()),
        })

    return meet


def _cosine(queries: DataFrame, targets: DataFrame, group: list[str], of, config: RetrievalConfig) -> DataFrame:
    """The cosines of at least the top_k targets of each query and source that reach min_similarity.

    Texts are dealt out to pairs of blocks, one of a group's queries and one of its targets, and become grams there, as
    64-bit hashes; no pair of records and no gram of one record is a row. Where a group has several blocks of targets,
    its frequencies are counted first and go to each of them."""
    spark = targets.sparkSession
    queries = stored(queries.select("source1_entity_id", *[g for g in group if g != "candidate_source"], "name", "address").where(" and ".join(["true", *[f"{g} is not null" for g in group if g != "candidate_source"]])), "queries")
    targets = stored(targets.select("candidate_entity_id", *group, "name", "address").where(" and ".join(f"{g} is not null" for g in group)), "targets")
    fields = _parts(config.address_weight, of)
    sizes = stored(_sizes(queries, targets, group, fields), "sizes")
    total = sizes.agg(F.sum(F.col("nt") * F.col("nq")).alias("cells"), F.max("nt").alias("nt")).first()
    if not total.cells:
        return spark.createDataFrame([], "source1_entity_id string, candidate_entity_id string, candidate_source string, cosine double")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    same = F.xxhash64("name", *["address"] * (len(fields) > 1)).alias("same")
    columns = [f.column.alias(f"c{k}") for k, f in enumerate(fields)]
    asking = queries.join(F.broadcast(sizes), group[1:]) if len(group) > 1 else queries.crossJoin(F.broadcast(sizes))
    holding = targets.join(F.broadcast(sizes), group)
    flag = lambda kind, field=-1: [F.lit(kind).alias("kind"), F.lit(field).alias("field")]
    place = [block("candidate_entity_id", "nt").alias("block"), F.col("nq").alias("across"), "n", *flag(1)]
    sides = [(holding.select(*group, *place, F.col("candidate_entity_id").cast("string").alias("id"), same, *columns), ["block", "across"])]
    place = [block("source1_entity_id", "nq").alias("block"), F.col("nt").alias("across"), "n", *flag(2)]
    sides.append((asking.select(*group, *place, F.col("source1_entity_id").cast("string").alias("id"), same, *columns), ["across", "block"]))
    schema = ", ".join([*[f"{g} string" for g in group], "block long, across long, n long, kind int, field int, packed binary"])
    cell, rows = [*group, "qb", "tb"], None
    for df, (tb, qb) in sides:
        one = df.mapInArrow(_pack(group), schema).withColumn("other", spread("across"))
        at = {"block": "block", "across": "other"}
        one = one.select(*group, F.col(at[qb]).alias("qb"), F.col(at[tb]).alias("tb"), "n", "kind", "field", "packed")
        rows = one if rows is None else rows.unionByName(one)
    if total.nt > 1:
        repeats = bool(sizes.where("nt > 1 and repeats").limit(1).count())
        counted = ", ".join([*[f"{g} string" for g in group], "field int, code long, id string, df long, asked int"])
        each = [f.bag for f in fields]
        has = holding.where("nt > 1").select(*group, F.col("candidate_entity_id").cast("string").alias("id"), *columns).mapInArrow(_count(group, each, False, repeats), counted)
        asks = asking.where("nt > 1").select(*group, F.col("source1_entity_id").cast("string").alias("id"), *columns).mapInArrow(_count(group, each, True, repeats), counted)
        df = F.count_distinct("id") if repeats else F.sum("df")
        # a gram of one target that no query has counts once wherever it is met
        found = has.unionByName(asks).groupBy(*group, "field", "code").agg(df.alias("df"), F.max("asked").alias("asked")).where("df > 1 or df = 1 and asked = 1")
        found = found.join(F.broadcast(sizes), group).select(*group, F.lit(0).cast("long").alias("block"), "nq", "nt", "n", "field", "code", "df")
        # packed where its counts are, for all cells
        found = found.select(*group, "block", F.col("nq").alias("across"), "n", F.lit(0).alias("kind"), "field", "code", "df").sortWithinPartitions("field", "code").mapInArrow(_pack(group), schema)
        found = found.join(F.broadcast(sizes.drop("n")), group).withColumn("qb", spread("nq")).withColumn("tb", spread("nt"))
        rows = rows.unionByName(found.select(*group, "qb", "tb", "n", "kind", "field", "packed"))
    dealt = rows.repartition(int(min(2 * total.cells + 1, 20_000)), *cell)
    return dealt.groupBy(*cell).applyInArrow(_unpack([f.share for f in fields], [f.bag for f in fields], config), "source1_entity_id string, candidate_entity_id string, candidate_source string, cosine double")


def top_k(queries: DataFrame, targets: DataFrame, config: RetrievalConfig = RetrievalConfig(), by_country: bool = True, grams=None) -> DataFrame:
    """The top_k targets of each query and source with a similarity of min_similarity or more: PAIR, char_name_score,
    rounded to nine places. grams: a function of a text column; by default all n-grams of the name."""
    group = ["candidate_source", *["country"] * by_country]
    of = grams or functools.partial(tx.grams, low=config.low, high=config.high)
    score = _cosine(queries, targets, group, of, config)
    rounded = score.withColumn("char_name_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine"))), 9)).drop("cosine")
    order = Window.partitionBy("source1_entity_id", "candidate_source").orderBy(F.desc("char_name_score"), "candidate_entity_id")
    kept = rounded.where(F.col("char_name_score") >= config.min_similarity).withColumn("rank", F.row_number().over(order))
    return kept.where(F.col("rank") <= config.top_k).drop("rank")
