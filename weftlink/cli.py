"""Command line: each command reads tables, runs one operator, writes tables and a JSON report.

A dataset folder holds training/ and test/ TSV files; a split folder holds source1, source2, source3 and, unless it is a
test split, ground_truth as Parquet tables.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions.text import with_bare_accents
from weftlink.operators import audit, blocking, evaluate, features, learning, retrieval, sampling, splits, submission
from weftlink.schema import RECORD, TRUTH
from weftlink.session import session
from weftlink.sources import tables

SOURCES = ("source1", "source2", "source3")
Command = Callable[[SparkSession, argparse.Namespace], dict]
COMMANDS: dict[str, tuple[Command, list[tuple]]] = {}


def command(name: str, *arguments: tuple):
    def register(f: Command) -> Command:
        COMMANDS[name] = (f, list(arguments))
        return f

    return register


def _tsv(spark: SparkSession, root: str, part: str) -> dict[str, DataFrame]:
    found = {s: tables.read_tsv(spark, f"{root}/{part}/{s}.tsv", RECORD) for s in SOURCES}
    if part == "training":
        found["ground_truth"] = tables.read_tsv(spark, f"{root}/training/ground_truth.tsv", TRUTH)
    return found


class Split:
    """A split folder's tables as the operators take them."""

    def __init__(self, spark: SparkSession, path: str):
        self.read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.queries = blocking.queries_of(self.read("source1"))
        self.targets = blocking.targets_of(*((s, self.read(s)) for s in SOURCES[1:]))
        self.entities = self.queries.select("source1_entity_id")
        self.retrieval = (blocking.queries_of(self.read("source1"), with_bare_accents), blocking.targets_of(*((s, self.read(s)) for s in SOURCES[1:]), normalize=with_bare_accents))

    def truth(self) -> DataFrame:
        return splits.truth_pairs(self.read("ground_truth"))


def _all_records(found: dict[str, DataFrame]) -> DataFrame:
    out = None
    for s in SOURCES:
        one = found[s].withColumn("source", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def _rows(df: DataFrame) -> list[dict]:
    """A summary of a bounded number of rows."""
    return [r.asDict(recursive=True) for r in df.collect()]


@command("audit", ("data",), ("report",))
def _audit(spark: SparkSession, a: argparse.Namespace) -> dict:
    tables.check_dataset(spark, a.data)
    found = _tsv(spark, a.data, "training")
    records = _all_records(found)
    violations = {r["check"]: r["violations"] for r in _rows(audit.contract_violations(records.select("entity_id", "source"), found["ground_truth"]))}
    return {
        "status": "FAIL" if any(violations.values()) else "PASS", "violations": violations, "records": _rows(audit.record_audit(records)), "truth": _rows(audit.truth_audit(found["ground_truth"])),
        "matches": _rows(audit.match_histogram(found["ground_truth"])), "countries": _rows(audit.frequencies(records, "country")),
        "duplicates": _rows(audit.duplicate_groups(records, RECORD.names[1:])),
    }


@command("make-folds", ("data",), ("output",), ("report",), ("--folds", int, 5), ("--seed", int, 20260925))
def _folds(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = _tsv(spark, a.data, "training")
    records = _all_records(found)
    manifest = splits.fold_manifest(found["source1"], records.where("source <> 'source1'").select("entity_id", "source", "country"), found["ground_truth"], a.folds, a.seed).persist()
    splits.require_clean(splits.fold_problems(manifest, records.select("entity_id"), found["ground_truth"], a.folds))
    tables.write_tsv(manifest.orderBy("fold", "source", "entity_id"), a.output)
    return {"folds": _rows(manifest.groupBy("fold", "source").count())}


def _write_splits(found: dict[str, DataFrame], output: str, config: splits.SplitConfig, names: dict[str, str], force: bool) -> dict:
    targets = _all_records(found).where("source <> 'source1'").select("entity_id", "source", "country")
    entities = splits.assign_entities(found["source1"], found["ground_truth"], config).persist()
    owned = splits.assign_targets(targets, found["ground_truth"], entities, config).persist()
    splits.require_clean(splits.verification(found["source1"], targets, found["ground_truth"], entities, owned))
    for split, name in names.items():
        for s in SOURCES:
            assigned = entities if s == "source1" else owned
            tables.write_table(splits.split_part(found[s], assigned, split), f"{output}/{name}/{s}", overwrite=force)
        chosen = entities.where(F.col("split") == split).select(F.col("entity_id").alias("source1_entity_id"))
        tables.write_table(found["ground_truth"].join(chosen, "source1_entity_id", "left_semi"), f"{output}/{name}/ground_truth", overwrite=force)
    return {"splits": _rows(splits.rename_splits(entities, names).groupBy("split").agg(F.count("*").alias("entities"), F.sum("match_count").alias("matches"))), "config": config.__dict__}


@command("make-splits", ("data",), ("output",), ("report",), ("--force", bool, False))
def _splits(spark: SparkSession, a: argparse.Namespace) -> dict:
    config = splits.SplitConfig()
    return _write_splits(_tsv(spark, a.data, "training"), a.output, config, {n: n for n in ("train", "validation", "local_test")}, a.force)


@command("make-experiment-splits", ("parent",), ("output",), ("report",), ("--force", bool, False))
def _experiment(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = {s: spark.read.parquet(f"{a.parent}/{s}") for s in (*SOURCES, "ground_truth")}
    return _write_splits(found, a.output, splits.EXPERIMENT, splits.EXPERIMENT_NAMES, a.force)


@command("make-scale-evaluation-splits", ("experiment",), ("output",), ("report",), ("--force", bool, False))
def _scale(spark: SparkSession, a: argparse.Namespace) -> dict:
    names = tuple(splits.EXPERIMENT_NAMES.values())
    pools = {s: tables.read_tables(spark, *(f"{a.experiment}/{n}/{s}" for n in names), by_name=False) for s in SOURCES[1:]}
    counts = {}
    for n in names[1:]:
        for s in ("source1", "ground_truth"):
            tables.write_table(spark.read.parquet(f"{a.experiment}/{n}/{s}"), f"{a.output}/{n}/{s}", overwrite=a.force)
        for s, pool in pools.items():
            tables.write_table(pool, f"{a.output}/{n}/{s}", order=("entity_id",), overwrite=a.force)
            counts[f"{n}/{s}"] = pool.count()
    return {"targets": counts}


@command("build-candidates", ("split",), ("output",), ("report",), ("--top-k", int, 50), ("--max-df", int, 200), ("--max-keys", int, 6), ("--min-token", int, 3), ("--partitioned", bool, False), ("--force", bool, False))
def _candidates(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    found = blocking.rule_candidates(x.queries, x.targets, blocking.BlockingConfig(a.top_k, a.max_df, a.max_keys, a.min_token))
    if a.partitioned:  # one folder for each source; a rerun replaces each
        for s in SOURCES[1:]:
            tables.write_table(found.where(F.col("candidate_source") == s), f"{a.output}/part={s}", overwrite=True)
    else:
        tables.write_table(found, a.output, order=("source1_entity_id", "candidate_entity_id"), overwrite=a.force)
    return _report(spark, x, a)


def _report(spark: SparkSession, x: Split, a: argparse.Namespace) -> dict:
    made = spark.read.parquet(a.output)
    try:
        truth = x.truth()
    except Exception as e:  # a test split has no truth
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {"candidate_pairs": made.count()}
    return {"summary": _rows(blocking.report(x.queries, x.targets, made, truth)), "sources": _rows(blocking.recall_by_source(truth, made))}


@command("build-sparse-name-candidates", ("split",), ("output",), ("report",), ("--top-k", int, 100), ("--min-similarity", float, 0.10), ("--address-weight", float, 0.35), ("--force", bool, False))
def _sparse(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    config = retrieval.RetrievalConfig(top_k=a.top_k, min_similarity=a.min_similarity, address_weight=a.address_weight)
    tables.write_table(retrieval.top_k(*x.retrieval, config), a.output, overwrite=a.force)
    return _report(spark, x, a)


@command("merge-candidates", ("split",), ("output",), ("report",), ("--input", str, None, "+"), ("--force", bool, False))
def _merge(spark: SparkSession, a: argparse.Namespace) -> dict:
    if len(a.input or []) < 2:
        raise SystemExit("two inputs at least are needed")
    tables.write_table(blocking.merge_evidence(*(spark.read.parquet(p) for p in a.input)), a.output, overwrite=a.force)
    return _report(spark, Split(spark, a.split), a)


@command("prepare-test", ("data",), ("output",), ("report",), ("--force", bool, False))
def _test(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = _tsv(spark, a.data, "test")
    for s, df in found.items():
        tables.write_table(df, f"{a.output}/{s}", overwrite=a.force)
    return {s: df.count() for s, df in found.items()}


@command("build-training-sample", ("split",), ("candidates",), ("output",), ("report",), ("--hard", int, 5), ("--random", int, 1), ("--model-hard", int, 0), ("--mining", str, None), ("--force", bool, False))
def _sample(spark: SparkSession, a: argparse.Namespace) -> dict:
    x, config = Split(spark, a.split), sampling.SamplingConfig(a.hard, a.random, a.model_hard)
    mining = spark.read.parquet(a.mining) if a.mining else None
    sample = sampling.training_sample(spark.read.parquet(a.candidates), x.truth(), config, mining)
    made = features.pair_features(sample, x.queries, x.targets, keep=("label", "sample_weight", "cv_fold", "calibration_bucket"))
    tables.write_table(made, a.output, overwrite=a.force)
    return {"labels": _rows(spark.read.parquet(a.output).groupBy("label").agg(F.count("*").alias("pairs"), F.sum("sample_weight").alias("weight")))}


@command("build-mining-pool", ("candidates",), ("output",), ("report",), ("--per-source", int, 20), ("--force", bool, False))
def _pool(spark: SparkSession, a: argparse.Namespace) -> dict:
    tables.write_table(sampling.mining_pool(spark.read.parquet(a.candidates), a.per_source), a.output, overwrite=a.force)
    return {"pairs": spark.read.parquet(a.output).count()}


@command("train-matcher", ("sample",), ("models",), ("report",), ("--family", str, "boosted_trees"), ("--rounds", int, 60), ("--depth", int, 5), ("--folds", int, 3))
def _train(spark: SparkSession, a: argparse.Namespace) -> dict:
    sample, config = spark.read.parquet(a.sample).persist(), learning.MatcherConfig(a.family, a.rounds, a.depth)
    for k, m in learning.out_of_fold(sample, a.folds, config).items():
        learning.save(m, f"{a.models}/fold-{k}")
    learning.save(learning.fit_matcher(sample, config), f"{a.models}/final")
    return {"config": config.__dict__, "folds": a.folds, "rows": sample.count()}


@command("score-candidates", ("split",), ("candidates",), ("models",), ("output",), ("report",), ("--out-of-fold", bool, False), ("--folds", int, 3), ("--force", bool, False))
def _score(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    pairs = sampling.folded(features.pair_features(spark.read.parquet(a.candidates), x.queries, x.targets), sampling.SamplingConfig(folds=a.folds))
    matcher = {k: learning.load(f"{a.models}/fold-{k}") for k in range(a.folds)} if a.out_of_fold else learning.load(f"{a.models}/final")
    tables.write_table(learning.score_pairs(pairs, matcher), a.output, order=("source1_entity_id", "candidate_entity_id"), overwrite=a.force)
    return {"scores": _rows(spark.read.parquet(a.output).agg(F.count("*").alias("pairs"), F.min("score").alias("least"), F.max("score").alias("most")))}


@command("tune-threshold", ("split",), ("scores",), ("output",), ("report",), ("--steps", int, 201))
def _tune(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    curve = evaluate.threshold_curve(spark.read.parquet(a.scores), x.truth(), x.entities, a.steps).persist()
    tables.write_tsv(curve.orderBy("threshold_index"), a.output)
    return {"best": _rows(evaluate.best_threshold(curve))}


@command("evaluate-matcher", ("split",), ("scores",), ("report",), ("--threshold", float, 0.5))
def _evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    return {"metrics": _rows(evaluate.evaluate(spark.read.parquet(a.scores), x.truth(), x.entities, a.threshold))}


@command("tune-source-thresholds", ("split",), ("scores",), ("report",), ("--threshold", float, 0.5), ("--radius", float, 0.08), ("--step", float, 0.01), ("--rounds", int, 2), ("--minimum-gain", float, 1e-4))
def _tune_sources(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    return evaluate.tune_source_thresholds(spark.read.parquet(a.scores), x.truth(), x.entities, a.threshold, a.radius, a.step, a.rounds, a.minimum_gain)


_BY_SOURCE = (("--source2", float, 0.5), ("--source3", float, 0.5))


def _thresholds(a: argparse.Namespace) -> dict[str, float]:
    return {"source2": a.source2, "source3": a.source3}


@command("evaluate-source-thresholds", ("split",), ("scores",), ("report",), *_BY_SOURCE)
def _evaluate_sources(spark: SparkSession, a: argparse.Namespace) -> dict:
    x = Split(spark, a.split)
    return {"thresholds": _thresholds(a), "metrics": _rows(evaluate.evaluate(spark.read.parquet(a.scores), x.truth(), x.entities, _thresholds(a)))}


@command("analyze-errors", ("split",), ("scores",), ("candidates",), ("output",), ("report",), *_BY_SOURCE)
def _errors(spark: SparkSession, a: argparse.Namespace) -> dict:
    x, scores, found = Split(spark, a.split), spark.read.parquet(a.scores), spark.read.parquet(a.candidates)
    errors = evaluate.pair_errors(scores, found, x.truth(), _thresholds(a))
    tables.write_table(errors.orderBy(F.desc_nulls_last("score"), "source1_entity_id", "candidate_entity_id"), f"{a.output}/errors", overwrite=True)
    each = evaluate.per_entity(scores, x.truth(), x.entities, _thresholds(a)).join(x.queries.select("source1_entity_id", "country"), "source1_entity_id")
    each = each.join(found.groupBy("source1_entity_id").agg(F.count("*").alias("n")), "source1_entity_id", "left").persist()
    by = {"country": F.col("country"), "cardinality": evaluate.cardinality(F.col("true_count")), "candidates": evaluate.candidate_bin(F.coalesce("n", F.lit(0)))}
    out = {name: evaluate.slices(each, c) for name, c in by.items()}
    for name, df in out.items():
        tables.write_tsv(df.orderBy("slice"), f"{a.output}/{name}")
    return {"errors": _rows(evaluate.error_counts(spark.read.parquet(f"{a.output}/errors"), x.queries))}


@command("write-submission", ("split",), ("scores",), ("candidates",), ("output",), ("report",), ("--threshold", float, None), *_BY_SOURCE)
def _submission(spark: SparkSession, a: argparse.Namespace) -> dict:
    x, found = Split(spark, a.split), spark.read.parquet(a.candidates)
    matched = submission.matches(x.entities, spark.read.parquet(a.scores), a.threshold if a.threshold is not None else _thresholds(a)).persist()
    offered = submission.candidate_lists(x.entities, found).persist()
    checked = submission.checks(matched, offered, x.entities, x.targets).persist()
    tables.write_tsv(matched.orderBy("source1_entity_id"), f"{a.output}/matching")
    tables.write_tsv(offered.orderBy("source1_entity_id"), f"{a.output}/candidates")
    submission.require_valid(checked)
    return {"status": "PASS", "checks": _rows(checked)}


@command("preflight", ("data",), ("matching",), ("candidates",), ("report",))
def _preflight(spark: SparkSession, a: argparse.Namespace) -> dict:
    from weftlink.schema import CANDIDATES, MATCHES

    found = _tsv(spark, a.data, "test")
    entities = found["source1"].select(F.col("entity_id").alias("source1_entity_id"))
    targets = blocking.targets_of(*((s, found[s]) for s in SOURCES[1:]))
    checked = submission.checks(tables.read_tsv(spark, a.matching, MATCHES), tables.read_tsv(spark, a.candidates, CANDIDATES), entities, targets)
    bad = [r for r in _rows(checked) if r["violations"]]
    fatal = [r for r in bad if r["check"] not in submission.WARNINGS]
    return {"status": "FAIL" if fatal else "PASS", "problems": bad}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftlink")
    out.add_argument("--master")
    sub = out.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        one = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for arg, *rest in arguments:
            if not rest:
                one.add_argument(arg)
            elif rest[0] is bool:
                one.add_argument(arg, action="store_true")
            else:
                one.add_argument(arg, type=rest[0], default=rest[1], nargs=rest[2] if len(rest) > 2 else None)
    return out


def main(argv: list[str] | None = None) -> int:
    """Runs a command, writes its report, and returns 1 if the report says FAIL."""
    a = parser().parse_args(argv)
    report = COMMANDS[a.command][0](SparkSession.getActiveSession() or session(a.master), a)
    tables.write_report(report, Path(a.report))
    return int(report.get("status") == "FAIL")


if __name__ == "__main__":
    raise SystemExit(main())
