"""The commands end to end on a small dataset."""

import json

from weftlink.cli import COMMANDS, main

COUNTRIES = ("India", "France")


def _dataset(root):
    rows = {s: [] for s in ("source1", "source2", "source3")}
    truth = []
    for k in range(24):
        name, address, country = f"Company{k:02d} trade{k % 7} works", f"{k} Street{k % 5} Town", COUNTRIES[k % 2]
        rows["source1"].append((f"S1-{k}", name, address, country))
        rows["source2"].append((f"S2-{k}", name.upper() + " Ltd", address, country))
        if k % 3 == 0:
            rows["source3"].append((f"S3-{k}", name, "", country))
        truth.append((f"S1-{k}", "" if k % 8 == 7 else f"S2-{k}" + (f",S3-{k}" if k % 3 == 0 else "")))
    for part in ("training", "test"):
        (root / part).mkdir(parents=True)
        for s, r in rows.items():
            (root / part / f"{s}.tsv").write_text("\n".join("\t".join(x) for x in [("entity_id", "business_name", "business_address", "country"), *r]) + "\n")
    (root / "training/ground_truth.tsv").write_text("\n".join("\t".join(x) for x in [("source1_entity_id", "matched_entity_ids"), *truth]) + "\n")


def test_all_commands(spark, tmp_path):
    assert len(COMMANDS) == 20
    _dataset(tmp_path / "data")
    t = f"file://{tmp_path}"
    done = []

    def run(name, *args, code=0):
        report = tmp_path / f"{len(done)}-{name}.json"
        positional = [a for a in COMMANDS[name][1] if len(a) == 1]
        args = list(args)
        args.insert(len(positional) - 1, str(report))
        assert main([name, *args]) == code, report.read_text()
        done.append(name)
        return json.loads(report.read_text())

    assert run("audit", f"{t}/data")["status"] == "PASS"
    run("make-folds", f"{t}/data", f"{t}/folds", "--folds", "3")
    run("make-splits", f"{t}/data", f"{t}/splits")
    run("make-experiment-splits", f"{t}/splits/train", f"{t}/experiment")
    run("make-scale-evaluation-splits", f"{t}/experiment", f"{t}/scale")
    split = f"{t}/splits/train"
    got = run("build-candidates", split, f"{t}/rule", "--partitioned")
    assert got["summary"][0]["pair_recall"] == 1
    run("build-sparse-name-candidates", split, f"{t}/sparse", "--top-k", "5")
    run("merge-candidates", split, f"{t}/merged", "--input", f"{t}/rule", f"{t}/sparse")
    run("prepare-test", f"{t}/data", f"{t}/test")
    run("build-mining-pool", f"{t}/merged", f"{t}/pool", "--per-source", "2")
    run("build-training-sample", split, f"{t}/merged", f"{t}/sample", "--hard", "3")
    run("train-matcher", f"{t}/sample", f"{t}/models", "--family", "logistic", "--folds", "2")
    run("score-candidates", split, f"{t}/merged", f"{t}/models", f"{t}/scores", "--out-of-fold", "--folds", "2")
    best = run("tune-threshold", split, f"{t}/scores", f"{t}/curve")["best"][0]
    assert best["macro_f0_5"] > 0.6
    at = str(best["threshold"])
    run("evaluate-matcher", split, f"{t}/scores", "--threshold", at)
    run("tune-source-thresholds", split, f"{t}/scores", "--threshold", at, "--radius", "0.02", "--rounds", "1")
    run("evaluate-source-thresholds", split, f"{t}/scores", "--source2", at, "--source3", at)
    run("analyze-errors", split, f"{t}/scores", f"{t}/merged", f"{t}/errors", "--source2", at, "--source3", at)
    run("build-candidates", f"{t}/test", f"{t}/test-rule")
    run("score-candidates", f"{t}/test", f"{t}/test-rule", f"{t}/models", f"{t}/test-scores")
    assert run("write-submission", f"{t}/test", f"{t}/test-scores", f"{t}/test-rule", f"{t}/out", "--threshold", at)["status"] == "PASS"
    assert run("preflight", f"{t}/data", f"{t}/out/matching", f"{t}/out/candidates")["status"] == "PASS"
    assert set(done) == set(COMMANDS)
