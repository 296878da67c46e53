"""Command line: python -m spanloom.cli COMMAND ...; exit 1 where an input is missing or wrong."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from spanloom.config import Config, load, override
from spanloom.operators import audit, metrics, rules, text
from spanloom.plans import predict
from spanloom.schema import AROUSAL_FLAGS, POSTURES, affect_dim, label_dim
from spanloom.session import build_session
from spanloom.storage import saved, scratch
from spanloom.sources import annotations as src
from spanloom.sources import dialogues, media


def config_of(args) -> Config:
    config = load(args.config) if args.config else Config()
    if args.preset:
        config.model.preset = args.preset
        config.with_preset()
    for pair in args.set:
        override(config, *pair.split("=", 1))
    return config


def load_label_map(path: str | None) -> dict[str, str] | None:
    if not path:
        return None
    with open(path) as f:
        return {k.lower().replace(" ", "_").replace("-", "_"): v for k, v in json.load(f).items()}


def run_prepare(spark, args, config) -> int:
    rows = src.IMPORTERS[args.format](spark, args.source, load_label_map(args.label_map), keep_unmapped=args.keep_unmapped)
    found = src.annotations_of(rows)
    src.import_report(found).show()
    src.unmapped_counts(rows).orderBy(F.desc("n")).show(50, False)
    if not found.limit(1).count():
        return 1
    predict.prepare(found, args.out, {"train": args.train_fraction, "val": 1 - args.train_fraction}, args.seed).groupBy("split").count().show()
    return 0


def run_audit(spark, args, config) -> int:
    rows = src.read_annotations(spark, args.annotations).withColumn("id", F.monotonically_increasing_id()).withColumn("group", src.group_key(F.col("group"), F.col("video")))
    found = audit.audit_annotations(rows, spark.read.parquet(args.media), label_dim(spark, config.behaviours), config.audit.clip_seconds, config.audit.min_examples)
    found = saved(found, "findings")
    usable = audit.checked(rows, spark.read.parquet(args.media)).where("reason IS NULL")
    print(audit.render(found, audit.totals(usable)))
    return int(args.strict and found.where("level = 'error'").limit(1).count() > 0)


def run_predict(spark, args, config) -> int:
    scores = spark.read.parquet(args.scores)
    limits = spark.read.parquet(args.thresholds) if args.thresholds else None
    spans = predict.predict_spans(scores, limits, config.inference, config.task == "multiclass")
    videos = scores.groupBy("video").agg(F.max("t1").alias("duration"))
    predict.write_reports(predict.reports(spans, videos, len(config.behaviours)), args.out)
    for r in spark.read.json(args.out).limit(args.show).collect():
        print(r.video, predict.timeline(r["spans"] or [], r.duration), sep="\n")
    return 0


def run_eval(spark, args, config) -> int:
    rows = spark.read.parquet(args.scores)
    per, total = metrics.evaluate_multilabel(rows) if config.task == "multilabel" else metrics.evaluate_multiclass(rows)
    print(metrics.table(per))
    total.show()
    return 0


def run_enrich(spark, args, config) -> int:
    out = rules.enrich(src.read_annotations(spark, args.annotations), spark.read.parquet(args.audio), "video", "barking", ["bark", "bark_alarm", "bark_excited"], args.min_count, args.min_confidence)
    src.write_annotations(out, args.out)
    out.groupBy("status").count().show()
    return 0


def run_feeling(spark, args, config) -> int:
    scores = spark.read.parquet(args.scores)
    spans = predict.predict_spans(scores, None, config.inference, config.task == "multiclass").drop("peak")
    videos = scores.groupBy("video").agg(F.max("t1").alias("duration"))
    rules.read_affect(spans, affect_dim(spark), videos, ["video"], len(config.behaviours)).orderBy("video").show(args.show, False)
    return 0


def run_synth(spark, args, config) -> int:
    rows = media.synthetic_sessions(spark, args.sessions, seed=args.seed)
    found = src.shaped(rows, **{c: F.col(c) for c in ("video", "labels", "start", "end", "group")}).drop("unmapped")
    predict.prepare(found, args.out, seed=args.seed).groupBy("split").count().show()
    return 0


def run_captions(spark, args, config) -> int:
    corpus = text.generate_captions(src.read_annotations(spark, args.annotations), spark.read.parquet(args.audio) if args.audio else None)
    dialogues.write_corpus(corpus, args.out)
    text.corpus_stats(dialogues.read_corpus(spark, args.out), "caption").show()
    return 0


def run_info(spark, args, config) -> int:
    print(config.to_json())
    return 0


def run_behaviours(spark, args, config) -> int:
    for name in config.behaviours:
        print(name, "posture" if name in POSTURES else "action", "*" * (name in AROUSAL_FLAGS))
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spanloom")
    out.add_argument("--config")
    out.add_argument("--preset")
    out.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    out.add_argument("--master")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *names: str, **options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for n in names:
            sub.add_argument(n)
        for n, default in options.items():
            kind = {"action": "store_true"} if default is False else {"default": default, "type": type(default) if default is not None else str}
            sub.add_argument("--" + n.replace("_", "-"), **kind)

    command("prepare", run_prepare, "format", "source", "out", label_map=None, keep_unmapped=False, train_fraction=0.8, seed=0)
    command("audit", run_audit, "annotations", "media", strict=False)
    command("predict", run_predict, "scores", "out", thresholds=None, show=3)
    command("eval", run_eval, "scores")
    command("enrich", run_enrich, "annotations", "audio", "out", min_count=1, min_confidence=0.0)
    command("feeling", run_feeling, "scores", show=20)
    command("synth", run_synth, "out", sessions=100, seed=0)
    command("make-captions", run_captions, "annotations", "out", audio=None)
    command("info", run_info)
    command("behaviours", run_behaviours)
    return out


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        config = config_of(args)
        if args.command in ("info", "behaviours"):
            return args.run(None, args, config)
        session = spark or build_session(master=args.master)
        with scratch(session):
            return args.run(session, args, config)
    except (FileNotFoundError, ValueError, KeyError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
