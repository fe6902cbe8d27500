"""Command line: build a graph, train a scorer, sweep thresholds, inspect.

    spark-submit ... -m twinedge sweep --raw DIR --graph DIR --model DIR
    python -m twinedge train --raw DIR --graph DIR --model DIR [--run NAME]
    python -m twinedge sweep --raw DIR --graph DIR --weights DIR
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import SparkSession

from twinedge.operators.embed import load_weights
from twinedge.operators.graph import graph_summary
from twinedge.plans import train
from twinedge.plans.entities import EntityGraph, trained_scorer, weights_scorer
from twinedge.session import configure
from twinedge.sources.runs import stored_runs


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="twinedge", description=__doc__)
    parser.add_argument("task", choices=["build", "train", "evaluate", "sweep", "inspect"])
    parser.add_argument("--raw", required=True, help="folder of the ten raw datasets")
    parser.add_argument("--graph", required=True, help="folder of the stored graph")
    parser.add_argument("--model", help="folder of the training runs")
    parser.add_argument("--run", help="name of a run: train goes on with it, the others use it (else the newest)")
    parser.add_argument("--weights", help="sweep or inspect with these stored weights of the forward function instead")
    parser.add_argument("--force-reload", action="store_true")
    parser.add_argument("--tolerance", type=int, default=0, help="unusable lines and edges that a build may set aside")
    parser.add_argument("--width", type=int, default=16, help="principal components per node")
    parser.add_argument("--hidden", type=int, default=100)
    parser.add_argument("--rounds", type=int, default=800)
    args = parser.parse_args(argv)

    spark = configure(SparkSession.builder.appName("twinedge").getOrCreate())
    entities = EntityGraph.open(spark, args.raw, args.graph, args.force_reload, args.tolerance)
    if args.task == "build":
        graph_summary(entities.edges()).show(truncate=False)
        entities.drops().show(truncate=False)
        return
    if args.weights and args.task in ("sweep", "inspect"):
        scorer = weights_scorer(load_weights(spark, args.weights))
    elif not args.model:
        parser.error("--model is needed")
    elif args.task == "train":
        run_id = args.run or datetime.now().strftime("%Y-%m-%d_%H-%M-%S")
        found = entities.train(args.model, run_id, args.width, hidden=args.hidden, rounds=args.rounds)
        found.metrics(spark).orderBy("epoch", "split", "metric").show(1000, truncate=False)
        print(found.model_path)
        return
    else:
        runs = [args.run] if args.run else stored_runs(spark, args.model)
        if not runs:
            parser.error(f"no trained scorer in {args.model}; run the task train first")
        trained = train.stored_scorer(spark, args.model, runs[-1])
        if args.task == "evaluate":
            entities.evaluate(trained).show(truncate=False)
            return
        scorer = trained_scorer(trained)
    if args.task == "sweep":
        entities.evaluate_thresholds(scorer).orderBy("threshold").show(100, truncate=False)
    else:
        entities.inspect(scorer).show(100, truncate=False)


if __name__ == "__main__":
    main()
