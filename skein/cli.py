"""Command line: python -m skein.cli preprocess | train | datasets | custom | summary.

A session comes from the environment (spark-submit's settings hold); paths are Hadoop paths.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from skein.operators import logs, partition, train
from skein.sources import datasets, sinks

METHODS = ["fedavg", "qfedavg", "krum", "trimmed_mean", "median"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    commands = p.add_subparsers(dest="command", required=True)

    def shared(c: argparse.ArgumentParser) -> None:
        c.add_argument("--clients", type=int, default=5)
        c.add_argument("--overlap", type=float, default=0.1, help="share of nodes that a second client has")
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--communities", default="labels", choices=list(partition.COMMUNITIES))

    c = commands.add_parser("preprocess", help="the page network's files, or a generated graph, to clients")
    c.add_argument("--data-dir", default="data")
    c.add_argument("--synthetic", action="store_true")
    shared(c)

    c = commands.add_parser("train", help="rounds of federated training, or the ablation")
    c.add_argument("--data-dir", default="data")
    c.add_argument("--out", default="experiments")
    c.add_argument("--rounds", type=int, default=20)
    c.add_argument("--model", default="gcn", choices=["gcn", "gat"])
    c.add_argument("--hidden", type=int, default=64)
    c.add_argument("--lr", type=float, default=0.01)
    c.add_argument("--local-epochs", type=int, default=5)
    c.add_argument("--agg", default="fedavg", choices=METHODS)
    c.add_argument("--eps-min", type=float, default=0.5)
    c.add_argument("--eps-max", type=float, default=2.0)
    c.add_argument("--no-secure-sa", action="store_true", help="send no sketches of edges")
    c.add_argument("--no-secure-na", action="store_true", help="send no noisy embeddings")
    c.add_argument("--synthetic", action="store_true", help="make clients of a generated graph first")
    c.add_argument("--ablation", action="store_true")
    c.add_argument("--resume", action="store_true", help="go on after the last round that the output folder has")
    shared(c)

    c = commands.add_parser("datasets", help="the catalogue, or one of its networks to clients")
    c.add_argument("--list", action="store_true")
    c.add_argument("--dataset", help="key of the catalogue")
    c.add_argument("--all", action="store_true", help="every network of the catalogue whose files are there")
    c.add_argument("--data-dir", default="data", help="files are read from raw/<key> below it")
    shared(c)

    c = commands.add_parser("custom", help="a graph of one's own to clients")
    c.add_argument("--name", help="folder below the data folder")
    c.add_argument("--data-dir", default="data")
    c.add_argument("--edges")
    c.add_argument("--features")
    c.add_argument("--labels")
    c.add_argument("--label-col")
    c.add_argument("--adj", help="adjacency matrix")
    c.add_argument("--graphml", help="GraphML, GML or GEXF file")
    c.add_argument("--label-attr")
    c.add_argument("--feat-attrs", nargs="+")
    c.add_argument("--show-formats", action="store_true")
    shared(c)

    c = commands.add_parser("summary", help="best round, worst client, traffic and privacy of a run")
    c.add_argument("--out", default="experiments")
    return p


def store(data: partition.GraphData, args: argparse.Namespace, path: str, **more: object) -> None:
    """Clients and summary to ``path``, their counts to the console."""
    clients = partition.partition_federated(data, args.clients, args.overlap, str(args.seed), args.communities)
    partition.save(data, clients, args.clients, path, **more)
    partition.client_stats(partition.load(data.nodes.sparkSession, path)).orderBy("cid").show(args.clients)


def preprocess(spark: SparkSession, args: argparse.Namespace) -> None:
    data = None if args.synthetic else datasets.page_graph(spark, args.data_dir)
    store(data or datasets.synthetic_graph(spark, seed=args.seed), args, args.data_dir)


def config(args: argparse.Namespace) -> train.Config:
    return train.Config(
        model=args.model, hidden=args.hidden, rounds=args.rounds, local_epochs=args.local_epochs, rate=args.lr, method=args.agg,
        eps_least=args.eps_min, eps_most=args.eps_max, sketch=not args.no_secure_sa, noise=not args.no_secure_na, seed=args.seed,
    )


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Trains on the clients below the data folder; makes them first where there are none."""
    if args.synthetic or not datasets.exists(spark, f"{args.data_dir}/nodes"):
        preprocess(spark, args)
    clients, out = partition.load(spark, args.data_dir), sinks.RunStore(spark, args.out)
    if args.ablation:
        cfg = config(argparse.Namespace(**{**vars(args), "rounds": min(args.rounds, 5)}))
        train.ablation(clients.nodes, clients.edges, cfg, out).show(truncate=False)
    else:
        found = train.federated_run(clients.nodes, clients.edges, config(args), out, resume=args.resume)
        logs.run_summary(found.log).show()


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.list or not (args.dataset or args.all):
        datasets.catalogue(spark).select("key", "nodes", "edges", "classes", "size", "task").show(truncate=False)
        return 0
    keys = [row[0] for row in datasets.CATALOGUE] if args.all else [args.dataset]
    for key in keys:
        folder = f"{args.data_dir}/raw/{key}"
        if args.all and not datasets.exists(spark, folder):
            print(f"{key}: no files in {folder}")
            continue
        store(datasets.catalogue_graph(spark, key, folder), args, f"{args.data_dir}/{key}", dataset=key, overlap=args.overlap)
    return 0


def custom(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.show_formats:
        print(datasets.FORMATS)
        return 0
    if not args.name or not (args.graphml or args.adj or args.edges and args.features and args.labels):
        print("needs --name and one of: --graphml; --adj; --edges, --features and --labels\n\n" + datasets.FORMATS)
        return 1
    if args.graphml:
        data = datasets.format_c(spark, args.graphml, args.label_attr, args.feat_attrs, args.communities)
    elif args.adj:
        data = datasets.format_b(spark, args.adj, args.features, args.labels, args.label_col, args.communities)
    else:
        data = datasets.format_a(spark, args.edges, args.features, args.labels, args.label_col)
    store(data, args, f"{args.data_dir}/{args.name}", dataset=args.name, overlap=args.overlap)
    return 0


def summary(spark: SparkSession, args: argparse.Namespace) -> None:
    logs.run_summary(sinks.RunStore(spark, args.out).read_log()).show()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    return {"preprocess": preprocess, "train": run, "datasets": ingest, "custom": custom, "summary": summary}[args.command](spark, args) or 0


if __name__ == "__main__":
    sys.exit(main())
