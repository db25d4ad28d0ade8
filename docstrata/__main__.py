"""``python -m docstrata FOLDER [--num_topics N] [--load True|False] [--extract True|False]``: train and report, or report
only; with ``--extract True`` files are fetched and read first."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from docstrata.config import Settings
from docstrata.plans.api import Collection, TopicModel


def true_or_false(s: str) -> bool:
    """``True`` and ``False`` only."""
    if s not in ("True", "False"):
        raise argparse.ArgumentTypeError(f"not True or False: {s}")
    return s == "True"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="docstrata")
    parser.add_argument("folder")
    parser.add_argument("--output", default="./output")
    parser.add_argument("--num_topics", type=int, default=Settings.num_topics)
    parser.add_argument("--load", type=true_or_false, default=False)
    parser.add_argument("--extract", type=true_or_false, default=False)
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    # workers end with their task of few documents, since recognisers leak memory
    reuse = "false" if args.extract else "true"
    spark = SparkSession.builder.appName("docstrata").config("spark.python.worker.reuse", reuse).getOrCreate()
    collection = Collection(spark, args.folder)
    if args.extract:
        collection.download()
        collection.extract_all()
        collection.embed()
    rows = collection.load_documents().load_embeddings()
    model = TopicModel(rows, args.output, Settings(num_topics=args.num_topics))
    (model.load() if args.load else model.run()).store_results()


if __name__ == "__main__":
    main()
