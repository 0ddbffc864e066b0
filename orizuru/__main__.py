"""python -m orizuru VERB [NAME] --data FOLDER: the engine's queries from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from orizuru.operators import export, model, staff, works
from orizuru.plans.snapshot import Snapshot, fit
from orizuru.session import build_session
from orizuru.sources import adapters


def _detail(s: Snapshot, name: str) -> None:
    """A work by its id, or the first that a search by title finds."""
    found = s.works.where(F.col("work_id") == name)
    if not found.take(1):
        hit = works.search(s.works, name, 1).first()
        found = s.works.where(F.col("work_id") == (hit.work_id if hit else ""))
    found.show(truncate=False)
    mine = s.matrix.join(found.select("work_id"), "work_id", "left_semi")
    model.labelled(model.shown_factors(model.attribute(mine, s.model))).orderBy("place").show(truncate=False)


def main() -> None:
    parser = argparse.ArgumentParser("orizuru")
    parser.add_argument("verb", choices=("train", "compare", "leaderboard", "staff", "search", "work", "export"))
    parser.add_argument("name", nargs="?", default="")
    parser.add_argument("--data", required=True, help="folder of Parquet tables")
    parser.add_argument("--out", default="export", help="folder of the exported documents")
    parser.add_argument("--limit", type=int, default=20)
    args = parser.parse_args()
    spark = build_session()
    credits = adapters.credits(spark, args.data)
    s = fit(adapters.ratings(spark, args.data), adapters.works(spark, args.data), credits)
    if args.verb == "train":
        model.metrics(model.predict(s.matrix, s.model)).show()
    elif args.verb == "compare":
        listed = s.works.join(model.predict(s.matrix, s.model).select("work_id", "predicted_z"), "work_id", "left")
        works.comparison(listed, s.biases["items"], s.stats, s.biases["mean"], s.overall).show(args.limit, truncate=False)
    elif args.verb == "leaderboard":
        staff.leaderboard(s.records, args.name, limit=args.limit).orderBy("rank").show(args.limit, truncate=False)
    elif args.verb == "staff":
        staff.profile(s.records, args.name).show(truncate=False, vertical=True)
    elif args.verb == "search":
        works.search(s.works, args.name, 15).show(truncate=False)
        staff.search(s.records, args.name).show(truncate=False)
    elif args.verb == "work":
        _detail(s, args.name)
    else:
        export.write_all(s.records, s.works, credits, args.out)


if __name__ == "__main__":
    main()
