"""Command line: build a store, plan routes over it, compare walks with and without walls.

    python -m cartolith build EXTRACT STORE
    python -m cartolith plan STORE LAT LON LAT LON [WEIGHT ...]
    python -m cartolith compare EXTRACT [--pairs N] [--seed S] [--box SOUTH WEST NORTH EAST]
"""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cartolith", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("build")
    one.add_argument("extract")
    one.add_argument("store")
    one = sub.add_parser("plan")
    one.add_argument("store")
    one.add_argument("points", type=float, nargs=4, metavar="DEGREES")
    one.add_argument("weights", type=float, nargs="*", default=[0.0, 1.0, 2.0, 4.0, 8.0])
    one = sub.add_parser("compare")
    one.add_argument("extract")
    one.add_argument("--pairs", type=int)
    one.add_argument("--seed", type=int)
    one.add_argument("--box", type=float, nargs=4)
    return top


def run(spark, args: argparse.Namespace):
    """The rows that the command shows."""
    from pyspark.sql import functions as F

    from .operators import exposure, network, occluders
    from .plans import build, compare
    from .sources import pbf, store

    if args.command == "build":
        parts = build.build(*pbf.load(spark, args.extract))
        store.write(parts, args.store, store.fingerprint(spark, args.extract))
        return build.Router.open_store(spark, args.store).counts()
    if args.command == "plan":
        asked = spark.createDataFrame([(i, *args.points, w) for i, w in enumerate(args.weights)], "req_id bigint, start_lat double, start_lon double, end_lat double, end_lon double, weight double")
        found = build.Router.open_store(spark, args.store).plan(asked)
        return found.join(asked.select("req_id", "weight"), "req_id").orderBy("req_id").select("weight", "status", F.round("length_m", 1).alias("length_m"), F.round(100 * F.col("mean_exposure"), 1).alias("percent"), F.size("path").alias("nodes"))
    osm_nodes, osm_ways, osm_relations = pbf.load(spark, args.extract)
    cameras = network.cameras(osm_nodes)
    nodes, edges, _ = network.network(osm_nodes, osm_ways)
    rings = occluders.near_cameras(occluders.rings(occluders.ring_ways(osm_ways, osm_relations), osm_nodes), cameras)
    chosen = {k: v for k, v in (("n", args.pairs), ("seed", args.seed), ("box", args.box and tuple(args.box))) if v is not None}
    return compare.wall_effect(compare.trips(spark, **chosen), nodes, exposure.score(edges, cameras), exposure.score(edges, cameras, rings))


def main() -> None:
    args = parser().parse_args()
    from pyspark.sql import SparkSession

    run(SparkSession.builder.appName("cartolith").getOrCreate(), args).show(100, truncate=False)


if __name__ == "__main__":
    main()
