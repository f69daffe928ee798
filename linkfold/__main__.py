"""python -m linkfold COMMAND ...: the verbs on files, over Spark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkfold import api
from linkfold.functions import kernels
from linkfold.operators import objects
from linkfold.sources.links import lines_of, read_links


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkfold")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, *arguments in (("encode", "url"), ("decode", "code"), ("check", "url"), ("verify", "file"), ("train", "links", "profiles"), ("ingest", "links", "store"), ("report", "links", "out"), ("export", "links", "file"), ("open", "file"), ("stat", "store"), ("serve", "port")):
        command = sub.add_parser(name)
        for a in arguments:
            command.add_argument(a)
    args = parser.parse_args(argv)
    if args.command == "encode":
        print(kernels.encode(args.url))
        return 0
    if args.command == "decode":
        url, error = kernels.try_resolve(args.code)
        print(url if error is None else error, file=sys.stdout if error is None else sys.stderr)
        return int(error is not None)
    if args.command == "check":
        print(api.probe(args.url))
        return 0
    if args.command in ("verify", "open"):
        with open(args.file, "rb") as f:
            data = f.read()
        if args.command == "verify":
            ok = objects.verify(data)
            print("valid" if ok else "invalid")
            return int(not ok)
        for _, code in objects.open_container(data)[2]:
            print(kernels.resolve(code.decode()))
        return 0
    if args.command == "serve":
        from linkfold.server import serve

        serve(int(args.port))
        return 0
    spark = SparkSession.builder.appName("linkfold").getOrCreate()
    if args.command == "train":
        profile = api.train(lines_of(spark, args.links).select(F.lit(0).alias("seq"), F.col("line").alias("url")))
        api.save(spark, profile, args.profiles)
        print(profile.id)
    elif args.command == "ingest":
        out = api.shorten(read_links(spark, args.links))
        out.write.mode("append").parquet(args.store)
        print(spark.read.parquet(args.store).count())
    elif args.command == "report":
        rows = api.encode(read_links(spark, args.links))
        rows = rows.select("seq", "url", "code", F.octet_length("url").alias("raw_len"), F.length("code").alias("code_len"))
        rows.withColumn("saved_pct", F.round(100 - 100 * F.col("code_len") / F.col("raw_len"), 1)).write.mode("overwrite").csv(args.out, header=True)
    elif args.command == "export":
        codes = [r["code"].encode() for r in api.encode(read_links(spark, args.links)).select("code").toLocalIterator()]
        with open(args.file, "wb") as f:
            f.write(objects.container(bytes(32), codes))
    elif args.command == "stat":
        spark.read.parquet(args.store).agg(F.count("*").alias("links"), F.sum(F.col("stored").cast("int")).alias("keys")).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
