"""Command line: python -m cadentia info | estimate DIR | metadata DIR | analyze DIR OUT [--sequence] [--clusters K] | phases DIR | clusters DIR | narrative DIR FILE QUESTION."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import rules
from .operators import collection, narrative, tools
from .plans import recordings
from .sources import audio, sinks


def info() -> dict:
    """What this library reads and knows."""
    return {"decoded": [".wav", ".aif", ".aiff"], "listed": [".mp3"], "moods": len(rules.moods()), "tags": len(rules.tags())}


def analyze(spark: SparkSession, path: str, out: str, sequence: bool = False, n_clusters: int | None = None) -> dict[str, int]:
    """All tables of a folder under out: CSV of features, phases, clusters, moods, tags, edges and rejected files, narratives as JSON and
    Markdown, one JSON document, a report, and a manifest. Returns the rows of each table."""
    files = audio.scan(spark, path)
    began = time.time()
    t = recordings.tables(files, sequence, n_clusters)
    tracks = t["tracks"]
    told = {
        "features": sinks.feature_order(t["features"]), "rejected": t["rejected"], "phases": collection.phase_table(t["phases"]), "clusters": collection.cluster_table(t["profiles"]),
        "moods": tracks.select("filename", "moods", "primary_mood", "mood_confidence"), "tags": tracks.select("filename", "tags", "primary_character", "character_confidence"),
        "summary": collection.long(collection.summary(tracks, t["phases"])),
    }
    if sequence:
        told["sequence"] = collection.sequence_table(t["sequence"], "playlist")
    counts = {}
    for name, df in told.items():
        sinks.write_csv(df, f"{out}/data/{name}")
        counts[name] = spark.read.csv(f"{out}/data/{name}", header=True).count()
    sinks.write_edges(t["edges"], f"{out}/data/similarity")
    sinks.write_narratives(t["narratives"], f"{out}/narratives")
    counts["narratives"] = t["narratives"].count()
    write = lambda df, at: df.coalesce(1).write.mode("overwrite").text(f"{out}/{at}")
    write(sinks.document({"tracks": tracks, "phases": tools.phase_answer(t["phases"]), "clusters": tools.cluster_answer(t["profiles"])}), "reports/json")
    write(spark.createDataFrame([(sinks.report("Library", recordings.summaries_of(t)),)], "value string"), "reports/markdown")
    write(spark.createDataFrame([(sinks.manifest(counts, export_directory=out, export_timestamp=datetime.datetime.now().isoformat(), files_analyzed=counts["features"], seconds=round(time.time() - began, 1)),)], "value string"), "manifest")
    return counts


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cadentia", description="Analytics for libraries of recordings")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("info", help="what is read and known")
    known = {
        "estimate": "how long a folder will take", "metadata": "formats and durations of a folder", "analyze": "all tables of a folder", "moods": "moods and tags of a folder",
        "phases": "phases of a folder", "clusters": "clusters of a folder", "sequence": "an order to listen to a folder in", "narrative": "an answer about one piece of a folder",
    }
    for name, text in known.items():
        commands.add_parser(name, help=text).add_argument("path")
    commands.choices["analyze"].add_argument("out")
    commands.choices["analyze"].add_argument("--sequence", action="store_true", help="order the tracks as well")
    for name in ("analyze", "clusters"):
        commands.choices[name].add_argument("--clusters", type=int, default=None, help="how many clusters; chosen by the data if not given")
    commands.choices["narrative"].add_argument("file")
    commands.choices["narrative"].add_argument("question")
    args = p.parse_args(argv)
    if args.command == "info":
        print(json.dumps(info()))
        return 0
    spark = SparkSession.builder.appName("cadentia").getOrCreate()
    if args.command == "analyze":
        print(json.dumps(analyze(spark, args.path, args.out, args.sequence, args.clusters)))
        return 0
    files = audio.scan(spark, args.path)
    match args.command:
        case "estimate":
            rows = audio.estimate(files)
        case "metadata":
            rows = audio.metadata(files).orderBy("filename")
        case other:
            t = recordings.tables(files, sequence=other == "sequence", n_clusters=getattr(args, "clusters", None))
            match other:
                case "moods":
                    rows = tools.mood_answer(t["tracks"])
                case "phases":
                    rows = tools.phase_answer(t["phases"])
                case "clusters":
                    rows = tools.cluster_answer(t["profiles"])
                case "sequence":
                    rows = tools.sequence_answer(t["sequence"], "playlist").orderBy("position")
                case _:
                    rows = narrative.ask(t["narratives"], args.file, args.question)
    for line in rows.select(F.to_json(F.struct(*rows.columns))).toLocalIterator():
        print(line[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
