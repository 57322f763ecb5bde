"""Exports: CSV with rounding by column name, nested JSON, similarity edges and a Markdown report."""

from __future__ import annotations

import datetime
import json
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.library import clock
from ..operators.narrative import stem


def decimals(name: str) -> int:
    """Decimals of a column, by the first part of its name that is known."""
    return next((d for part, d in (("mfcc", 4), ("spectral", 2), ("tempo", 1), ("duration", 2), ("energy", 4)) if part in name.lower()), 3)


def exported(df: DataFrame) -> DataFrame:
    """df as it is exported: numbers rounded half to even, NaN and infinities null, lists joined, missing names Unknown."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.bround(c, decimals(f.name)))
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c.isNull() | F.lower(F.trim(c)).isin("nan", "none", "null", ""), "Unknown").otherwise(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ")
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema])


# The order of the feature table's first and last columns; all others stand between in their own order.
FIRST = ("filename", "duration", "spectral_centroid_mean", "spectral_centroid_std", "spectral_rolloff_mean", "spectral_bandwidth_mean", "zero_crossing_rate_mean", "rms_mean", "rms_std", "tempo", "onset_density", "key", "key_confidence")
LAST = (
    "energy_range", "brightness_range", "avg_phase_duration", "phase_duration_std", "has_climax", "has_breakdown", "has_build_up", "structural_complexity", "energy_progression", "brightness_progression",
    "mood_descriptors", "primary_mood", "mood_confidence", "character_tags", "primary_character", "character_confidence", "num_phases", "phase_analysis_available",
)


def feature_order(df: DataFrame) -> DataFrame:
    """df with its columns in the order of the exported feature table; numbered features in the order of their numbers."""
    given = [c for c in df.columns if c not in FIRST and c not in LAST]
    number = lambda c: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", c)]
    kinds = ("mfcc", "chroma", "tonnetz")
    place = lambda c: (next((i for i, k in enumerate(kinds) if c.startswith(k)), len(kinds)), number(c) if c.startswith(("mfcc", "tonnetz")) else [given.index(c)])
    return df.select(*[c for c in FIRST if c in df.columns], *sorted(given, key=place), *[c for c in LAST if c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    exported(df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, key: str | None = None) -> None:
    """One object per row, nulls kept; with key one folder per value."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(key) if key else writer).json(path)


def flatten_phases(df: DataFrame) -> DataFrame:
    """One row per phase of df(filename, total_duration, phases: array of structs)."""
    return df.select("filename", "total_duration", F.explode("phases").alias("p")).select("filename", "total_duration", "p.*")


def _rows(df: DataFrame, limit: int) -> list[str]:
    return ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in exported(df).limit(limit).collect()]


def markdown(title: str, sections: dict[str, DataFrame], limit: int = 50) -> str:
    """A report of small tables; each shows its first rows up to limit."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *_rows(df, limit)]
    return "\n".join(out) + "\n"


#: Sections of the report in their order, and the table that each shows.
REPORT = {
    "Summary": "summary", "Collection": "distributions", "Sequence": "sequence", "Tracks": "tracks", "Phases": "phases", "Clusters": "clusters",
    "Insights": "insights", "Narratives": "narratives", "Features": "features", "Data quality": "quality",
}


def report(title: str, tables: dict[str, DataFrame], limit: int = 50) -> str:
    """The whole report: a section for every table that there is."""
    return markdown(title, {name: tables[t] for name, t in REPORT.items() if t in tables}, limit)


def narrative_documents(told: DataFrame) -> DataFrame:
    """(name, json, markdown): both documents of every narrative of told(filename, duration, narrative, sections, similar_to, ...)."""
    c = F.col
    # the export's own limits: three tags in a cell, two decimals
    row = lambda x: F.concat(
        F.lit("| "), clock(x["start"]), F.lit(" | "), clock(x["end"]), F.lit(" | "), x["section_type"], F.lit(" | "), F.format_string("%.2f", x["m"]), F.lit(" | "),
        F.coalesce(x["mood"], F.lit("neutral")) if "mood" in told.schema["sections"].dataType.elementType.names else F.lit("neutral"), F.lit(" | "),
        F.coalesce(F.array_join(F.slice(x["tags"], 1, 3), ", "), F.lit("")) if "tags" in told.schema["sections"].dataType.elementType.names else F.lit(""), F.lit(" |"),
    )
    body = F.concat_ws(
        "\n", F.concat(F.lit("# "), c("filename")), F.lit(""), F.lit("## Narrative"), F.lit(""), c("narrative"), F.lit(""), F.lit("## Sections"), F.lit(""),
        F.lit("| Start | End | Type | Tension | Mood | Instruments |"), F.lit("|---|---|---|---|---|---|"), F.transform("sections", row),
        F.when(F.size("similar_to") > 0, F.concat_ws("\n", F.lit("\n## Similar Pieces\n"), F.transform("similar_to", lambda x: F.concat(F.lit("- "), x)))),
    )
    return told.select(stem(c("filename")).alias("name"), F.to_json(F.struct(*told.columns), {"ignoreNullFields": "false"}).alias("json"), body.alias("markdown"))


def write_narratives(told: DataFrame, path: str) -> None:
    """A folder for every piece with its JSON and its Markdown, and one table of similar pieces with their ranks."""
    documents = narrative_documents(told).persist()
    for kind in ("json", "markdown"):
        documents.select("name", F.col(kind).alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").text(f"{path}/{kind}")
    documents.unpersist()


def write_edges(edges: DataFrame, path: str) -> None:
    """(filename_a, filename_b, score, rank) as CSV with a header."""
    edges.select("filename_a", "filename_b", F.round("score", 6).alias("score"), "rank").write.mode("overwrite").csv(path, header=True)


def document(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (value): all tables as one JSON document, each an array of its rows. Meant for reports: every array is one value."""
    one = None
    for name, df in tables.items():
        own = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
        one = own if one is None else one.crossJoin(own)  # one row each
    return one.select(F.to_json(F.struct(*tables), {"ignoreNullFields": "false"}).alias("value"))


def read_json(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


NARRATIVE = (
    "filename string, duration double, narrative string, sections array<struct<section int, start double, end double, points long, m double, slope double, arc string, section_type string, mood string, tags array<string>, character string,"
    " direction string, rate string, motion_type string>>, structure array<double>, texture array<double>, similar_to array<string>"
)


def read_narratives(spark, path: str) -> DataFrame:
    """The narratives that `write_narratives` wrote under path."""
    return spark.read.schema(NARRATIVE).json(f"{path}/json").select(*[c.split()[0] for c in ("filename", "duration", "narrative", "sections", "structure", "texture", "similar_to")])


def rescore(spark, path: str, schema: str) -> DataFrame:
    """Tracks of a JSON export with their character tags scored anew; old_tags is what the export says, changed whether it differs.

    The export is one document or lines of {"tracks": [...]}; schema is that of a track.
    """
    from ..operators.labels import character_scores

    doc = spark.read.schema(f"tracks array<struct<{schema}>>").option("multiLine", True).json(path)
    tracks = doc.select(F.explode("tracks").alias("t")).select("t.*")
    names = {"spectral_centroid_mean": "centroid", "spectral_bandwidth_mean": "bandwidth", "spectral_rolloff_mean": "rolloff", "zero_crossing_rate_mean": "zcr", "spectral_flatness_mean": "flatness", "spectral_flux_mean": "flux", "stereo_width": "stereo"}
    spread = [F.col(f"mfcc_{i}_std") for i in range(1, 6) if f"mfcc_{i}_std" in tracks.columns]
    rows = tracks.select(F.struct(*tracks.columns).alias("_t"), *[F.col(a).alias(b) for a, b in names.items() if a in tracks.columns], *([(sum(spread[1:], spread[0]) / len(spread)).alias("timbre_variance")] if spread else []))
    missing = [c for c in ("centroid", "bandwidth", "rolloff", "zcr") if c not in rows.columns]
    scored = character_scores(rows.withColumns({c: F.lit(0.0) for c in missing}), key="_t")
    new = F.array_join("tags", ", ")
    old = F.coalesce(F.col("_t.character_tags"), F.lit("")) if "character_tags" in tracks.columns else F.lit("")
    kept = [F.col(f"_t.{c}").alias(c) for c in tracks.columns if c not in ("character_tags", "primary_character")]
    return scored.select(*kept, old.alias("old_tags"), new.alias("character_tags"), "primary_character", (old != new).alias("changed"))


def export_path(base: str, prefix: str = "library", now: datetime.datetime | None = None) -> str:
    """A folder of its own for an export: its name ends in the time, so that the latest export has the greatest name."""
    return f"{base.rstrip('/')}/{prefix}_{(now or datetime.datetime.now()):%Y%m%d_%H%M%S}"


def drop_empty(spark, base: str, prefix: str = "library", hours: float = 24, now: float | None = None) -> int:
    """Delete the export folders of a prefix that hold no file and are older than that; how many went."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(base)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    limit, gone = 1000 * ((now or time.time()) - hours * 3600), 0
    for f in fs.listStatus(at) if fs.exists(at) else []:
        if f.isDirectory() and f.getPath().getName().startswith(f"{prefix}_") and f.getModificationTime() < limit and fs.getContentSummary(f.getPath()).getFileCount() == 0:
            fs.delete(f.getPath(), True)
            gone += 1
    return gone


def manifest(counts: dict[str, int], **more) -> str:
    """What an export holds: rows of its tables, and when and where it was made."""
    return json.dumps({"tables": counts, **more}, sort_keys=True, default=str)
