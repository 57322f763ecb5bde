"""Narratives of pieces in words, their cards, and answers to questions about them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .library import clock
from .summaries import new_labels

SENTENCES, LEAST_SENTENCES, LEAST_WORDS = 6, 3, 30
LOUDEST = 0.3

#: What a section of each type does, and how it does it by its arc. Every second section is told the other way round.
VERBS = {
    "intro": "the piece comes into being", "rising": "it climbs", "climax": "everything meets", "plateau": "it keeps its level",
    "falling": "it sinks", "release": "it lets go", "outro": "it takes its leave",
}
MANNERS = {"building": "with growing force", "releasing": "with fading force", "peak": "at full strength", "valley": "softly", "plateau": "evenly"}
ORDERS = ("From {clock} {verb} {manner}, {mood} in mood, its layers {layers}.", "In a {mood} mood, its layers {layers}, {verb} {manner} at {clock}.")
FILLER = "Nothing else breaks its line."


def _pick(table: dict[str, str], c: Column, rest: str) -> Column:
    out = F.lit(table[rest])
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def prose(secs: DataFrame, key: str = "filename") -> DataFrame:
    """(key, narrative) from sections with start, arc, section_type, and optionally mood and tags (an array).

    Every section gives a sentence, and one more where it brings tags that the section before lacks. No section is
    told once six sentences stand; short narratives are filled up to three sentences and, under 30 words, summed up.
    """
    have = secs.columns
    s = secs.withColumns({
        "_mood": F.coalesce(F.col("mood") if "mood" in have else F.lit(None).cast("string"), F.lit("neutral")),
        "_tags": F.coalesce(F.col("tags") if "tags" in have else F.lit(None).cast("array<string>"), F.array().cast("array<string>")),
    })
    s = new_labels(s, "_tags", key, "section").withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1)
    kind = F.when(F.col("section_type").isin(*VERBS), F.col("section_type")).otherwise("plateau")
    said = F.when(F.col("_i") % 2 == 0, ORDERS[0]).otherwise(ORDERS[1])
    fill = {
        "clock": clock(F.col("start")), "verb": _pick(VERBS, kind, "plateau"), "manner": _pick(MANNERS, F.col("arc"), "plateau"), "mood": F.translate("_mood", "_", " "),
        "layers": F.when(F.col("arc").isin("building", "peak"), "thickening").otherwise("spread thin"),
    }
    for name, value in fill.items():
        said = F.replace(said, F.lit("{" + name + "}"), value)
    fresh = F.slice(F.array_sort("new_labels"), 1, 2)
    more = F.when((F.col("_i") > 0) & (F.size("new_labels") > 0), F.array(said, F.concat(F.lit("New here: "), F.translate(F.array_join(fresh, " and "), "_", " "), F.lit(".")))).otherwise(F.array(said))
    told = s.select(key, "_i", "_mood", more.alias("_said"))
    g = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_said"))).alias("_all"), F.count("*").alias("_n"))
    capped = F.aggregate("_all", F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) >= SENTENCES, acc).otherwise(F.concat(acc, x["_said"])))
    filled = F.when(F.size("_s") < LEAST_SENTENCES, F.concat(F.col("_s"), F.array_repeat(F.lit(FILLER), LEAST_SENTENCES - F.size("_s")))).otherwise(F.col("_s"))
    text = F.array_join("_f", " ")
    short = F.size(F.split(F.col("_text"), r"\s+")) < LEAST_WORDS
    summary = F.concat(F.lit(" In all, "), stem(F.col(key)), F.lit(" passes through "), F.col("_n").cast("string"), F.lit(" sections from its first sound to its last, each leading to the next without a break."))
    out = g.withColumn("_s", capped).withColumn("_f", filled).withColumn("_text", text)
    return out.select(key, F.when(short, F.concat("_text", summary)).otherwise(F.col("_text")).alias("narrative"))


def narratives(secs: DataFrame, structure: DataFrame, texture: DataFrame, alike: DataFrame, key: str = "filename") -> DataFrame:
    """One row a piece: duration, prose, ordered sections, both fingerprints and the most similar pieces."""
    own = [c for c in secs.columns if c not in (key, "section")]
    g = secs.groupBy(key).agg(F.max("end").alias("duration"), F.array_sort(F.collect_list(F.struct("section", *own))).alias("sections"))
    near = alike.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("similar_to"))
    return g.join(prose(secs, key), key).join(structure, key, "left").join(texture, key, "left").join(near, key, "left")


def climax(secs: DataFrame, key: str = "filename") -> DataFrame:
    """The first section of each piece, in time, that is typed climax; pieces without one have no row."""
    own = [c for c in secs.columns if c != key]
    first = F.min_by(F.struct(*own), F.struct("start", "section"))
    return secs.where("section_type = 'climax'").groupBy(key).agg(first.alias("x")).select(key, "x.*")


def at_time(secs: DataFrame, seconds: float) -> DataFrame:
    """The sections that hold a moment."""
    return secs.where((F.col("start") <= seconds) & (F.col("end") > seconds))


# The words that send a question to a branch, in the order in which branches are tried.
WORDS = {
    "time": ("happening at", "at ", "around "),
    "arc": ("arc", "narrative", "story", "describe"),
    "climax": ("climax", "peak", "highest", "most intense"),
    "similar": ("similar", "like this", "sounds like"),
}


def route(question: str) -> tuple[str, float | None]:
    """The branch of a question and the seconds that it names.

    The first branch with a word in the question is taken. A question of the time branch without a time gets
    everything, also where a later branch would have fitted ("what " ends in "at ").
    """
    q = question.lower()
    branch = next((b for b, words in WORDS.items() if any(w in q for w in words)), "everything")
    if branch != "time":
        return branch, None
    found = re.search(r"(\d+):(\d+)", q)
    return ("time", 60.0 * int(found[1]) + int(found[2])) if found else ("everything", None)


def ask(told: DataFrame, filename: str, question: str, key: str = "filename") -> DataFrame:
    """The answer of a narratives table to a question about one piece; what it returns depends on the branch."""
    branch, seconds = route(question)
    one = told.where(F.col(key) == filename)
    secs = one.select(key, F.explode("sections").alias("x")).select(key, "x.*")
    match branch:
        case "time":
            return at_time(secs, seconds)
        case "arc":
            return one.select(key, "narrative")
        case "climax":
            return climax(secs, key)
        case "similar":
            return one.select(key, F.posexplode_outer("similar_to").alias("rank", "other"))
    return one


def sparkline(df: DataFrame, x: str, y: str, key: str = "filename") -> DataFrame:
    """(key, x, y) scaled to 0..1 within each piece; a constant becomes 0."""
    w = Window.partitionBy(key)
    scaled = lambda c: F.when(F.max(c).over(w) == F.min(c).over(w), 0.0).otherwise((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w)))
    return df.select(key, scaled(x).alias("x"), scaled(y).alias("y"))


def cards(df: DataFrame, label: str, energy: str = "energy", key: str = "filename", k: int = 5) -> DataFrame:
    """(key, labels, tension): the k most frequent labels of each piece (of equal ones the smaller name), and its mean
    energy as a share of the loudest; 0.2 without any energy."""
    n = df.groupBy(key, label).agg(F.count("*").alias("_n"), F.sum(energy).alias("_e"), F.count(energy).alias("_ne"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col(label).isNotNull(), F.struct((-F.col("_n")).alias("_n"), F.col(label).alias("_l"))))), 1, k), lambda x: x["_l"])
    mean = F.try_divide(F.sum("_e"), F.sum("_ne"))
    return n.groupBy(key).agg(top.alias("labels"), F.when(mean.isNull(), 0.2).otherwise(F.least(F.lit(1.0), mean / LOUDEST)).alias("tension"))
