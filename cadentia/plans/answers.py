"""Registered queries of views, checks, collections, flows and tool answers, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.aggregates import mean_spectrum
from ..operators import checks, clusters, collection, flow, labels, library, phases, sections, tools, views
from ..sources import sinks
from .catalog import (
    _BEST, _NUM, CHANGE, CLASSED, PARTS, PHASES, PLAYLIST, FALLBACK, POINTS, SCORED, SECS, TEX, TRACKS, _r, _t, best_tags, parts, phase_rows, playlist, points, query, tracks, typed,
)
from .shared import settle

# ---- buckets, names, clocks -------------------------------------------------------------------------

_ROLE = "CASE phase_type WHEN 'Intro/Ambient' THEN 'Opening/Atmospheric' WHEN 'Introduction' THEN 'Opening' WHEN 'Build-up/Energetic' THEN 'Development/Tension' WHEN 'Rhythmic/Percussive' THEN 'Rhythmic Foundation' WHEN 'Bright/Melodic' THEN 'Melodic Focus' WHEN 'Climax/Peak' THEN 'Climactic/Peak Energy' WHEN 'Development' THEN 'Musical Development' WHEN 'Breakdown/Quiet' THEN 'Tension Release' WHEN 'Conclusion' THEN 'Closing' WHEN 'Outro/Fade' THEN 'Closing/Fade' ELSE 'Developmental' END"


@query(f"WITH {CLASSED} SELECT filename, phase_number, {_ROLE} AS role FROM classed")
def structural_role(spark, sf):
    return phases.classify(phase_rows(spark, sf)).select("filename", "phase_number", views.role(F.col("phase_type")).alias("role"))


@query(f"WITH {PHASES}, g AS (SELECT filename, count(*) AS n, sum(duration) AS d FROM phase_rows GROUP BY filename) SELECT filename, CASE WHEN n / (d / 60) < 0.5 THEN 'Simple' WHEN n / (d / 60) < 1 THEN 'Moderate' ELSE 'Complex' END AS complexity FROM g")
def structural_complexity(spark, sf):
    g = phase_rows(spark, sf).groupBy("filename").agg(F.count("*").alias("n"), F.sum("duration").alias("d"))
    return g.select("filename", views.complexity(F.col("n"), F.col("d")).alias("complexity"))


@query("SELECT o_orderkey, CASE WHEN p < 0.25 THEN 'Opening Quarter' WHEN p < 0.5 THEN 'First Half' WHEN p < 0.75 THEN 'Second Half' ELSE 'Closing Quarter' END AS place FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::DOUBLE / count(*) OVER (PARTITION BY o_custkey) AS p FROM orders)")
def position_in_arc(spark, sf):
    w = Window.partitionBy("o_custkey")
    return _t(spark, sf, "orders").select("o_orderkey", views.arc_position(F.row_number().over(w.orderBy("o_orderkey")), F.count("*").over(w)).alias("place"))


@query(f"WITH {POINTS} SELECT filename, rn, CASE WHEN zcr * 2 - chroma_spread < 0 THEN '#4FD1C5' WHEN zcr * 2 - chroma_spread < 0.15 THEN '#607D8B' WHEN zcr * 2 - chroma_spread < 0.6 THEN '#4FD1C5' WHEN zcr * 2 - chroma_spread < 1.01 THEN '#F4C471' ELSE '#4FD1C5' END AS colour FROM points")
def tension_colour(spark, sf):
    return points(spark, sf).select("filename", "rn", views.tension_colour(F.col("zcr") * 2 - F.col("chroma_spread")).alias("colour"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  trim(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ' - ' || p_name END, '^[0-9]+[\\s\\-_.]+', '')) AS name FROM part""")
def track_names(spark, sf):
    p = _t(spark, sf, "part")
    given = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Artist___"), "p_name", F.lit(".wav"))).otherwise(F.concat(F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" - "), "p_name", F.lit(".wav")))
    return p.select("p_partkey", views.slug(F.concat("p_brand", F.lit(" / "), "p_type", F.lit(".aiff"))).alias("slug"), views.track_name(given).alias("name"))


@query(f"WITH n(name) AS (VALUES {', '.join(f"('{r['name']}')" for r in rules.moods())}) SELECT name, array_to_string(list_transform(string_split(name, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM n")
def title_case(spark, sf):
    return rules.as_table(spark, rules.moods()).select("name", views.title(F.col("name")).alias("title"))


@query("SELECT o_orderkey, printf('%02d:%02d', CAST(floor(o_totalprice / 60) AS BIGINT), CAST(floor(o_totalprice) AS BIGINT) % 60) AS clock, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, round(epoch_us(o_orderdate) / 1e6 - 694224000, 3) AS seconds FROM orders")
def clocks_and_stamps(spark, sf):
    o = _t(spark, sf, "orders")
    since = F.lit("1992-01-01 00:00:00").cast(o.schema["o_orderdate"].dataType)
    return o.select("o_orderkey", views.clock2(F.col("o_totalprice")).alias("clock"), views.stamp(F.col("o_orderdate")).alias("stamp"), _r(views.seconds_between(since, F.col("o_orderdate")), 3).alias("seconds"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE greatest(0, least(1, (p_retailprice - 1000) / (p_size % 5 * 300))) END, 6) AS score FROM part")
def minmax_score(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", _r(views.score(F.col("p_retailprice"), F.lit(1000.0), 1000.0 + F.col("p_size") % 5 * 300.0)).alias("score"))


# ---- counts and distributions -----------------------------------------------------------------------


@query(f"WITH {PARTS} SELECT mood, n, first, row_number() OVER (ORDER BY n DESC, first) AS place FROM (SELECT mood, count(*) AS n, min(p_partkey) AS first FROM parts GROUP BY mood)")
def value_counts_first_seen(spark, sf):
    return views.value_counts(parts(spark, sf), "mood", "p_partkey").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {PARTS}, c AS (SELECT cluster, mood, count(*) AS n, min(p_partkey) AS f FROM parts GROUP BY ALL) SELECT cluster, mood, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS r FROM c) WHERE r = 1")
def dominant_first_seen(spark, sf):
    return views.dominant(parts(spark, sf), "cluster", "mood", "p_partkey")


def _categories(rows):
    return tuple(dict.fromkeys(r["category"] for r in rows))


def _ratio_sql(rows, best, name):
    shares = ", ".join(f"round(count(*) FILTER (WHERE category = '{c}') / count(*)::DOUBLE, 6) AS {c}_ratio" for c in _categories(rows))
    names = ", ".join(f"('{r['name']}', '{r['category']}')" for r in rows)
    return f"WITH {best}, v(name, category) AS (VALUES {names}) SELECT count(*) AS total, count(DISTINCT {name}) AS \"unique\", {shares}, round(count(DISTINCT {name}) / {len(rows)}::DOUBLE, 6) AS diversity FROM best JOIN v ON v.name = {name}"


def _rounded(df):
    return df.withColumns({c: _r(c) for c, t in df.dtypes if t == "double"})


@query(_ratio_sql(rules.moods(), f"{SCORED}, best AS (SELECT filename, arg_max(name, s * 1000 - ord * 1e-6::DOUBLE) AS mood FROM scored GROUP BY filename)", "mood"))
def mood_distribution_summary(spark, sf):
    m = labels.mood_scores(tracks(spark, sf)).select(F.col("primary_mood").alias("mood"))
    return _rounded(views.label_summary(m, "mood", rules.moods(), _categories(rules.moods())))


@query(_ratio_sql(rules.tags(), _BEST, "tag"))
def character_distribution_summary(spark, sf):
    return _rounded(views.label_summary(best_tags(spark, sf), "tag", rules.tags(), _categories(rules.tags())))


@query(f"""WITH {TRACKS}, v AS (SELECT feature, var_samp(x) AS variance FROM (SELECT unnest([{", ".join(f"'{c}'" for c in _NUM)}]) AS feature, unnest([{", ".join(_NUM)}]) AS x FROM tracks) GROUP BY feature), r AS (SELECT *, row_number() OVER (ORDER BY variance DESC, feature) AS p, count(*) OVER () AS n FROM v)
SELECT feature, round(variance, 4) AS variance, 'high' AS side, p AS place FROM r WHERE p <= 4 UNION ALL SELECT feature, round(variance, 4), 'low', p - (n - 2) FROM r WHERE p > n - 2""")
def variance_ranks(spark, sf):
    v = views.variance_ranks(tracks(spark, sf), _NUM, 4, 2)
    return v.withColumns({"variance": _r("variance", 4), "place": F.col("place").cast("long")})


@query(f"WITH {PLAYLIST} SELECT filename, CAST(coalesce(CASE WHEN s.s_suppkey % 3 > 0 THEN s.s_suppkey END, 9999) AS BIGINT) AS place FROM playlist LEFT JOIN supplier s ON filename = 't' || s.s_suppkey")
def order_by_sequence(spark, sf):
    s = _t(spark, sf, "supplier").where("s_suppkey % 3 > 0").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("filename"), F.col("s_suppkey").alias("position"))
    return views.in_sequence(playlist(spark, sf), s).select("filename", F.col("place").cast("long").alias("place"))


@query("""WITH f AS (SELECT regexp_extract(path, '[^/]*$') AS name, min(path) AS path FROM (SELECT '/lib/' || (p_size % 3) || '/' || p_brand || '.wav' AS path FROM part) GROUP BY 1), b AS (SELECT DISTINCT p_brand || '.wav' AS filename FROM part WHERE p_size < 40) SELECT filename, path FROM b JOIN f ON name = filename""")
def features_with_paths(spark, sf):
    p = _t(spark, sf, "part")
    files = p.select(F.concat(F.lit("/lib/"), (F.col("p_size") % 3).cast("string"), F.lit("/"), "p_brand", F.lit(".wav")).alias("path"))
    return views.with_paths(p.where("p_size < 40").select(F.concat("p_brand", F.lit(".wav")).alias("filename")).distinct(), files).select("filename", "path")


@query("SELECT max('out/run_' || strftime(o_orderdate, '%Y%m%d_%H%M%S')) AS path FROM orders")
def latest_export(spark, sf):
    return views.latest(_t(spark, sf, "orders").select(F.concat(F.lit("out/run_"), views.stamp(F.col("o_orderdate"))).alias("path")))


@query(f"""WITH {TRACKS} SELECT filename, CASE WHEN bandwidth < 1000 AND zcr < 0.1 THEN 'analog_synth' WHEN brightness > 2000 AND bandwidth < 800 THEN 'digital_synth' WHEN bandwidth > 1800 AND zcr > 0.1 THEN 'acoustic_instrument' WHEN bandwidth > 2000 THEN 'rich_texture'
  WHEN bandwidth < 600 THEN 'pure_tone' WHEN rolloff > 4000 THEN 'bright_harmonics' WHEN rolloff < 2000 THEN 'warm_harmonics' ELSE 'unknown' END AS character FROM tracks""")
def character_fallback(spark, sf):
    c = F.col
    return tracks(spark, sf).select("filename", labels.fallback_character(c("brightness"), c("bandwidth"), c("rolloff"), c("zcr")).alias("character"))


@query("SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 4 THEN -1 ELSE CAST(p_size AS DOUBLE) END AS x FROM part")
def safe_casts(spark, sf):
    """Numbers that came as text, with words and infinities among them."""
    p, n = _t(spark, sf, "part"), F.col("p_size") % 7
    given = F.when(n == 0, "nan").when(n == 1, None).when(n == 2, "Infinity").when(n == 3, "none").when(n == 4, "12 bpm").otherwise(F.col("p_size").cast("string"))
    return p.select("p_partkey", labels.to_number(given, -1.0).alias("x"))


@query("""SELECT CASE WHEN p_size % 5 = 0 THEN 'Unknown' ELSE p_brand END AS name, round_even(p_retailprice / 7, 1) AS tempo_bpm, round_even(p_retailprice / 7, 2) AS spectral_centroid_mean, round_even(p_retailprice / 7, 4) AS avg_energy, round_even(p_retailprice / 7, 3) AS onset_density,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE round_even(p_retailprice / 7, 2) END AS duration, p_brand || ', ' || p_type AS tags FROM part""")
def export_rounding(spark, sf):
    p, x, n = _t(spark, sf, "part"), F.col("p_retailprice") / 7, F.col("p_size")
    told = p.select(
        F.when(n % 5 != 0, F.col("p_brand")).alias("name"), x.alias("tempo_bpm"), x.alias("spectral_centroid_mean"), x.alias("avg_energy"), x.alias("onset_density"),
        F.when(n % 3 == 0, float("nan")).otherwise(x).alias("duration"), F.array("p_brand", "p_type").alias("tags"),
    )
    return sinks.exported(told)


# ---- checks -----------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'C' END AS key, CASE WHEN l_linenumber = 2 THEN 'NaN'::DOUBLE ELSE l_tax END AS tempo, CASE WHEN l_linenumber = 4 THEN 'inf'::DOUBLE ELSE l_discount END AS rms_mean FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN key IS NULL THEN 'missing key' END, CASE WHEN isinf(rms_mean) THEN 'not finite rms_mean' END, CASE WHEN isnan(tempo) THEN 'not finite tempo' END) AS errors FROM f""")
def feature_validation(spark, sf):
    n = F.col("l_linenumber")
    other = {c: F.lit(1.0) for c in checks.REQUIRED_FEATURES if c not in ("key", "tempo", "rms_mean")}
    f = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(n != 3, "C").alias("key"), F.when(n == 4, float("inf")).otherwise(F.col("l_discount")).alias("rms_mean"), F.when(n == 2, float("nan")).otherwise(F.col("l_tax")).alias("tempo")).withColumns(other)
    return checks.feature_errors(f).select("l_orderkey", "l_linenumber", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_discount - 0.02 < 0 THEN 'negative avg_energy' END, CASE WHEN l_linenumber = 1 THEN 'missing avg_roughness' END, CASE WHEN l_returnflag <> 'N' THEN 'no number onset_density' END,
  CASE WHEN l_quantity - 10 <= 0 THEN 'duration not positive' END) AS errors FROM lineitem""")
def phase_validation(spark, sf):
    p = _t(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") - 0.02).alias("avg_energy"), F.col("l_extendedprice").alias("avg_brightness"), F.when(F.col("l_linenumber") != 1, F.col("l_tax")).alias("avg_roughness"),
        F.when(F.col("l_returnflag") == "N", "1.5").otherwise(F.col("l_returnflag")).alias("onset_density"), (F.col("l_quantity") - 10).alias("duration"),
    )
    return checks.phase_errors(p).select("l_orderkey", "l_linenumber", F.array_join("errors", "; ").alias("errors"))


@query("SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_extendedprice - 5000 < 0 THEN 'negative spectral_centroid_mean' END, 'missing spectral_bandwidth_mean', CASE WHEN l_quantity / 40 > 1 THEN 'zero_crossing_rate_mean not within 0..1' END) AS errors FROM lineitem")
def spectral_validation(spark, sf):
    p = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 5000).alias("spectral_centroid_mean"), F.col("l_extendedprice").alias("spectral_rolloff_mean"), (F.col("l_quantity") / 40).alias("zero_crossing_rate_mean"))
    return checks.spectral_errors(p).select("l_orderkey", "l_linenumber", F.array_join("errors", "; ").alias("errors"))


@query("SELECT p_partkey, concat_ws('; ', CASE WHEN p_size = 7 THEN 'missing duration' END, 'missing primary_character', CASE WHEN p_size <= 5 THEN 'invalid duration' END, CASE WHEN p_size * 8 NOT BETWEEN 30 AND 300 THEN 'tempo outside 30..300' END) AS errors FROM part")
def sequence_validation(spark, sf):
    d = F.col("p_size").cast("double")
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("filename"), F.when(F.col("p_size") != 7, d - 5).alias("duration"), (d * 8).alias("tempo"), F.col("p_brand").alias("key"), F.col("p_type").alias("primary_mood"), F.lit(0.1).alias("rms_mean"))
    return checks.sequence_errors(p).select("p_partkey", F.array_join("errors", "; ").alias("errors"))


@query("SELECT p_partkey, p_size BETWEEN 10 AND 20 AS size_ok, p_retailprice BETWEEN 1000 AND 1500 AS price_ok, FALSE AS absent_ok FROM part")
def range_validation(spark, sf):
    w = checks.within(_t(spark, sf, "part"), {"p_size": (10, 20), "p_retailprice": (1000, 1500), "absent": (0, 1)})
    return w.select("p_partkey", F.col("inside")["p_size"].alias("size_ok"), F.col("inside")["p_retailprice"].alias("price_ok"), F.col("inside")["absent"].alias("absent_ok"))


@query("SELECT unnest(['p_partkey', 'p_size', 'p_retailprice']) AS name, unnest([(SELECT CAST(count(p_partkey) AS BIGINT) FROM part), (SELECT count(p_size) FROM part), (SELECT count(p_retailprice) FROM part)]) AS n")
def numeric_projection(spark, sf):
    n = checks.numeric_features(_t(spark, sf, "part"))
    return library.unpivot(n.agg(*[F.count(c).alias(c) for c in n.columns]), [], n.columns).select(F.col("feature").alias("name"), F.col("value").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'unknown' WHEN p_size % 6 = 1 THEN 'unknown' WHEN p_size % 6 = 2 THEN 'unknown' ELSE p_brand END AS brand, CASE WHEN p_size % 4 = 0 THEN 0.05::DOUBLE ELSE least(1.0::DOUBLE, p_size / 40) END AS zero_crossing_rate_mean, CAST(greatest(1, floor(p_size / 4)) AS INT) AS num_phases FROM part")
def clean_text_and_counts(spark, sf):
    p, n = _t(spark, sf, "part"), F.col("p_size")
    brand = F.when(n % 6 == 0, "  ").when(n % 6 == 1, "NaN").when(n % 6 == 2, None).otherwise(F.concat(F.lit(" "), "p_brand", F.lit(" ")))
    df = p.select("p_partkey", brand.alias("brand"), F.when(n % 4 != 0, n / 40.0).alias("zero_crossing_rate_mean"), (n / 4.0).alias("num_phases"))
    return library.clean(df, ["zero_crossing_rate_mean", "num_phases"])


# ---- phases from frames -----------------------------------------------------------------------------

#: Events as frames, two seconds each: sr and hop that give these.
_SR, _HOP = 1, 2
BOUNDS = f"""{CHANGE}, tops AS (SELECT filename, rn FROM (SELECT filename, rn, change, lag(change) OVER w AS a, lead(change) OVER w AS b FROM changed WINDOW w AS (PARTITION BY filename ORDER BY rn)) WHERE change > a AND change > b AND rn % 7 = 3),
ends AS (SELECT filename, max(time) AS t FROM points GROUP BY filename), every AS (SELECT filename, rn * 2.0::DOUBLE AS t FROM tops WHERE rn > 2 UNION SELECT filename, 0.0 FROM ends UNION SELECT * FROM ends),
bounds AS (SELECT * FROM (SELECT filename, row_number() OVER w AS phase_number, t AS start_time, lead(t) OVER w AS end_time FROM every WINDOW w AS (PARTITION BY filename ORDER BY t)) WHERE end_time IS NOT NULL),
onsets AS (SELECT filename, time + 0.5::DOUBLE AS t FROM points WHERE chroma_spread = 0.5)"""


def _frames(spark, sf):
    return points(spark, sf).withColumnRenamed("rn", "frame_idx")


def _bounds(spark, sf):
    """Limits at every seventh point, where that is a peak."""
    c = phases.change_signal(points(spark, sf), "filename", "rn")
    by = Window.partitionBy("filename").orderBy("rn")
    tops = c.withColumns({"_a": F.lag("change").over(by), "_b": F.lead("change").over(by)}).where("change > _a and change > _b and rn % 7 = 3")
    return phases.boundaries(tops.select("filename", F.col("time").alias("t")).where("t > 5"), points(spark, sf).groupBy("filename").agg(F.max("time").alias("duration")), "filename")


def _onsets(spark, sf):
    return points(spark, sf).where("chroma_spread = 0.5").select("filename", (F.col("time") + 0.5).alias("t"))


@query(f"""WITH {BOUNDS}, m AS (SELECT b.filename, b.phase_number, avg(energy) AS energy, avg(brightness) AS brightness, avg(zcr) AS roughness FROM bounds b JOIN points p ON p.filename = b.filename AND p.rn >= floor(start_time / 2) AND p.rn < floor(end_time / 2) GROUP BY ALL),
n AS (SELECT b.filename, b.phase_number, count(*) AS n FROM bounds b JOIN onsets o ON o.filename = b.filename AND o.t >= start_time AND o.t < end_time GROUP BY ALL)
SELECT b.filename, b.phase_number, round(energy, 6) AS energy, round(brightness, 6) AS brightness, round(roughness, 6) AS roughness, end_time - start_time AS duration, round(coalesce(n, 0) / (end_time - start_time), 6) AS onset FROM bounds b JOIN m USING (filename, phase_number) LEFT JOIN n USING (filename, phase_number)""")
def phase_means(spark, sf):
    m = flow.phase_means(_bounds(spark, sf), _frames(spark, sf), _onsets(spark, sf), sr=_SR, hop=_HOP)
    return m.select("filename", F.col("phase_number").cast("long").alias("phase_number"), *[_r(c).alias(c) for c in ("energy", "brightness", "roughness")], "duration", _r("onset").alias("onset"))


@query(f"WITH {BOUNDS} SELECT b.filename, b.phase_number, count(*) AS n FROM bounds b JOIN onsets o ON o.filename = b.filename AND o.t >= start_time AND o.t < end_time GROUP BY ALL")
def onsets_in_phase(spark, sf):
    j = flow.in_interval(_onsets(spark, sf), _bounds(spark, sf), "t", "filename", "start_time", "end_time", ("phase_number",))
    return j.groupBy("filename", F.col("phase_number").cast("long").alias("phase_number")).agg(F.count("*").alias("n"))


@query(f"WITH {BOUNDS} SELECT b.filename, b.phase_number, min(rn) AS first, max(rn) AS last, count(*) AS n FROM bounds b JOIN points p ON p.filename = b.filename AND p.rn >= floor(start_time / 2) AND p.rn < floor(end_time / 2) GROUP BY ALL")
def frames_in_phase(spark, sf):
    b = _bounds(spark, sf).select("filename", "phase_number", flow.frame_range(F.col("start_time"), _SR, _HOP).alias("a"), flow.frame_range(F.col("end_time"), _SR, _HOP).alias("b"))
    j = flow.in_interval(_frames(spark, sf), b, "frame_idx", "filename", "a", "b", ("phase_number",))
    return j.groupBy("filename", F.col("phase_number").cast("long").alias("phase_number")).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.count("*").alias("n"))


@query(f"""WITH {POINTS}, w AS (SELECT filename, rn // 10 AS win, count(*) AS frames, sqrt(avg(energy * energy)) AS rms, avg(brightness) AS brightness, avg(abs(energy - brightness)) AS roughness, min(time) AS lo, max(time) AS hi FROM points GROUP BY ALL HAVING count(*) >= 5)
SELECT filename, win, frames, round(rms, 6) AS rms, lo + (frames // 2) * 2 AS centre FROM w""")
def window_features(spark, sf):
    """Windows of ten points: root mean square and the time of the middle frame."""
    t = sections.windows(points(spark, sf), "filename", "rn", "time", 10, 5)
    return t.select("filename", F.col("window").alias("win"), "frames", _r("rms").alias("rms"), _r("centre").alias("centre"))


# ---- collections ------------------------------------------------------------------------------------

_FULL = f"""{PLAYLIST}, full_ AS (SELECT p.*, CAST(substr(filename, 2) AS BIGINT) % 4 AS cluster, CAST(substr(filename, 2) AS BIGINT) % 5 + 1 AS num_phases, energy > 0.05 AS has_climax, tempo < 65 AS has_breakdown FROM playlist p)"""


def full(spark, sf):
    n = F.substring("filename", 2, 20).cast("long")
    return playlist(spark, sf).select("*", (n % 4).alias("cluster"), (n % 5 + 1).alias("num_phases"), (F.col("energy") > 0.05).alias("has_climax"), (F.col("tempo") < 65).alias("has_breakdown"))


def _top_sql(label):
    return f"(SELECT {label} FROM full_ q WHERE q.cluster = f.cluster GROUP BY {label} ORDER BY count(*) DESC, min(filename) LIMIT 1)"


_COHERENCE = "CASE WHEN max(tempo) - min(tempo) < 20 THEN 2 WHEN max(tempo) - min(tempo) < 40 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT key) <= 2 THEN 2 WHEN count(DISTINCT key) <= 3 THEN 1 ELSE 0 END + CASE WHEN count(DISTINCT mood) <= 2 THEN 2 WHEN count(DISTINCT mood) <= 3 THEN 1 ELSE 0 END + CASE WHEN stddev_samp(energy) / avg(energy) < 0.2 THEN 2 WHEN stddev_samp(energy) / avg(energy) < 0.5 THEN 1 ELSE 0 END"
_PROFILE = f"""SELECT 'Cluster_' || f.cluster AS cluster_name, CAST(f.cluster AS VARCHAR) AS cluster_id, count(*) AS track_count, string_agg(filename, '; ' ORDER BY filename) AS track_files, round(avg(tempo), 6) AS avg_tempo_bpm, round(stddev_samp(tempo), 6) AS tempo_std, round(avg(duration), 4) AS avg_duration_seconds,
  round(avg(duration) / 60, 6) AS avg_duration_minutes, round(stddev_samp(duration), 4) AS duration_std_seconds, round(avg(energy), 6) AS avg_energy, round(stddev_samp(energy), 6) AS energy_std, round(avg(brightness), 4) AS avg_brightness_hz, round(stddev_samp(brightness), 4) AS brightness_std, {_top_sql('key')} AS common_key,
  count(DISTINCT key) AS key_diversity, round(avg(num_phases), 6) AS avg_phases, round(count(*) FILTER (WHERE has_climax) * 100.0::DOUBLE / count(*), 6) AS climax_percentage, round(count(*) FILTER (WHERE has_breakdown) * 100.0::DOUBLE / count(*), 6) AS breakdown_percentage, {_top_sql('mood')} AS dominant_mood, count(DISTINCT mood) AS mood_diversity,
  {_top_sql('character')} AS dominant_character, count(DISTINCT character) AS character_diversity, round((coalesce(stddev_samp(tempo) / avg(tempo), 0) + coalesce(stddev_samp(energy) / avg(energy), 0) + coalesce(stddev_samp(brightness) / avg(brightness), 0)) / 3, 6) AS homogeneity_score,
  CASE WHEN count(*) = 1 THEN 'Single Track' WHEN {_COHERENCE} >= 6 THEN 'High' WHEN {_COHERENCE} >= 4 THEN 'Moderate' ELSE 'Low' END AS musical_coherence FROM full_ f GROUP BY f.cluster"""


@query(f"WITH {_FULL} {_PROFILE}")
def cluster_table(spark, sf):
    t = collection.cluster_table(collection.cluster_profiles(full(spark, sf)))
    digits = {"avg_duration_seconds": 4, "duration_std_seconds": 4, "avg_brightness_hz": 4, "brightness_std": 4}
    return t.withColumns({c: _r(c, digits.get(c, 6)) for c, kind in t.dtypes if kind == "double"})


def _common_sql(label):
    return f"(SELECT {label} FROM full_ GROUP BY {label} ORDER BY count(*) DESC, min(filename) LIMIT 1) AS common_{label}, (SELECT count(DISTINCT {label}) FROM full_) AS unique_{label}s"


_SPREAD = ", ".join(f"round(avg({c}), {d}) AS avg_{c}, round(max({c}) - min({c}), {d}) AS {c}_range, round(stddev_samp({c}), {d}) AS {c}_std" for c, d in (("tempo", 5), ("energy", 6), ("brightness", 3)))


@query(f"""WITH {_FULL}, ph AS (SELECT o_custkey AS f, o_totalprice AS d FROM orders), per AS (SELECT count(*) AS n FROM ph GROUP BY f)
SELECT count(*) AS total_files, sum(duration) AS total_duration_seconds, round(sum(duration) / 60, 4) AS total_duration_minutes, round(avg(duration), 4) AS avg_duration_seconds, round(avg(duration) / 60, 4) AS avg_duration_minutes, {_SPREAD}, {", ".join(map(_common_sql, collection.LABELS))},
  (SELECT count(*) FROM ph) AS phases, (SELECT round(avg(n), 6) FROM per) AS mean_per_piece, (SELECT min(n) FROM per) AS min_per_piece, (SELECT max(n) FROM per) AS max_per_piece, (SELECT round(avg(d), 2) FROM ph) AS mean_duration, (SELECT round(median(d), 2) FROM ph) AS median_duration, (SELECT round(stddev_pop(d), 2) FROM ph) AS std_duration FROM full_""")
def collection_figures(spark, sf):
    ph = _t(spark, sf, "orders").select(F.col("o_custkey").alias("filename"), F.col("o_totalprice").alias("duration"))
    s = collection.summary(full(spark, sf), ph)
    digits = {"tempo": 5, "brightness": 3, "energy": 6, "total_duration_minutes": 4, "avg_duration": 4, "mean_duration": 2, "median_duration": 2, "std_duration": 2}
    how = lambda c: next((d for part, d in digits.items() if part in c), 6)
    return s.withColumns({c: _r(c, how(c)) for c, kind in s.dtypes if kind == "double" and c != "total_duration_seconds"})


@query(f"""WITH {_FULL}, k AS (SELECT count(*) AS n FROM full_ GROUP BY cluster), ph AS (SELECT o_custkey AS f, o_orderpriority AS kind FROM orders), per AS (SELECT count(*) AS n FROM ph GROUP BY f), sq AS (SELECT *, CAST(substr(filename, 2) AS BIGINT) AS position FROM full_)
SELECT count(*) AS tracks, round(avg(duration), 4) AS mean_duration, round(min(tempo), 6) AS slowest, round(max(tempo), 6) AS fastest, round(avg(tempo), 5) AS tempo, round(stddev_samp(tempo), 5) AS tempo_std, round(count(DISTINCT key) / count(*)::DOUBLE, 6) AS key_diversity, round(count(DISTINCT mood) / count(*)::DOUBLE, 6) AS mood_diversity,
  (SELECT count(*) FROM ph) AS phases, (SELECT round(avg(n), 6) FROM per) AS mean_phases, (SELECT count(DISTINCT kind) FROM ph) AS types, (SELECT count(*) FROM k) AS clusters, (SELECT max(n) FROM k) AS largest, (SELECT min(n) FROM k) AS smallest,
  (SELECT round(arg_min(energy, position), 6) FROM sq) AS first_energy, (SELECT round(arg_max(energy, position), 6) FROM sq) AS last_energy FROM full_""")
def collection_statistics(spark, sf):
    f = full(spark, sf)
    ph = _t(spark, sf, "orders").select(F.col("o_custkey").alias("filename"), F.col("o_orderpriority").alias("phase_type"))
    s = collection.statistics(f, ph, f, f.withColumn("position", F.substring("filename", 2, 20).cast("long")))
    return s.select(
        "tracks", _r("mean_duration", 4).alias("mean_duration"), _r("tempo.min").alias("slowest"), _r("tempo.max").alias("fastest"), _r("tempo.mean", 5).alias("tempo"), _r("tempo.std", 5).alias("tempo_std"), _r("key_diversity").alias("key_diversity"), _r("mood_diversity").alias("mood_diversity"),
        F.col("phases.total").alias("phases"), _r("phases.mean").alias("mean_phases"), F.col("phases.types").alias("types"), "clusters.clusters", "clusters.largest", "clusters.smallest", _r("sequence.first_energy").alias("first_energy"), _r("sequence.last_energy").alias("last_energy"),
    )


@query(f"WITH {_FULL} SELECT unnest(['total_files', 'unique_keys', 'unique_moods']) AS metric, unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT key) AS VARCHAR), CAST(count(DISTINCT mood) AS VARCHAR)]) AS value, '' AS unit FROM full_")
def summary_unpivot(spark, sf):
    return collection.long(collection.summary(full(spark, sf))).where(F.col("metric").isin("total_files", "unique_keys", "unique_moods")).select("metric", "value", "unit")


_CL = lambda c: f"CASE WHEN {c} >= 3600 THEN printf('%d:%02d:%02d', CAST(floor({c} / 3600) AS BIGINT), CAST(floor({c} / 60) AS BIGINT) % 60, CAST(floor({c}) AS BIGINT) % 60) ELSE printf('%d:%02d', CAST(floor({c} / 60) AS BIGINT), CAST(floor({c}) AS BIGINT) % 60) END"
_CL2 = lambda c: f"printf('%02d:%02d', CAST(floor({c} / 60) AS BIGINT), CAST(floor({c}) AS BIGINT) % 60)"
_TIMED = f"""{CLASSED}, timed AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY filename ORDER BY phase_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_time, sum(duration) OVER (PARTITION BY filename ORDER BY phase_number ROWS UNBOUNDED PRECEDING) AS end_time FROM classed)"""


def timed(spark, sf):
    """Classified phases one after another, with moods."""
    by = Window.partitionBy("filename").orderBy("phase_number").rowsBetween(Window.unboundedPreceding, 0)
    p = phases.classify(phase_rows(spark, sf)).withColumn("end_time", F.sum("duration").over(by))
    p = p.withColumn("start_time", F.col("end_time") - F.col("duration")).withColumn("roughness", F.col("energy") / 2)
    return p.withColumn("moods", F.array_compact(F.array(F.when(F.col("energy") > 0.1, "loud"), F.lit("plain"))))


@query(f"""WITH {_TIMED}, w AS (SELECT filename, max(end_time) AS t, count(*) AS n FROM timed GROUP BY filename)
SELECT filename, t AS total_duration_seconds, round(t / 60, 8) AS total_duration_minutes, n AS total_phases, phase_number, phase_type, start_time AS start_time_seconds, end_time AS end_time_seconds, duration AS duration_seconds, round(duration / 60, 8) AS duration_minutes, round(energy, 8) AS avg_energy, round(brightness, 8) AS avg_brightness_hz,
  round(energy / 2, 8) AS avg_roughness, round(onset, 8) AS onset_density_per_second, CASE WHEN energy > 0.1 THEN 'loud, plain' ELSE 'plain' END AS mood_descriptors, CASE WHEN energy > 0.1 THEN 2 ELSE 1 END AS mood_count, {_CL2('start_time')} AS start_time_formatted, {_CL2('end_time')} AS end_time_formatted, {_CL('duration')} AS duration_formatted FROM timed JOIN w USING (filename)""")
def phase_table(spark, sf):
    t = collection.phase_table(timed(spark, sf))
    exact = ("total_duration_seconds", "start_time_seconds", "end_time_seconds", "duration_seconds")
    return t.withColumns({c: _r(c, 8) for c, kind in t.dtypes if kind == "double" and c not in exact})


@query(f"""WITH {PLAYLIST}, s AS (SELECT *, row_number() OVER (PARTITION BY character ORDER BY filename) AS position, count(*) OVER (PARTITION BY character) AS n FROM playlist), c AS (SELECT *, sum(duration) OVER (PARTITION BY character ORDER BY position ROWS UNBOUNDED PRECEDING) AS total FROM s)
SELECT character AS list, position, filename, duration AS duration_seconds, round(duration / 60, 6) AS duration_minutes, {_CL('duration')} AS duration_formatted, round(tempo, 6) AS tempo_bpm, key, mood AS primary_mood, character AS primary_character, round(energy, 6) AS energy_level,
  CASE WHEN position = 1 THEN 'opening' WHEN position = n THEN 'closing' WHEN (position - 1) / greatest(n - 1, 1) < 0.3 THEN 'early' WHEN (position - 1) / greatest(n - 1, 1) < 0.7 THEN 'core' ELSE 'building' END AS reasoning, round(CASE WHEN n > 1 THEN (position - 1) * 100.0::DOUBLE / (n - 1) ELSE 0 END, 6) AS position_percentage, total AS cumulative_duration_seconds, round(total / 60, 6) AS cumulative_duration_minutes FROM c""")
def sequence_table(spark, sf):
    t = collection.sequence_table(ordered(spark, sf), "list")
    return t.withColumns({c: _r(c) for c in ("duration_minutes", "tempo_bpm", "energy_level", "position_percentage", "cumulative_duration_minutes")})


def ordered(spark, sf):
    """Playlists of one character each, in the order of their names."""
    w = Window.partitionBy("list")
    p = playlist(spark, sf).withColumn("list", F.col("character"))
    p = p.withColumn("position", F.row_number().over(w.orderBy("filename")).cast("long")).withColumn("_n", F.count("*").over(w))
    return p.withColumn("reasoning", library.reasoning(F.col("position"), F.col("_n"))).drop("_n")


# ---- tools ------------------------------------------------------------------------------------------


def _noted(spark, sf):
    t = playlist(spark, sf)
    return t.select("filename", "duration", "tempo", "key", "energy", "brightness", F.array("mood", F.lit("plain")).alias("moods"), F.col("mood").alias("primary_mood"), F.col("key_confidence").alias("mood_confidence"), F.array("character").alias("tags"), F.col("character").alias("primary_character"), F.lit(0.5).alias("character_confidence"))


@query(f"WITH {PLAYLIST} SELECT filename, mood AS primary_mood, mood || ', plain' AS mood_descriptors, round(key_confidence, 6) AS mood_confidence, character AS character_tags, round(duration / 60, 6) AS duration_minutes, key, round(brightness, 4) AS spectral_brightness_hz FROM playlist")
def tool_mood(spark, sf):
    a = tools.mood_answer(_noted(spark, sf))
    return a.select("filename", "analysis.primary_mood", "analysis.mood_descriptors", _r("analysis.mood_confidence").alias("mood_confidence"), "analysis.character_tags", _r("technical_properties.duration_minutes").alias("duration_minutes"), "technical_properties.key", _r("technical_properties.spectral_brightness_hz", 4).alias("spectral_brightness_hz"))


@query(f"WITH {PLAYLIST} SELECT count(*) AS total_tracks, count(DISTINCT mood) AS unique_moods, count(DISTINCT character) AS unique_characters, round(avg(key_confidence), 6) AS avg_confidence, round(sum(duration) / 60, 4) AS total_duration_minutes FROM playlist")
def tool_mood_totals(spark, sf):
    return tools.mood_totals(_noted(spark, sf)).withColumns({"avg_confidence": _r("avg_confidence"), "total_duration_minutes": _r("total_duration_minutes", 4)})


_LEVEL = "CASE WHEN energy < 0.02 THEN 'Very Low' WHEN energy < 0.05 THEN 'Low' WHEN energy < 0.08 THEN 'Medium' WHEN energy < 0.12 THEN 'High' ELSE 'Very High' END"


@query(f"""WITH {_TIMED}, w AS (SELECT filename, max(end_time) AS t, count(*) AS n FROM timed GROUP BY filename)
SELECT filename, phase_number, {_CL2('start_time')} AS start, {_CL2('end_time')} AS stop, phase_type, {_ROLE} AS role, {_LEVEL} AS energy_level, CASE WHEN brightness < 1000 THEN 'Dark' WHEN brightness < 2000 THEN 'Warm' WHEN brightness < 3000 THEN 'Bright' ELSE 'Very Bright' END AS brightness_level, {_CL2('t')} AS total,
  n AS num_phases, CASE WHEN n / (t / 60) < 0.5 THEN 'Simple' WHEN n / (t / 60) < 1 THEN 'Moderate' ELSE 'Complex' END AS complexity FROM timed JOIN w USING (filename)""")
def tool_phases(spark, sf):
    a = tools.phase_answer(timed(spark, sf)).select("filename", F.col("overall_structure").alias("o"), F.explode("phases").alias("p"))
    return a.select("filename", "p.phase_number", F.col("p.timing.start_time_formatted").alias("start"), F.col("p.timing.end_time_formatted").alias("stop"), "p.classification.phase_type", F.col("p.classification.structural_role").alias("role"), "p.characteristics.energy_level", "p.characteristics.brightness_level", F.col("o.total_duration_formatted").alias("total"), "o.num_phases", F.col("o.structural_complexity").alias("complexity"))


@query(f"WITH {_TIMED}, w AS (SELECT filename, max(end_time) AS t, count(*) AS n FROM timed GROUP BY filename) SELECT count(*) AS total_files, CAST(sum(n) AS BIGINT) AS total_phases, round(avg(n), 6) AS avg_phases_per_track, round(sum(t) / 60, 4) AS total_duration_minutes, (SELECT count(DISTINCT phase_type) FROM timed) AS unique_phase_types FROM w")
def tool_phase_totals(spark, sf):
    return tools.phase_totals(timed(spark, sf)).withColumns({"avg_phases_per_track": _r("avg_phases_per_track"), "total_duration_minutes": _r("total_duration_minutes", 4)})


@query(f"""WITH {PLAYLIST}, s AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY character) AS n, sum(duration) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM playlist WINDOW w AS (PARTITION BY character ORDER BY filename))
SELECT character AS list, position, filename, {_CL2('total')} AS cumulative, CASE WHEN tempo < 80 THEN 'Slow' WHEN tempo < 120 THEN 'Medium' WHEN tempo < 140 THEN 'Upbeat' ELSE 'Fast' END AS tempo_category, {_LEVEL} AS energy_category,
  CASE WHEN position / n < 0.25 THEN 'Opening Quarter' WHEN position / n < 0.5 THEN 'First Half' WHEN position / n < 0.75 THEN 'Second Half' ELSE 'Closing Quarter' END AS place FROM s""")
def tool_sequence(spark, sf):
    a = tools.sequence_answer(ordered(spark, sf), "list")
    return a.select("list", "position", "filename", F.col("timing.cumulative_time_formatted").alias("cumulative"), "musical_properties.tempo_category", "musical_properties.energy_category", F.col("sequencing.position_in_arc").alias("place"))


@query(f"""WITH {PLAYLIST}, s AS (SELECT *, row_number() OVER (PARTITION BY character ORDER BY filename) AS position, row_number() OVER (PARTITION BY character ORDER BY filename DESC) AS z FROM playlist)
SELECT character AS list, count(*) AS total_tracks, sum(duration) AS total_duration_seconds, round(min(tempo), 6) AS min_bpm, round(max(tempo), 6) AS max_bpm, round(arg_min(energy, position), 6) AS opening_energy, round(arg_max(energy, position), 6) AS closing_energy, string_agg(mood, ' > ' ORDER BY position) AS journey,
  CASE WHEN avg(energy) FILTER (WHERE z <= 2) > avg(energy) FILTER (WHERE position <= 2) * 1.2::DOUBLE THEN 'Building' WHEN avg(energy) FILTER (WHERE z <= 2) < avg(energy) FILTER (WHERE position <= 2) * 0.8::DOUBLE THEN 'Declining' ELSE 'Stable' END AS progression_type, {_CL2('sum(duration)')} AS total_duration_formatted FROM s GROUP BY character""")
def tool_sequence_totals(spark, sf):
    t = tools.sequence_totals(ordered(spark, sf), "list")
    return t.select("list", "total_tracks", "total_duration_seconds", *[_r(c).alias(c) for c in ("min_bpm", "max_bpm", "opening_energy", "closing_energy")], F.array_join("mood_journey", " > ").alias("journey"), "progression_type", "total_duration_formatted")


@query(f"""WITH {_FULL}, p AS ({_PROFILE}) SELECT CAST(cluster_id AS BIGINT) AS cluster, track_count, avg_tempo_bpm, common_key, dominant_mood, climax_percentage, musical_coherence AS structural_coherence FROM p""")
def tool_clusters(spark, sf):
    a = tools.cluster_answer(collection.cluster_profiles(full(spark, sf)))
    return a.select("cluster", "cluster_info.track_count", _r("musical_characteristics.avg_tempo_bpm").alias("avg_tempo_bpm"), "musical_characteristics.common_key", "creative_characteristics.dominant_mood", _r("structural_properties.climax_percentage").alias("climax_percentage"), "structural_properties.structural_coherence")


@query(f"WITH {_FULL}, p AS ({_PROFILE}) SELECT CAST(sum(track_count) AS BIGINT) AS total_tracks, count(*) AS num_clusters, max(track_count) AS largest_cluster_size, min(track_count) AS smallest_cluster_size, CAST((SELECT cluster_id FROM p ORDER BY climax_percentage DESC, cluster_id LIMIT 1) AS BIGINT) AS most_coherent_cluster FROM p")
def tool_cluster_totals(spark, sf):
    return tools.cluster_totals(collection.cluster_profiles(full(spark, sf)))


@query(f"""WITH {_FULL}, per AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS total_tracks, round(sum(duration) / 60, 4) AS total_duration_minutes, count(DISTINCT key) AS unique_keys, round(avg(tempo), 5) AS avg_tempo_bpm, (SELECT mood FROM full_ GROUP BY mood ORDER BY count(*) DESC, mood LIMIT 1) AS dominant_mood,
  (SELECT count(DISTINCT cluster) FROM full_) AS num_clusters, (SELECT CAST(sum(n) AS BIGINT) FROM per) AS total_phases, (SELECT round(avg(n), 6) FROM per) AS avg_phases_per_track FROM full_""")
def tool_comprehensive(spark, sf):
    f = full(spark, sf)
    c = tools.comprehensive(f, _t(spark, sf, "orders").select(F.col("o_custkey").alias("filename")), collection.cluster_profiles(f))
    return c.withColumns({"total_duration_minutes": _r("total_duration_minutes", 4), "avg_tempo_bpm": _r("avg_tempo_bpm", 5), "avg_phases_per_track": _r("avg_phases_per_track")})


# ---- clusters ---------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'inf'::DOUBLE ELSE o_totalprice END AS a FROM orders) SELECT o_orderkey, round(CASE WHEN a IS NULL OR isinf(a) THEN (SELECT avg(a) FROM o WHERE NOT isinf(a)) ELSE a END, 4) AS a FROM o""")
def impute_means(spark, sf):
    k = F.col("o_orderkey")
    df = _t(spark, sf, "orders").select("o_orderkey", F.when(k % 4 == 0, None).when(k % 4 == 1, float("inf")).otherwise(F.col("o_totalprice")).alias("a"))
    return clusters.impute_means(df, ["a"]).select("o_orderkey", _r("a", 4).alias("a"))


_Z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in ("tempo", "energy", "brightness"))


@query(f"""WITH {_FULL}, z AS (SELECT cluster, {_Z} FROM full_), c AS (SELECT cluster, count(*) AS n, avg(tempo) AS a, avg(energy) AS b, avg(brightness) AS c FROM z GROUP BY cluster), d AS (SELECT cluster, n, (tempo - a) ** 2 + (energy - b) ** 2 + (brightness - c) ** 2 AS d2 FROM z JOIN c USING (cluster))
SELECT cluster, n, round(CASE WHEN n <= 1 THEN 0 ELSE avg(sqrt(d2)) END, 6) AS cohesion, round(sum(d2), 5) AS inertia FROM d GROUP BY cluster, n""")
def cluster_cohesion(spark, sf):
    return clusters.cohesion(full(spark, sf), "cluster", ["tempo", "energy", "brightness"]).withColumns({"cohesion": _r("cohesion"), "inertia": _r("inertia", 5)})


@query(f"""WITH {_FULL}, c AS (SELECT cluster, count(*) AS n, avg(tempo) AS a, avg(energy) AS b, var_pop(tempo) * count(*) + var_pop(energy) * count(*) AS w FROM full_ GROUP BY cluster), m AS (SELECT avg(tempo) AS a, avg(energy) AS b FROM full_)
SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round(sum(n * ((c.a - m.a) ** 2 + (c.b - m.b) ** 2)), 4) AS between, round(sum(w), 4) AS within, round(sum(n * ((c.a - m.a) ** 2 + (c.b - m.b) ** 2)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 4) AS ratio FROM c, m""")
def calinski_harabasz(spark, sf):
    return clusters.calinski_harabasz(full(spark, sf), "cluster", ["tempo", "energy"]).withColumns({c: _r(c, 4) for c in ("between", "within", "ratio")})


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part), r(step, k, x, y) AS (SELECT 0, p_partkey, CAST(p_size AS DOUBLE), p_retailprice / 100 FROM part WHERE p_partkey <= 3
UNION ALL (SELECT step + 1, k, avg(px), avg(py) FROM (SELECT p.id, p.x AS px, p.y AS py, any_value(r.step) AS step, arg_min(r.k, (p.x - r.x) ** 2 + (p.y - r.y) ** 2) AS k FROM p, r WHERE r.step < 5 GROUP BY p.id, p.x, p.y) GROUP BY step, k))
SELECT k, round(x, 6) AS x, round(y, 6) AS y FROM r WHERE step = 5""")
def lloyd_iterations(spark, sf):
    """Five steps from the first four parts as centers."""
    p = _t(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v"))
    start = [r.v for r in p.where("p_partkey <= 3").orderBy("p_partkey").collect()]
    _, at = clusters.lloyd(p, "v", len(start), 5, centers=start)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(at)], "k long, x double, y double").select("k", _r("x").alias("x"), _r("y").alias("y"))


@query("SELECT label, dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(64)) AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label, dim")
def mean_spectra(spark, sf):
    m = _t(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")).groupBy("label").agg(mean_spectrum("v").alias("m"))
    return m.select("label", F.posexplode("m").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), _r("x").alias("x"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total, round((row_number() OVER (ORDER BY o_orderkey) - 1) * 100.0::DOUBLE / (count(*) OVER () - 1), 6) AS position_pct FROM (SELECT o_orderkey, round(o_totalprice) AS o_totalprice FROM orders)")
def running_total_of_all(spark, sf):
    """Without a key: whole numbers, so that partial sums are exact."""
    r = library.running_total(_t(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice").alias("o_totalprice")), "o_orderkey", "o_totalprice")
    return r.select("o_orderkey", _r("total", 2).alias("total"), _r("position_pct").alias("position_pct"))


# ---- sections with labels, edges --------------------------------------------------------------------

_EDGE_TEX = f"{POINTS}, {TEX}"


@query(f"""WITH {_EDGE_TEX}, s AS (SELECT a.filename AS filename_a, b.filename AS filename_b, round(greatest(0, least(1.0::DOUBLE, list_cosine_similarity(a.v, b.v))), 6) AS score FROM tex a JOIN tex b ON a.filename <> b.filename)
SELECT filename_a, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY filename_a ORDER BY score DESC) AS rank FROM s) WHERE rank <= 3""")
def similarity_edges(spark, sf):
    """Edges by texture alone; of pieces equally alike which comes first is left open."""
    t = settle(sections.texture_fingerprint(points(spark, sf)), "prints").withColumn("structure", F.col("texture"))
    e = sections.edges(sections.similar(t))
    return e.select("filename_a", _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


_ROW = "CASE WHEN {a} BETWEEN r.{b}_lo AND r.{b}_hi THEN {w}::DOUBLE ELSE 0 END"


@query(f"""WITH RECURSIVE {SECS}, slices AS (SELECT filename, section, greatest(0, mid - half) AS a, greatest(0, mid - half) + 2 * half AS b FROM (SELECT *, (start + stop) / 2 AS mid, least(20, stop - start) / 2 AS half FROM secs) WHERE 2 * half >= 0.5),
me AS (SELECT c.filename, c.section, any_value(b - a) AS duration, avg(energy) / 500 AS energy, avg(brightness) AS brightness, avg(zcr) AS zcr FROM slices c JOIN points p ON p.filename = c.filename AND p.time >= a AND p.time < b GROUP BY c.filename, c.section),
hits AS (SELECT c.filename, c.section, count(*) AS n FROM slices c JOIN points p ON p.filename = c.filename AND p.chroma_spread = 0.5 AND p.time + 0.5::DOUBLE >= a AND p.time + 0.5::DOUBLE < b GROUP BY c.filename, c.section),
t AS (SELECT me.*, brightness * 0.3::DOUBLE AS bandwidth, zcr AS roughness, coalesce(n, 0) / duration AS onset FROM me LEFT JOIN hits USING (filename, section)), r({", ".join(rules.moods()[0])}) AS (VALUES {rules.as_values(rules.moods())}),
raw AS (SELECT t.filename, t.section, r.ord, r.name, CASE WHEN r.name = 'synthetic' AND zcr > 0.05 THEN 0 ELSE ({" + ".join(_ROW.format(a=k, b=k, w=w) for k, w in labels.MOOD_WEIGHTS.items())} + CASE WHEN duration >= r.min_duration THEN 1.0::DOUBLE ELSE 0 END) / 12 END AS s FROM t, r),
d AS (SELECT filename, section, arg_min(name, ord) AS mood FROM raw WHERE CASE WHEN s > 0.8::DOUBLE THEN least(1.0::DOUBLE, s * 1.1::DOUBLE) ELSE s END >= 0.7::DOUBLE GROUP BY filename, section)
SELECT t.filename, t.section, coalesce(mood, {FALLBACK}) AS mood FROM t LEFT JOIN d USING (filename, section)""")
def section_moods(spark, sf):
    """The first mood that the middle of each section meets, with events as frames."""
    p = points(spark, sf)
    frames = p.select("filename", F.col("time").alias("t"), (F.col("energy") / 500).alias("energy"), "brightness", "zcr", (F.col("brightness") * 0.3).alias("bandwidth"), (F.col("brightness") * 1.5).alias("rolloff"))
    labelled = flow.section_labels(typed(spark, sf), frames, _onsets(spark, sf))
    return labelled.where("mood is not null").select("filename", F.col("section").cast("long").alias("section"), "mood")


@query(f"""WITH {TRACKS}, z AS (SELECT filename, (energy - avg(energy) OVER ()) / stddev_pop(energy) OVER () AS a, (brightness - avg(brightness) OVER ()) / stddev_pop(brightness) OVER () AS b FROM tracks), c AS (SELECT sign(corr(energy, brightness)) AS s, abs(corr(energy, brightness)) AS r FROM tracks)
SELECT filename, round(abs(a + s * b) / sqrt(2), 5) AS pc1, round(abs(a - s * b) / sqrt(2), 5) AS pc2, round((1 + r) / 2, 6) AS explained FROM z, c""")
def pca_of_two(spark, sf):
    """Two columns have known axes: their sum and their difference; the sign of an axis is free."""
    out, share = clusters.pca(tracks(spark, sf), ["energy", "brightness"])
    return out.select("filename", _r(F.abs("pc1"), 5).alias("pc1"), _r(F.abs("pc2"), 5).alias("pc2"), F.round(F.lit(share[0]), 6).alias("explained"))
