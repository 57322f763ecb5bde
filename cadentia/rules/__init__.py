"""Rule tables: what each label means, as data. An open upper bound is inf; an absent range is -."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, in the order that decides ties.
# mood, category, energy, brightness Hz, roughness, onsets per second, least duration s, bandwidth Hz
MOODS = """
spacey core 0..0.03 2000..inf 0..0.1 0..0.5 20 0..1500
organic core 0.02..0.08 0..inf 0.1..inf 0..inf 0 1500..inf
synthetic core 0..inf 1500..inf 0..0.05 0..inf 0 0..800
oozy core 0..0.025 0..1500 0..inf 0..0.5 0 0..inf
pensive core 0.03..0.06 1200..2200 0..inf 0.5..1.5 0 0..inf
tense core 0.08..inf 2500..inf 0..inf 2..inf 0 0..inf
exuberant core 0.1..inf 2000..inf 0..inf 1.5..inf 0 0..inf
glitchy core 0..inf 0..inf 0.15..inf 3..inf 0 2000..inf
chaos core 0.15..inf 0..800 0..inf 4..inf 0 0..inf
ethereal extended 0..0.02 3000..inf 0..inf 0..0.3 0 0..inf
atmospheric extended 0..0.015 0..inf 0..inf 0..0.2 0 1800..inf
crystalline extended 0..inf 2800..inf 0..0.04 0.5..1.5 0 0..inf
warm extended 0.03..0.08 800..1800 0..inf 0..inf 0 1200..inf
melodic extended 0.04..0.09 0..inf 0..inf 0.3..1.2 0 1000..1600
driving extended 0.05..0.12 0..inf 0..inf 1..2.5 0 800..1800
percussive extended 0.06..inf 0..inf 0..inf 2.5..inf 0 0..inf
droning extended 0.01..inf 0..inf 0..inf 0..0.1 15 0..inf
celestial advanced 0..0.015 3500..inf 0..0.03 0..0.2 25 0..1200
gossamer advanced 0..0.02 4000..inf 0..0.06 0..0.4 15 0..1000
luminous advanced 0.01..0.04 3200..inf 0..0.08 0..0.6 20 800..1800
nebulous advanced 0.005..0.03 1500..2800 0.02..0.12 0..0.5 30 1200..2500
spectral advanced 0..0.025 2800..4500 0..0.05 0..0.3 18 600..1400
prismatic advanced 0.02..0.06 2500..inf 0.04..0.15 0.2..0.8 12 1800..inf
vaporous advanced 0..0.02 1800..3500 0.01..0.08 0..0.4 22 1000..2000
iridescent advanced 0.01..0.045 3000..inf 0.05..0.18 0.3..1 10 1500..inf
translucent advanced 0.005..0.035 2200..3800 0..0.07 0..0.5 16 1100..2200
opalescent advanced 0.01..0.04 2000..3200 0.02..0.09 0.1..0.6 14 1200..2000
velvet advanced 0.03..0.08 600..1600 0..0.06 0.2..1 8 1000..1800
silky advanced 0.02..0.07 800..2000 0..0.04 0.1..0.8 6 800..1500
granular advanced 0.02..0.12 1200..inf 0.08..0.25 1.5..4 0 1500..inf
fibrous advanced 0.025..0.09 1000..2500 0.06..0.18 0.8..2.2 5 1400..2800
crystalline_hard advanced 0.04..0.15 3500..inf 0..0.03 0.5..2 0 0..800
molten advanced 0.08..0.2 400..1200 0.1..0.3 0.5..2.5 0 1800..inf
metallic advanced 0.05..0.18 2000..inf 0.03..0.15 0.8..3.5 0 1200..2500
ceramic advanced 0.03..0.1 1800..3500 0..0.08 0.4..1.8 3 900..1600
wooden advanced 0.04..0.12 500..1400 0.05..0.2 0.3..2 0 1100..2200
plastic advanced 0.03..0.11 1200..2800 0..0.06 0.5..2.5 0 600..1200
rubbery advanced 0.05..0.15 800..2200 0.04..0.16 1..3.5 0 1000..2000
spongy advanced 0.02..0.08 600..1800 0.08..0.22 0.5..2 4 1300..2600
viscous advanced 0.01..0.06 400..1200 0.02..0.12 0..1 12 800..1600
gelatinous advanced 0.02..0.07 700..1600 0.03..0.14 0.2..1.2 8 1000..2000
powdery advanced 0.01..0.05 1000..2500 0.1..0.3 0.8..3 2 1500..inf
euphoric advanced 0.1..inf 2500..inf 0..0.1 1.5..inf 0 1200..inf
melancholic advanced 0.02..0.06 800..1800 0..0.08 0.2..1 10 900..1600
nostalgic advanced 0.025..0.07 600..1600 0.02..0.12 0.3..1.2 8 1100..2000
anxious advanced 0.06..0.14 1800..inf 0.08..0.25 2..5 0 1500..inf
serene advanced 0.015..0.05 1000..2200 0..0.06 0.1..0.8 15 800..1600
mysterious advanced 0.02..0.08 1200..2800 0.04..0.16 0.3..1.5 12 1300..2600
playful advanced 0.06..0.16 1800..inf 0.02..0.12 1.2..3.5 0 1000..2200
brooding advanced 0.03..0.09 400..1200 0.02..0.15 0.2..1.5 15 1000..2000
hopeful advanced 0.04..0.12 1500..3000 0..0.08 0.5..2 6 1100..2000
longing advanced 0.025..0.08 900..2000 0.02..0.1 0.2..1.2 12 1000..1800
triumphant advanced 0.12..inf 2200..inf 0..0.12 1.8..inf 0 1500..inf
contemplative advanced 0.02..0.06 800..2000 0..0.08 0.1..0.8 18 900..1700
yearning advanced 0.03..0.1 1200..2500 0.02..0.12 0.3..1.5 10 1100..2200
ecstatic advanced 0.15..inf 3000..inf 0.05..0.2 2.5..inf 0 1800..inf
introspective advanced 0.015..0.05 600..1600 0..0.06 0.1..0.6 20 800..1400
wistful advanced 0.02..0.06 900..1900 0.02..0.1 0.2..1 12 1000..1800
vindictive advanced 0.1..inf 2000..inf 0.12..0.4 2.5..inf 0 1800..inf
compassionate advanced 0.03..0.08 800..2000 0..0.08 0.2..1.2 8 1200..2000
rebellious advanced 0.08..0.2 1500..inf 0.1..0.35 2..6 0 1600..inf
transcendent advanced 0.02..0.1 2500..inf 0..0.06 0.1..1 25 800..1800
pulsating advanced 0.04..0.15 1000..inf 0.02..0.12 1.5..4 0 1000..2500
undulating advanced 0.03..0.1 800..2500 0.01..0.08 0.5..2 8 1100..2200
oscillating advanced 0.05..0.18 1200..3500 0.03..0.15 2..5 0 1300..2800
spiraling advanced 0.06..0.16 1500..inf 0.05..0.2 1.8..4.5 5 1600..inf
cascading advanced 0.08..0.2 2000..inf 0.1..0.3 3..inf 0 2000..inf
surging advanced 0.1..inf 1800..inf 0.05..0.18 2.5..inf 0 1500..inf
rippling advanced 0.02..0.08 1200..2800 0.02..0.1 0.8..2.5 6 1200..2400
churning advanced 0.08..0.22 1000..inf 0.15..0.4 3.5..inf 0 1800..inf
flowing advanced 0.03..0.1 800..2200 0..0.06 0.5..1.5 10 1000..2000
jolting advanced 0.1..inf 2000..inf 0.2..0.5 4..inf 0 2000..inf
drifting advanced 0.01..0.04 1000..2500 0..0.05 0..0.6 20 800..1600
accelerating advanced 0.06..0.18 1500..inf 0.03..0.15 2..6 4 1400..inf
decelerating advanced 0.02..0.08 600..2000 0.02..0.1 0.5..2 8 900..1800
pendular advanced 0.04..0.12 1000..2800 0.02..0.1 1..3 6 1100..2200
gyrating advanced 0.08..0.2 1500..inf 0.08..0.25 2.5..5.5 0 1600..inf
cavernous advanced 0.02..0.08 400..1200 0.05..0.2 0.2..1.5 15 1500..inf
intimate advanced 0.025..0.07 800..1800 0..0.08 0.3..1.2 8 1000..1800
expansive advanced 0.05..0.15 1500..inf 0.02..0.12 0.5..2.5 12 2000..inf
compressed advanced 0.06..0.12 1200..2500 0..0.08 1.5..4 0 800..1600
panoramic advanced 0.04..0.12 1000..inf 0.02..0.1 0.5..2 20 1800..inf
claustrophobic advanced 0.08..0.18 1000..2000 0.1..0.3 2..5 0 600..1200
dimensional advanced 0.06..0.16 1500..inf 0.05..0.18 1.5..4 8 2000..inf
microscopic advanced 0.01..0.06 2000..inf 0.15..0.4 3..inf 0 1800..inf
telescopic advanced 0.02..0.08 2500..inf 0..0.08 0.1..1 25 1200..2500
fractal advanced 0.04..0.14 1500..inf 0.1..0.35 2..6 10 1800..inf
syncopated advanced 0.06..0.18 1200..inf 0.05..0.2 2.5..6 0 1300..2800
polyrhythmic advanced 0.08..0.2 1500..inf 0.1..0.3 4..inf 5 1600..inf
rubato advanced 0.03..0.12 800..2500 0.02..0.15 0.5..2.5 8 1000..2200
staccato advanced 0.08..0.2 2000..inf 0.1..0.3 4..inf 0 1500..inf
legato advanced 0.03..0.1 600..2000 0..0.06 0.3..1.5 10 900..1800
accelerando advanced 0.05..0.18 1200..inf 0.03..0.15 1.5..5 6 1300..inf
ritardando advanced 0.02..0.08 600..1800 0.01..0.1 0.5..2 10 800..1600
tremolo advanced 0.04..0.14 1000..3000 0.08..0.25 3..inf 0 1200..2500
vibrato advanced 0.04..0.12 800..2200 0.05..0.18 1.5..4 4 1100..2200
sforzando advanced 0.15..inf 2000..inf 0.1..0.4 3..inf 0 1800..inf
tenuto advanced 0.04..0.12 600..2000 0..0.08 0.2..1.2 12 1000..2000
marcato advanced 0.1..0.22 1800..inf 0.08..0.25 2.5..inf 0 1600..inf
fermata advanced 0.02..0.1 800..2500 0..0.1 0..0.5 30 1000..2000
ostinato advanced 0.05..0.15 1000..2800 0.02..0.12 2..5 15 1200..2400
hemiola advanced 0.06..0.16 1300..3000 0.08..0.22 3..6.5 0 1400..2800
tempestuous advanced 0.15..inf 1500..inf 0.2..0.5 4..inf 0 2000..inf
arctic advanced 0..0.03 3000..inf 0..0.05 0..0.3 25 0..1000
tropical advanced 0.06..0.16 1200..2800 0.08..0.22 1.5..4 0 1600..inf
desert advanced 0.01..0.05 1500..3500 0.02..0.1 0..0.8 30 800..1600
oceanic advanced 0.03..0.12 600..1800 0.05..0.2 0.5..2.5 20 1400..2800
volcanic advanced 0.12..inf 1000..2500 0.15..0.4 3..inf 0 1800..inf
glacial advanced 0.01..0.06 800..2000 0..0.08 0..0.5 40 1200..2400
pastoral advanced 0.03..0.08 800..2200 0.04..0.16 0.5..2 12 1200..2200
urban advanced 0.08..0.2 1500..inf 0.1..0.3 2.5..inf 0 1600..inf
subterranean advanced 0.02..0.08 200..800 0.05..0.2 0.2..1.5 20 1000..2000
celestial_storms advanced 0.1..inf 3000..inf 0.15..0.4 3.5..inf 0 2200..inf
aurora advanced 0.02..0.08 2500..inf 0.08..0.25 1.5..4 15 1800..inf
mirage advanced 0.02..0.06 2000..3500 0.1..0.3 2..5 8 1600..inf
monsoon advanced 0.08..0.18 1000..2500 0.15..0.35 3..6 10 1800..inf
eclipse advanced 0.03..0.1 600..1800 0.02..0.12 0.5..2 20 1000..2200
"""

# Fixed values, in the order that decides ties.
# tag, category, centroid Hz, bandwidth Hz, rolloff Hz, zero crossings, timbre predicate, flatness, flux, stereo width, threshold
TAGS = """
analog_synth synthesis 0..inf 0..1000 0..inf 0..0.1 precision=low - - - 0.6
digital_synth synthesis 2000..inf 0..800 0..inf 0..inf precision=high - - - 0.6
mellotron synthesis 0..inf 1200..2000 0..inf 0.05..0.15 pass - - - 0.6
percussive_instrument synthesis 2500..inf 0..inf 4000..inf 0.1..inf pass - - - 0.6
acoustic_instrument synthesis 0..inf 1800..inf 0..inf 0.12..inf complexity=high - - - 0.6
fm_synth synthesis 1500..3000 1000..2500 3000..inf 0.08..0.25 pass - - - 0.6
am_synth synthesis 800..2500 600..1800 0..inf 0.05..0.2 pass - - - 0.6
granular_synth synthesis 1000..inf 1500..inf 0..inf 0.2..inf pass - - - 0.6
wavetable_synth synthesis 1200..4000 1000..3000 2500..inf 0.06..0.3 pass - - - 0.6
physical_modeling synthesis 600..3500 1200..2800 1800..5000 0.08..0.18 pass - - - 0.6
drum_machine synthesis 1500..inf 1800..inf 3500..inf 0.15..inf pass - - - 0.6
sampler synthesis 0..inf 800..inf 0..inf 0..inf pass - - - 0.6
subtractive_synth synthesis 800..2800 600..2000 1500..4000 0..0.15 pass - - - 0.6
additive_synth synthesis 1000..4000 1500..inf 2000..inf 0.02..0.12 pass - - - 0.6
modular_synth synthesis 0..inf 0..inf 0..inf 0..inf pass - - - 0.6
string_machine synthesis 800..2200 1200..2400 2000..4500 0.03..0.12 pass - - - 0.6
organ synthesis 400..1800 800..2000 1200..3000 0..0.08 pass - - - 0.6
piano synthesis 600..2500 1500..3500 2000..5000 0.08..0.2 pass - - - 0.6
choir synthesis 600..2000 1000..2200 1800..3500 0.05..0.15 pass - - - 0.6
brass synthesis 1200..3500 1300..3000 3000..inf 0.08..0.2 pass - - - 0.6
woodwind synthesis 800..2800 1100..2400 2200..4500 0.1..0.25 pass - - - 0.6
pad_synth synthesis 600..2200 1200..2800 1800..4000 0..0.1 pass - - - 0.6
lead_synth synthesis 1500..4000 800..2200 2500..inf 0.02..0.15 pass - - - 0.6
bass_synth synthesis 0..800 200..1200 400..1500 0..0.08 pass - - - 0.6
arp_synth synthesis 1200..3500 800..2000 2000..5000 0.05..0.2 pass - - - 0.6
spoken_word synthesis 200..3800 800..4000 0..inf 0.04..0.28 pass 0.05..0.65 - - 0.9
guitar synthesis 500..4000 1000..3500 1500..inf 0.04..0.25 pass 0.05..0.35 - - 0.9
live_drums synthesis 1000..inf 1500..inf 2500..inf 0.1..inf pass 0.1..0.7 50..inf - 0.9
laughter synthesis 600..3500 1000..4000 0..inf 0.1..0.4 pass 0.15..0.7 - - 0.9
wide_stereo synthesis 0..inf 0..inf 0..inf 0..inf pass - - 0.25..inf 0.8
rich_texture texture 0..inf 2200..inf 0..inf 0..inf complexity=high - - - 0.6
pure_tone texture 0..inf 0..600 0..inf 0..inf pass - - - 0.6
bright_harmonics texture 0..inf 0..inf 5000..inf 0..inf pass - - - 0.6
warm_harmonics texture 0..inf 0..inf 0..2000 0..inf pass - - - 0.6
smooth_texture texture 400..2500 600..1800 0..inf 0..0.05 pass - - - 0.6
rough_texture texture 0..inf 1500..inf 0..inf 0.15..inf pass - - - 0.6
crystalline_texture texture 2500..inf 0..1000 4000..inf 0..0.06 pass - - - 0.6
organic_texture texture 0..inf 1200..inf 0..inf 0.08..0.2 pass - - - 0.6
mechanical_texture texture 1500..4000 1000..2500 3000..inf 0.1..0.3 pass - - - 0.6
liquid_texture texture 600..2200 800..2000 0..inf 0.02..0.12 pass - - - 0.6
gaseous_texture texture 1200..3500 1800..inf 0..inf 0.05..0.18 pass - - - 0.6
metallic_texture texture 2000..inf 1200..2800 3500..inf 0.08..0.25 pass - - - 0.6
wooden_texture texture 400..1600 800..2200 1200..3000 0.05..0.15 pass - - - 0.6
glassy_texture texture 3000..inf 400..1200 5000..inf 0..0.08 pass - - - 0.6
fabric_texture texture 600..1800 1000..2200 1500..3500 0.06..0.16 pass - - - 0.6
sandy_texture texture 1200..inf 1800..inf 0..inf 0.2..inf pass - - - 0.6
waxy_texture texture 800..2000 800..1600 1800..3500 0.03..0.1 pass - - - 0.6
rubbery_texture texture 1000..2800 1200..2400 2000..4000 0.08..0.2 pass - - - 0.6
ceramic_texture texture 1800..3500 600..1400 3000..5000 0.02..0.1 pass - - - 0.6
plastic_texture texture 1200..2800 600..1200 2200..4000 0..0.08 pass - - - 0.6
reverbed processing 0..inf 1200..inf 0..inf 0..inf pass - - - 0.6
delayed processing 0..inf 0..inf 0..inf 0..inf pass - - - 0.6
chorused processing 0..inf 1400..inf 0..inf 0.05..0.2 pass - - - 0.6
flanged processing 1000..inf 1500..inf 0..inf 0.1..0.3 pass - - - 0.6
phased processing 800..inf 1200..inf 0..inf 0.08..0.25 pass - - - 0.6
distorted processing 0..inf 1800..inf 0..inf 0.12..inf pass - - - 0.6
compressed processing 0..inf 0..inf 0..inf 0..inf pass - - - 0.6
filtered processing 0..inf 0..inf 0..inf 0..inf pass - - - 0.6
pitched processing 0..inf 1000..inf 0..inf 0..inf pass - - - 0.6
ring_modulated processing 1500..inf 1800..inf 3000..inf 0.15..inf pass - - - 0.6
bit_crushed processing 0..inf 1200..inf 0..8000 0.1..inf pass - - - 0.6
tape_saturated processing 400..2500 800..2200 0..6000 0..0.12 pass - - - 0.6
tube_saturated processing 600..3000 1000..2400 0..inf 0.02..0.15 pass - - - 0.6
multiband_processed processing 0..inf 1500..inf 0..inf 0..inf pass - - - 0.6
"""


def _range(text: str) -> tuple[float | None, float | None]:
    if text == "-":
        return None, None
    lo, hi = text.split("..")
    return float(lo), float(hi)


def moods() -> list[dict]:
    out = []
    for i, line in enumerate(MOODS.strip().splitlines()):
        name, category, energy, bright, rough, onset, duration, band = line.split()
        row = {"ord": i, "name": name, "category": category, "min_duration": float(duration)}
        for key, text in (("energy", energy), ("brightness", bright), ("roughness", rough), ("onset", onset), ("bandwidth", band)):
            row[f"{key}_lo"], row[f"{key}_hi"] = _range(text)
        out.append(row)
    return out


def tags() -> list[dict]:
    out = []
    for i, line in enumerate(TAGS.strip().splitlines()):
        name, category, centroid, band, rolloff, zcr, timbre, flatness, flux, stereo, threshold = line.split()
        row = {"ord": i, "name": name, "category": category, "timbre": timbre, "threshold": float(threshold)}
        for key, text in (("centroid", centroid), ("bandwidth", band), ("rolloff", rolloff), ("zcr", zcr), ("flatness", flatness), ("flux", flux), ("stereo", stereo)):
            row[f"{key}_lo"], row[f"{key}_hi"] = _range(text)
        out.append(row)
    return out


def as_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    kinds = {"ord": "int", "name": "string", "category": "string", "timbre": "string"}
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in rows[0]))


def as_values(rows: list[dict]) -> str:
    """The rows as a VALUES list of SQL."""
    def one(v) -> str:
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        if isinstance(v, str):
            return f"'{v}'"
        if isinstance(v, int):
            return str(v)
        return "CAST('Infinity' AS DOUBLE)" if v == float("inf") else f"CAST({v} AS DOUBLE)"

    return ", ".join("(" + ", ".join(one(v) for v in r.values()) + ")" for r in rows)


def problems(rows: list[dict]) -> list[str]:
    """Names of rules with a lower bound above the upper one."""
    return [r["name"] for r in rows for k in r if k.endswith("_lo") and r[k] is not None and r[k] > r[k[:-2] + "hi"]]


# Directed compatibility of keys, moods and characters.
KEY_EDGES = "C>G,F G>C,D D>G,A A>D,E E>A,B B>E,F# F#>B,C# C#>F#,G# F>C"
MOOD_EDGES = """
atmospheric>spacey,ethereal,oozy,pensive,warm spacey>atmospheric,ethereal,crystalline,pensive ethereal>atmospheric,spacey,crystalline,warm
oozy>atmospheric,warm,pensive,organic pensive>atmospheric,oozy,warm,melodic warm>pensive,oozy,organic,melodic organic>warm,oozy,melodic,driving
melodic>pensive,warm,organic,driving driving>melodic,organic,energetic,percussive energetic>driving,exuberant,percussive,tense
exuberant>energetic,driving,percussive tense>energetic,glitchy,chaos glitchy>tense,chaos,synthetic chaos>glitchy,tense
synthetic>crystalline,glitchy,driving crystalline>synthetic,ethereal,spacey percussive>driving,energetic,exuberant droning>atmospheric,oozy,warm
"""
CHARACTER_EDGES = """
analog_synth>digital_synth,warm_harmonics,pure_tone digital_synth>analog_synth,bright_harmonics,crystalline mellotron>organic,warm_harmonics,rich_texture
percussive_instrument>rhythmic,bright_harmonics acoustic_instrument>organic,warm_harmonics warm_harmonics>analog_synth,mellotron,organic
bright_harmonics>digital_synth,crystalline,percussive_instrument
"""


def edges(text: str) -> list[tuple[str, str]]:
    return [(part.split(">")[0], to) for part in text.split() for to in part.split(">")[1].split(",")]
