"""Audio files as tables: scan, decode, clean up, frames and features. One Python pass per file."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal

SUFFIX = r"\.(wav|aiff?|mp3)$"
GLOB = "*.{[wW][aA][vV],[aA][iI][fF],[aA][iI][fF][fF],[mM][pP]3}"
#: Seconds of sound that are looked at together, of a chunk of features, and that two of these share.
CHUNK_S, FEATURE_CHUNK_S, SHARED_S = 30, 30, 1
#: Bytes of a file that its format is read from.
HEADER_BYTES = 1 << 16
# What an estimate assumes of a library.
MINUTES_PER_FILE, SECONDS_PER_MINUTE, MANY_FILES = 3.0, 2.0, 50


class AudioError(ValueError):
    """A file that can't be decoded or used."""


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty audio files of a folder, not of folders in it. Other files are not listed, so their contents are never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(path).where("length > 0").withColumn("filename", F.element_at(F.split("path", "/"), -1))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, length, content) of the non-empty audio files of a folder, once each."""
    return _files(spark, path).select("path", "filename", "length", "content")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, length) in the order of paths, without contents."""
    return _files(spark, path).select("path", "filename", "length").orderBy("path")


def _pcm(data: bytes, bits: int, big: bool, floating: bool, signed8: bool) -> np.ndarray:
    order = ">" if big else "<"
    if floating:
        return np.frombuffer(data, f"{order}f{bits // 8}").astype(float)
    if bits == 8:
        return np.frombuffer(data, np.int8).astype(float) / 128 if signed8 else (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    if bits == 24:
        b = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        b = b[:, ::-1] if big else b
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return (v - ((v & 0x800000) << 1)) / float(1 << 23)
    if bits in (16, 32):
        return np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"{order}i{bits // 8}").astype(float) / (1 << (bits - 1))
    raise AudioError(f"{bits} bits are not supported")


def _walk(data: bytes):
    """(name, size, content) of the chunks of a WAV or AIFF file, as far as data goes; the content may be cut off."""
    wav = _is_wav(data)
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack("<I" if wav else ">I", data[at + 4 : at + 8])[0]
        yield data[at : at + 4], size, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _is_wav(data: bytes) -> bool:
    wav = data[:4] == b"RIFF" and data[8:12] == b"WAVE"
    if not wav and not (data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC")):
        raise AudioError("neither WAV nor AIFF")
    return wav


def _format(name: bytes, chunk: bytes) -> tuple[int, int, int, bool, bool] | None:
    """(channels, rate, bits, big-endian, floating) if the chunk tells the format."""
    if name == b"fmt " and len(chunk) >= 16:
        code, n, rate, _, _, bits = struct.unpack("<HHIIHH", chunk[:16])
        code = struct.unpack("<H", chunk[24:26])[0] if code == 0xFFFE and len(chunk) >= 26 else code
        if code not in (1, 3):
            raise AudioError(f"coding {code} is not supported")
        return n, rate, bits, False, code == 3
    if name == b"COMM" and len(chunk) >= 18:
        n, _, bits = struct.unpack(">hIh", chunk[:8])
        exponent, mantissa = struct.unpack(">HQ", chunk[8:18])
        code = chunk[18:22] or b"NONE"
        if code not in (b"NONE", b"sowt", b"fl32"):
            raise AudioError(f"coding {code!r} is not supported")
        return n, round(mantissa * 2.0 ** (exponent - 16383 - 63)), bits, code != b"sowt", code == b"fl32"
    return None


def _body(data: bytes) -> tuple[tuple[int, int, int, bool, bool], bytes, bool]:
    """(format, samples as bytes, whether it is a WAV file)."""
    wav, head, body = _is_wav(data), None, None
    for name, _, chunk in _walk(data):
        head = _format(name, chunk) or head
        if name == b"data" and wav:
            body = chunk
        elif name == b"SSND" and not wav:
            body = chunk[8 + struct.unpack(">I", chunk[:4])[0] :]
    if head is None or body is None or head[0] < 1 or head[1] < 1:
        raise AudioError("no format or no samples")
    return head, body, wav


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """(channels x samples in -1..1, rate) of a PCM or float WAV or AIFF file."""
    (n, rate, bits, big, floating), body, wav = _body(data)
    x = _pcm(body, bits, big, floating, not wav)
    return x[: len(x) // n * n].reshape(-1, n).T, rate


class Reader:
    """Mono samples of a file, decoded slice by slice: memory holds the file's bytes and one slice."""

    def __init__(self, data: bytes):
        (self.channels, self.rate, self.bits, self.big, self.floating), body, self.wav = _body(data)
        self.body, self.step = memoryview(body), self.channels * self.bits // 8
        self.length = len(body) // self.step

    def samples(self, lo: int, hi: int) -> np.ndarray:
        part = bytes(self.body[max(lo, 0) * self.step : min(hi, self.length) * self.step])
        return _pcm(part, self.bits, self.big, self.floating, not self.wav).reshape(-1, self.channels).mean(axis=1)

    def slices(self, size: int):
        for lo in range(0, self.length, size):
            yield self.samples(lo, lo + size)

    def clean_up(self) -> tuple[float, float]:
        """(offset, factor) of a usable signal, as `cleaned` applies them; AudioError for others."""
        if self.length == 0 or self.length < self.rate:
            raise AudioError("shorter than a second")
        total, least, most = 0.0, np.inf, -np.inf
        for part in self.slices(CHUNK_S * self.rate):
            if not np.isfinite(part).all():
                raise AudioError("not finite")
            total, least, most = total + part.sum(), min(least, part.min()), max(most, part.max())
        if max(abs(least), abs(most)) < 1e-6:
            raise AudioError("silent")
        mean = total / self.length
        return mean, 0.9 / max(abs(least - mean), abs(most - mean), 1e-300)


def header(data: bytes) -> tuple[int, int, int, float]:
    """(channels, rate, bits, seconds) from the first bytes of a WAV or AIFF file, without its samples."""
    wav, head, size = _is_wav(data), None, None
    for name, length, chunk in _walk(data):
        head = _format(name, chunk) or head
        if name == (b"data" if wav else b"SSND"):
            size = length if wav else length - 8
    if head is None or size is None or min(head[:3]) < 1:
        raise AudioError("no format or no samples")
    n, rate, bits, *_ = head
    return n, rate, bits, size / (n * bits // 8) / rate


def cleaned(y: np.ndarray, sr: int) -> np.ndarray:
    """A usable mono signal without offset, at a peak of 0.9; AudioError if it is empty, short, not finite or silent."""
    if not len(y) or len(y) < sr:
        raise AudioError("shorter than a second")
    if not np.isfinite(y).all():
        raise AudioError("not finite")
    if np.abs(y).max() < 1e-6:
        raise AudioError("silent")
    y = y - y.mean()
    return y * (0.9 / np.abs(y).max())


def metadata(files: DataFrame) -> DataFrame:
    """(filename, length, suffix, channels, rate, bits, duration, error) of every file.

    Only its first bytes reach Python, and the whole of a file whose format or data comes after them.
    """

    @F.udf("boolean")
    def told(head):
        try:
            header(bytes(head or b""))
        except AudioError as e:
            return str(e) == "neither WAV nor AIFF"
        return True

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(3):
                try:
                    rows.append((*header(data.as_py() or b""), None))
                except AudioError as e:
                    rows.append((None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["filename", "length", "suffix", "channels", "rate", "bits", "duration", "error"])

    first = files.select("filename", F.col("length").cast("long").alias("length"), F.lower(F.regexp_extract("filename", r"\.[^.]*$", 0)).alias("suffix"), F.substring("content", 1, HEADER_BYTES).alias("head"), "content")
    first = first.withColumn("told", told("head"))
    first = first.select("filename", "length", "suffix", F.when(F.col("told") | (F.octet_length("content") <= HEADER_BYTES), F.col("head")).otherwise(F.col("content")).alias("head"))
    return first.mapInArrow(run, "filename string, length long, suffix string, channels int, rate int, bits int, duration double, error string")


def estimate(files: DataFrame, minutes_per_file: float = MINUTES_PER_FILE, seconds_per_minute: float = SECONDS_PER_MINUTE) -> DataFrame:
    """(files, audio_minutes, seconds, advice) that a library will take, by its number of files."""
    n = F.count("*")
    r = files.agg(n.alias("files"), (n * minutes_per_file).alias("audio_minutes"), (n * minutes_per_file * seconds_per_minute).alias("seconds"))
    return r.withColumn("advice", F.when(F.col("files") == 0, "nothing to do").when(F.col("files") > MANY_FILES, "split into batches").otherwise("one run will do"))


def features(files: DataFrame) -> DataFrame:
    """(filename, error, features map, key) of every file: numbers of the raw signal, or why it was rejected."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                error = key = None
                got: dict = {}
                try:
                    x, sr = decode(data.as_py())
                    y = x.mean(axis=0)
                    cleaned(y, sr)
                    got = signal.features(y, sr, x[:2] if len(x) > 1 else None) or {}
                    key = got.pop("key", None)
                except AudioError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([error], pa.string()), pa.array([key], pa.string()), pa.array([list(got.items())], pa.map_(pa.string(), pa.float64()))], ["filename", "error", "key", "features"]
                )

    return files.select("filename", "content").mapInArrow(run, "filename string, error string, key string, features map<string,double>")


FRAME = ("t", "energy", "brightness", "rolloff", "bandwidth", "roughness", "zcr", "chroma_spread", "flux")


def chunked_frames(reader: Reader, chunk_s: int = CHUNK_S):
    """Frame tables of a cleaned file, a chunk at a time: numbers of the frames and their columns.

    A chunk begins at a whole frame and reaches as far as its last frame does; it begins one frame early, so that the flux of
    its first frame is known, and that frame is dropped again. So every frame comes once, as if the file were looked at whole.
    """
    offset, factor = reader.clean_up()
    count = max(0, (reader.length - signal.N_FFT) // signal.HOP + 1)
    step = max(1, chunk_s * reader.rate // signal.HOP)
    for lo in range(0, count, step):
        hi, early = min(lo + step, count), int(lo > 0)
        y = (reader.samples((lo - early) * signal.HOP, (hi - 1) * signal.HOP + signal.N_FFT) - offset) * factor
        table = {k: v[early:] for k, v in signal.frame_table(y, reader.rate).items()}
        yield np.arange(lo, hi), table | {"t": table["t"] + (lo - early) * signal.HOP / reader.rate}


def _readers(batch):
    for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        try:
            yield name, Reader(data.as_py())
        except AudioError:
            continue


def frames(files: DataFrame) -> DataFrame:
    """One row per frame of every usable file, of the cleaned signal, looked at in chunks of bounded size."""

    def run(batches):
        for batch in batches:
            for name, reader in _readers(batch):
                try:
                    for at, t in chunked_frames(reader):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), *[pa.array(t[c]) for c in FRAME]], ["filename", "frame_idx", *FRAME])
                except AudioError:
                    continue

    columns = ", ".join(f"{c} double" for c in FRAME)
    return files.select("filename", "content").mapInArrow(run, f"filename string, frame_idx long, {columns}")


def onsets(files: DataFrame) -> DataFrame:
    """(filename, t) of every onset of every usable file."""

    def run(batches):
        for batch in batches:
            for name, reader in _readers(batch):
                try:
                    offset, factor = reader.clean_up()
                except AudioError:
                    continue
                m = signal.magnitudes((reader.samples(0, reader.length) - offset) * factor)
                t = signal.tempo_and_onsets(m, reader.rate)[1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t), pa.string()), pa.array(t, pa.float64())], ["filename", "t"])

    return files.select("filename", "content").mapInArrow(run, "filename string, t double")


def trajectory(files: DataFrame) -> DataFrame:
    """(filename, rn, time, energy, brightness, roughness, zcr, chroma_peak, chroma_spread): a row for every two seconds of a
    usable file, from the spectra of its cleaned signal, a minute at a time."""
    columns = ("time", "energy", "brightness", "roughness", "zcr", "chroma_peak", "chroma_spread")

    def run(batches):
        for batch in batches:
            for name, reader in _readers(batch):
                try:
                    offset, factor = reader.clean_up()
                except AudioError:
                    continue
                size, rn = -(-2 * reader.rate // signal.HOP), 0
                count = max(0, (reader.length - signal.N_FFT) // signal.HOP + 1)
                for lo in range(0, count, 30 * size):  # whole windows
                    hi = min(lo + 30 * size, count)
                    t = signal.window_table((reader.samples(lo * signal.HOP, (hi - 1) * signal.HOP + signal.N_FFT) - offset) * factor, reader.rate, lo)
                    n = len(t["time"])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(rn, rn + n)), *[pa.array(t[c], pa.string() if c == "chroma_peak" else pa.float64()) for c in columns]], ["filename", "rn", *columns])
                    rn += n

    return files.select("filename", "content").mapInArrow(run, "filename string, rn long, " + ", ".join(f"{c} {'string' if c == 'chroma_peak' else 'double'}" for c in columns))


def _tables(files: DataFrame, rows_of, extra: str = "") -> DataFrame:
    """(filename, [extra], features map) of what rows_of gives for each reader."""
    names = [c.split()[0] for c in extra.split(", ") if c]

    def run(batches):
        for batch in batches:
            for name, reader in _readers(batch):
                rows = list(rows_of(reader))
                cols = [pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.float64()) for i in range(len(names))]
                maps = pa.array([list(r[-1].items()) for r in rows], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *cols, maps], ["filename", *names, "features"])

    return files.select("filename", "content").mapInArrow(run, f"filename string, {extra + ', ' if extra else ''}features map<string,double>")


def chunk_features(files: DataFrame, seconds: float = FEATURE_CHUNK_S, shared: float = SHARED_S) -> DataFrame:
    """(filename, chunk_index, chunk_start, chunk_end, features) of overlapping chunks; a chunk of under a second goes."""

    def rows(reader: Reader):
        step, size = round((seconds - shared) * reader.rate), round(seconds * reader.rate)
        for i, lo in enumerate(range(0, reader.length, step)):
            y = reader.samples(lo, lo + size)
            if len(y) >= reader.rate and (got := signal.features(y, reader.rate)):
                yield i, lo / reader.rate, (lo + len(y)) / reader.rate, {k: v for k, v in got.items() if k != "key"}

    return _tables(files, rows, "chunk_index int, chunk_start double, chunk_end double")


def tensor_features(files: DataFrame) -> DataFrame:
    """(filename, features) of the whole-signal profile."""
    return _tables(files, lambda reader: [(signal.tensor_profile(reader.samples(0, reader.length)),)])


def validate_payloads(df: DataFrame, least: int = 1000, most: int = 104_857_600) -> DataFrame:
    """df(filename, content: base64) with errors: every reason for which a payload is refused."""
    size = F.octet_length(F.expr("try_to_binary(content, 'base64')"))
    found = F.array(
        F.when(F.col("filename").isNull() | F.col("content").isNull(), "missing field"),
        F.when(~F.lower("filename").rlike(SUFFIX), "suffix"),
        F.when(F.col("content").isNotNull() & size.isNull(), "not base64"),
        F.when(size < least, "too small"),
        F.when(size > most, "too large"),
    )
    return df.withColumn("errors", F.array_compact(found))


def payloads(df: DataFrame) -> DataFrame:
    """The valid payloads of df as files."""
    ok = validate_payloads(df).where(F.size("errors") == 0)
    return ok.select("filename", F.expr("try_to_binary(content, 'base64')").alias("content"))


def sampled_frames(samples: DataFrame, sr: int) -> DataFrame:
    """Frame tables of samples(filename, i, x) at a rate: sound that comes as rows. A file's samples are one group, as its bytes are one value."""

    def one(frame):
        import pandas as pd

        y = frame.sort_values("i").x.to_numpy(float)
        t = signal.frame_table(y, sr)
        n = len(t["t"]) if t else 0
        name = pd.Series([frame.filename.iloc[0]] * n, dtype=object)
        return pd.DataFrame({"filename": name, "frame_idx": np.arange(n), **{c: t[c] if t else np.empty(0) for c in FRAME}})

    return samples.groupBy("filename").applyInPandas(one, "filename string, frame_idx long, " + ", ".join(f"{c} double" for c in FRAME))


def sampled_features(samples: DataFrame, sr: int, tensor: bool = False) -> DataFrame:
    """(filename, feature, value, key) of samples(filename, i, x, and y for a second channel) at a rate; with tensor the whole-signal profile."""

    def one(frame):
        import pandas as pd

        frame = frame.sort_values("i")
        x, other = frame.x.to_numpy(float), frame.y.to_numpy(float)
        got = signal.tensor_profile(x) if tensor else signal.features(x, sr, np.stack([x, other])) or {}
        key = got.pop("key", None)
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"filename": text([frame.filename.iloc[0]] * len(got)), "feature": text(list(got)), "value": np.array(list(got.values()), float), "key": text([key] * len(got))})

    return samples.groupBy("filename").applyInPandas(one, "filename string, feature string, value double, key string")
