"""Signal features of a waveform in numpy: short-time spectra and what is derived from them."""

from __future__ import annotations

import functools

import numpy as np

N_FFT, HOP, N_MELS, N_MFCC = 2048, 512, 128, 13
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def frames(y: np.ndarray) -> np.ndarray:
    """Overlapping frames without padding; a signal shorter than one frame has none."""
    if len(y) < N_FFT:
        return np.empty((0, N_FFT))
    return np.lib.stride_tricks.sliding_window_view(np.asarray(y, float), N_FFT)[::HOP]


@functools.cache
def frequencies(sr: int) -> np.ndarray:
    return np.fft.rfftfreq(N_FFT, 1 / sr)


@functools.cache
def mel_filters(sr: int) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale 2595 log10(1 + f / 700)."""
    top = 2595 * np.log10(1 + sr / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, N_MELS + 2) / 2595) - 1)
    f = frequencies(sr)[None, :]
    lo, mid, hi = edge[:-2, None], edge[1:-1, None], edge[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))


@functools.cache
def cosine_basis() -> np.ndarray:
    k, n = np.arange(N_MFCC)[:, None], np.arange(N_MELS)[None, :]
    out = np.cos(np.pi * k * (2 * n + 1) / (2 * N_MELS)) * np.sqrt(2 / N_MELS)
    out[0] /= np.sqrt(2)
    return out


@functools.cache
def pitch_classes(sr: int) -> np.ndarray:
    """Which of the 12 pitch classes each bin is nearest to; bins under 20 Hz are none."""
    f = frequencies(sr)
    out = np.zeros((12, len(f)))
    at = np.flatnonzero(f >= 20)
    out[np.round(12 * np.log2(f[at] / 440) + 9).astype(int) % 12, at] = 1
    return out


@functools.cache
def tonal_centroids() -> np.ndarray:
    """12 x 6 basis of fifths, minor and major thirds."""
    k = np.arange(12)[:, None]
    return np.hstack([np.hstack([r * np.sin(k * a * np.pi), r * np.cos(k * a * np.pi)]) for a, r in ((7 / 6, 1.0), (3 / 2, 1.0), (2 / 3, 0.5))]) / np.sqrt(6)


def magnitudes(y: np.ndarray) -> np.ndarray:
    x = np.fft.rfft(frames(y) * np.hanning(N_FFT), axis=1)
    return np.sqrt(x.real**2 + x.imag**2 + 1e-8)


def frame_table(y: np.ndarray, sr: int) -> dict[str, np.ndarray]:
    """Per frame: time, energy, centroid, rolloff, bandwidth, roughness, crossings, chroma spread."""
    fr, m, f = frames(y), magnitudes(y), frequencies(sr)
    if not len(m):
        return {}
    total = m.sum(axis=1) + 1e-8
    centroid = m @ f / total
    cum = np.cumsum(m, axis=1)
    chroma = m @ pitch_classes(sr).T
    p = chroma / (chroma.sum(axis=1, keepdims=True) + 1e-6)
    return {
        "t": (np.arange(len(m)) * HOP + N_FFT / 2) / sr,
        "energy": np.sqrt((fr**2).mean(axis=1)),
        "brightness": centroid,
        "rolloff": f[(cum >= 0.85 * cum[:, -1:]).argmax(axis=1)],
        "bandwidth": np.sqrt((m / total[:, None] * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1) + 1e-8),
        "roughness": np.abs(np.diff(m, axis=1)).mean(axis=1),
        "zcr": np.abs(np.diff(np.sign(fr), axis=1)).mean(axis=1) / 2,
        "chroma_spread": -(p * np.log(p + 1e-12)).sum(axis=1) / np.log(12),
        "flux": np.concatenate([[0.0], (np.diff(m, axis=0) ** 2).mean(axis=1)]),
    }


def onset_envelope(m: np.ndarray) -> np.ndarray:
    """Rise of the logarithmic spectrum from frame to frame."""
    return np.maximum(np.diff(np.log1p(m), axis=0), 0).mean(axis=1) if len(m) > 1 else np.empty(0)


def tempo_and_onsets(m: np.ndarray, sr: int) -> tuple[float, np.ndarray]:
    """Beats per minute by autocorrelation of the onset envelope within 30..300, and onset times by peaks of it."""
    env = onset_envelope(m)
    if len(env) < 8 or env.std() < 1e-9:
        return 0.0, np.empty(0)
    e = env - env.mean()
    n = 1 << (2 * len(e) - 1).bit_length()
    ac = np.fft.irfft(np.abs(np.fft.rfft(e, n)) ** 2)[: len(e)]
    lo, hi = max(1, int(sr / HOP * 60 / 300)), min(len(e) - 1, int(sr / HOP * 60 / 30))
    bpm = 60 * sr / HOP / (lo + int(ac[lo : hi + 1].argmax())) if hi >= lo else 0.0
    peak = (env[1:-1] > env[:-2]) & (env[1:-1] >= env[2:]) & (env[1:-1] > env.mean() + env.std())
    return float(bpm), (np.flatnonzero(peak) + 2) * HOP / sr


def beats(m: np.ndarray, sr: int, bpm: float, tightness: float = 100.0) -> np.ndarray:
    """Beat times by dynamic programming (Ellis 2007): beats lie on strong onsets and about a period apart.

    The best chain of beats that ends at a frame is its onset strength and the best chain before it, less the squared
    logarithm of how far their distance is off the period. Weak beats at both ends go.
    """
    env = onset_envelope(m)
    if bpm <= 0 or len(env) < 8 or env.std() < 1e-9:
        return np.empty(0)
    period = 60 * sr / HOP / bpm
    gaps = np.arange(max(1, round(period / 2)), round(2 * period) + 1)
    cost = tightness * np.log(gaps / period) ** 2
    strength = env / env.std()
    total, back = strength.copy(), np.full(len(env), -1)
    for t in range(int(gaps[0]), len(env)):
        k = min(len(gaps), t - int(gaps[0]) + 1)
        chain = total[t - gaps[:k]] - cost[:k]
        best = int(chain.argmax())
        if chain[best] > 0:
            total[t] += chain[best]
            back[t] = t - gaps[best]
    at = len(env) - 1 - int(total[::-1][: max(1, round(period))].argmax())
    chain = []
    while at >= 0:
        chain.append(at)
        at = int(back[at])
    chain = np.array(chain[::-1])
    strong = np.flatnonzero(strength[chain] >= 0.5 * np.sqrt((strength[chain] ** 2).mean()))
    return (chain[strong[0] : strong[-1] + 1] + 1) * HOP / sr if len(strong) else np.empty(0)


def tensor_profile(y: np.ndarray) -> dict[str, float]:
    """Features of a whole signal by one transform, in bins and not in Hz: a profile of its own, not to be mixed with the others.

    The signal is scaled to its peak and freed of its offset; its length counts the samples that are not zero. Crossings
    count each change of sign twice, and the rolloff is where 90 % of the magnitudes lie.
    """
    y = np.asarray(y, float) / (np.abs(y).max(initial=0) + 1e-8)
    y = y - y.mean() if len(y) else y
    y = y[: np.count_nonzero(y)]
    names = ("tensor_centroid", "tensor_rolloff", "tensor_bandwidth", "tensor_crossings", "tensor_rms", "tensor_peak", "tensor_range")
    if len(y) < 2:
        return dict.fromkeys(names, 0.0)
    m = np.abs(np.fft.rfft(y))[: len(y) // 2]
    at, total = np.arange(len(m)), m.sum() + 1e-8
    centroid = at @ m / total
    cum = np.cumsum(m)
    values = (centroid, int((cum >= 0.9 * cum[-1]).argmax()), np.sqrt(((at - centroid) ** 2 * m).sum() / total), np.abs(np.diff(np.sign(y))).sum() / len(y), np.sqrt((y**2).mean()), np.abs(y).max(), np.ptp(y))
    return {n: float(v) for n, v in zip(names, values, strict=True)}


def window_table(y: np.ndarray, sr: int, first: int = 0) -> dict[str, list]:
    """Windows of two seconds over the spectra of a signal: time of the middle frame, energy, brightness, roughness, crossings,
    strongest pitch class and how evenly the pitch classes share. A last window of under half a window goes. first: number of the first frame."""
    m, f = magnitudes(y), frequencies(sr)
    size = -(-2 * sr // HOP)
    out: dict[str, list] = {k: [] for k in ("time", "energy", "brightness", "roughness", "zcr", "chroma_peak", "chroma_spread")}
    for lo in range(0, len(m), size):
        part = m[lo : lo + size]
        if len(part) < size // 2:
            break
        mean = part.mean(axis=0)
        chroma = pitch_classes(sr) @ mean
        p = chroma / chroma.sum() if chroma.sum() >= 1e-9 else None
        raw = y[lo * HOP : (lo + len(part)) * HOP]
        row = (
            ((first + lo + len(part) // 2) * HOP + N_FFT / 2) / sr, np.sqrt((part**2).mean()), f @ mean / mean.sum() if mean.sum() >= 1e-9 else 0.0, np.abs(np.diff(part, axis=1)).mean(),
            np.abs(np.diff(np.sign(raw))).mean() / 2 if len(raw) > 1 else 0.0, KEYS[int(chroma.argmax())], float(np.clip(-(p * np.log(p + 1e-9)).sum() / np.log(12), 0, 1)) if p is not None else 0.5,
        )
        for k, v in zip(out, row, strict=True):
            out[k].append(v if isinstance(v, str) else float(v))
    return out


def features(y: np.ndarray, sr: int, stereo: np.ndarray | None = None) -> dict[str, float | str] | None:
    """The feature record of a track, or None if it is shorter than a frame. stereo: two channels as rows."""
    m, table = magnitudes(y), frame_table(y, sr)
    if not len(m):
        return None
    chroma = m @ pitch_classes(sr).T
    chroma = (chroma / (chroma.sum(axis=1, keepdims=True) + 1e-6)).mean(axis=0)
    mfcc = np.log(m @ mel_filters(sr).T + 1e-6) @ cosine_basis().T
    power = m**2
    tempo, _ = tempo_and_onsets(m, sr)
    out: dict[str, float | str] = {
        "duration": len(y) / sr,
        "spectral_centroid_mean": table["brightness"].mean(), "spectral_centroid_std": table["brightness"].std(),
        "spectral_rolloff_mean": table["rolloff"].mean(), "spectral_bandwidth_mean": table["bandwidth"].mean(),
        "zero_crossing_rate_mean": table["zcr"].mean(), "spectral_flatness_mean": (np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)).mean(),
        "spectral_flux_mean": table["flux"][1:].mean() if len(m) > 1 else 0.0, "spectral_roughness": table["roughness"].mean(),
        "rms_mean": table["energy"].mean(), "rms_std": table["energy"].std(), "tempo": tempo, "onset_density": len(beats(m, sr, tempo)) * sr / len(y),
        "key": KEYS[int(chroma.argmax())], "key_confidence": chroma.max(),
    }
    out |= {f"mfcc_{i + 1}_{n}": v for i in range(N_MFCC) for n, v in (("mean", mfcc[:, i].mean()), ("std", mfcc[:, i].std() + 1e-8))}
    out |= {f"chroma_{k}_mean": v for k, v in zip(KEYS, chroma, strict=True)}
    out |= {f"tonnetz_{i + 1}_mean": v for i, v in enumerate(chroma @ tonal_centroids())}
    out["stereo_width"] = float(np.abs(stereo[0] - stereo[1]).mean() / (np.abs(stereo[0] + stereo[1]).mean() + 1e-8)) if stereo is not None else 0.0
    return {k: v if isinstance(v, str) else float(v) for k, v in out.items()}
