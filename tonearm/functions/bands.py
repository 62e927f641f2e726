"""Profile bands and derived measures of one track (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tonearm.functions.vectors import clip
from tonearm.schemas import KEY_NAMES


def texture(c) -> Column:
    return (
        F.when((c("spectral_flatness") > 0.18) | ((c("zero_crossing_rate") > 0.14) & (c("aggression") > 0.58)),
               "noisy-distorted")
        .when((c("percussive_ratio") > 0.56) & (c("brightness") > 0.42), "bright-percussive")
        .when((c("harmonic_ratio") > 0.64) & (c("brightness") < 0.38), "warm-harmonic")
        .when((c("rms_energy") < 0.08) & (c("brightness") > 0.35), "airy-sparse")
        .otherwise("dense-balanced")
    )


def tempo_band(c) -> Column:
    bpm = c("bpm")
    return (F.when(bpm < 70, "slow-drift").when(bpm < 96, "measured-groove").when(bpm < 126, "mid-pulse")
            .when(bpm < 156, "fast-drive").otherwise("high-velocity"))


def intensity(c) -> Column:
    return (F.when(c("aggression") > 0.72, "ferocious")
            .when((c("energy") > 55) | (c("aggression") > 0.55), "driving")
            .when(c("energy") > 28, "restrained").otherwise("low-intensity"))


def rhythm_character(c) -> Column:
    return (F.when((c("onset_density") > 3.6) & (c("percussive_ratio") > 0.48), "rhythm-forward")
            .when(c("beat_regularity") > 0.72, "steady-pulse")
            .when(c("onset_density") < 1.2, "sparse-rhythm").otherwise("loose-flow"))


def harmonic_character(c) -> Column:
    return (F.when(c("tonal_strength") < 0.16, "tonally-ambiguous")
            .when((c("mode") == "minor") & (c("valence") < 0.57), "dark-minor")
            .when(c("mode") == "major", "bright-major").otherwise("harmonically-rich"))


BANDS = {"intensity": intensity, "texture": texture, "rhythm_character": rhythm_character,
         "harmonic_character": harmonic_character, "tempo_band": tempo_band}


def bands(c) -> dict[str, Column]:
    """All five bands and the signature; ``c(name)`` returns a measure column."""
    out = {name: build(c) for name, build in BANDS.items()}
    out["acoustic_signature"] = F.concat_ws(" · ", *out.values())
    return out


def chord_score(chroma: Column, intervals) -> Column:
    """Best triad sum over the 12 roots."""
    doubled = F.concat(chroma, chroma)
    pick = lambda root: sum((doubled[root + i] for i in intervals[1:]), doubled[root + intervals[0]])
    return F.array_max(F.array(*[pick(root) for root in range(12)]))


def key_name(chroma: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KEY_NAMES])
    return F.element_at(names, F.array_position(chroma, F.array_max(chroma)).cast("int"))


def derived(c, tonal_width: float = 0.10) -> dict[str, Column]:
    """Measures that follow from the raw ones: needs chroma, rms_energy, spectral_centroid_hz, bpm,
    beat_regularity, percussive_ratio, tempo_confidence, zero_crossing_rate."""
    raw = c("chroma")
    scale = F.greatest(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x), F.lit(1e-10))
    chroma = F.transform(raw, lambda x: x / scale)
    major, minor = chord_score(chroma, (0, 4, 7)), chord_score(chroma, (0, 3, 7))
    brightness = clip(c("spectral_centroid_hz") / 5000)
    rms, zcr, perc = c("rms_energy"), c("zero_crossing_rate"), c("percussive_ratio")
    fit = F.exp(-F.abs(c("bpm") - 118) / 48)
    return {
        "chroma": chroma,
        "mode": F.when(major >= minor, "major").otherwise("minor"),
        "key": key_name(chroma),
        "valence": clip(0.35 + 0.4 * major / F.greatest(major + minor, F.lit(1e-10))),
        "energy": clip(rms * 400, 0.0, 100.0),
        "brightness": brightness,
        "tonal_strength": clip((F.array_max(chroma) - 1 / 12) / tonal_width),
        "danceability": clip(0.35 * fit + 0.30 * c("beat_regularity") + 0.20 * perc + 0.15 * c("tempo_confidence")),
        "aggression": clip(0.30 * F.least(rms * 5, F.lit(1.0)) + 0.25 * F.least(zcr / 0.18, F.lit(1.0))
                           + 0.25 * brightness + 0.20 * perc),
    }


def mood_colour(signature, subgenre, energy, valence) -> Column:
    """First matching colour of an ordered keyword/threshold list."""
    words = F.lower(F.concat_ws(" ", F.coalesce(signature, F.lit("")), F.coalesce(subgenre, F.lit(""))))
    e, v = F.coalesce(energy, F.lit(50.0)), F.coalesce(valence, F.lit(0.5))
    # fixed values: keyword patterns per colour
    return (
        F.when(words.rlike("aggressive|ferocious|extreme|metalcore|death|industrial|hardcore|nu metal|dense-noisy|noisy-distorted")
               | (e >= 82), "black")
        .when(words.rlike("dark|minor|melanch|sad|goth|doom|restrained") | (v < 0.32), "blue")
        .when(words.rlike("ambient|airy|sparse|minimal|ethereal") | (e < 28), "white")
        .when(words.rlike("psychedelic|experimental|dream|mystery|art rock|progressive"), "purple")
        .when(words.rlike("folk|organic|country|roots|earth|gentle"), "green")
        .when(words.rlike("soul|warm|blues|jazz|classic|harmonic"), "brown")
        .when(words.rlike("bright|dance|pop|funk|rhythm-forward|upbeat") | (v > 0.68), "yellow")
        .otherwise("red")
    )
