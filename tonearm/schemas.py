"""Table schemas (the fixed shapes of the data model)."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


PROFILE_NUMERIC = [
    "bpm", "energy", "brightness", "spectral_centroid_hz", "spectral_rolloff_hz", "zero_crossing_rate",
    "tempo_confidence", "spectral_flatness", "spectral_contrast", "onset_density", "beat_regularity",
    "dynamic_range", "harmonic_ratio", "percussive_ratio", "tonal_strength", "danceability", "aggression",
]
PROFILE_TEXT = [
    "key", "mode", "timbre", "texture", "tempo_band", "intensity", "rhythm_character", "harmonic_character",
    "acoustic_signature", "analysis_source",
]
PROFILE = T.StructType(
    [T.StructField(n, DBL, True) for n in PROFILE_NUMERIC] + [T.StructField(n, STR, True) for n in PROFILE_TEXT]
)

TRACKS = _struct(
    track_id=STR, title=STR, artist=STR, album=STR, provider_genre=STR, provider_subgenre=STR, seed_genre=STR,
    year=INT, duration_ms=INT, artwork_url=STR, external_url=STR, source=STR, preview_url=STR,
)

# Column, profile, event and mode names and the vector size are fixed values of the data contract.
KEY_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
VECTOR_SIZE = 35

EVENT_TYPES = [
    "selected", "preview_started", "preview_completed", "youtube_opened", "liked", "disliked", "dismissed",
]
POSITIVE_EVENTS = ["liked", "preview_completed", "youtube_opened"]
NEGATIVE_EVENTS = ["disliked", "dismissed"]
MODES = ["similar", "rhythm", "timbre", "discover", "personalized", "transition"]
THEME_POOLS = [
    "loss_longing", "self_identity", "joy_celebration", "nostalgia_memory", "anxiety_darkness", "romance_new",
    "empowerment", "spirituality", "social", "bittersweet",
]
