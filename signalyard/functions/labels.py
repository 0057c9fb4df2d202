"""Artifact names: canonical sets and one-hot rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that data sets use, and the ones they stand for.
CANONICAL = {"baseline": "wander", "baseline_wander": "wander", "wander": "wander", "emg": "muscle", "muscle": "muscle", "motion": "motion", "electrode": "electrode", "pop": "electrode", "clean": "clean"}


def canonical_types(kind: Column) -> Column:
    """The canonical names in a label: the whole label if it is known, else each part between underscores."""
    table = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    low = F.lower(F.trim(kind))
    parts = F.when(F.element_at(table, low).isNotNull(), F.array(low)).otherwise(F.split(low, "_"))
    return F.array_distinct(F.array_compact(F.transform(parts, lambda p: F.element_at(table, p))))


def multi_hot(types: Column, names: list[str]) -> Column:
    return F.array(*(F.array_contains(types, n).cast("int") for n in names))


#: Units and the modality they speak for.
UNITS = {"uv": "eeg", "µv": "eeg", "mv": "ecg", "us": "eda", "µs": "eda", "na": "ppg", "adu": "ppg", "nu": "ppg"}
#: Parts of channel names that speak for a modality.
NAMES = {"ecg": ("ecg", "ekg", "lead", "ii", "v1", "v5"), "ppg": ("ppg", "pleth", "bvp"), "eeg": ("eeg", "fp1", "fp2", "cz", "o1"), "eda": ("eda", "gsr", "scl")}
MODALITIES = ("ecg", "ppg", "eeg", "eda")
RATES = {"ecg": 250.0, "ppg": 64.0, "eeg": 256.0, "eda": 8.0}


def unit_modality(unit: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair)), F.lower(F.trim(unit)))


def modality_votes(unit: Column, name: Column, fs: Column) -> Column:
    """(modality, confidence): units count 3, parts of the name 2 and whole words 2 more, the nearest usual rate 0.5;
    confidence is the best's share, at most 0.35 if only the rate spoke. Ties go in the order of MODALITIES."""
    low = F.lower(name)
    words = F.split(low, "[^a-z0-9]+")
    gaps = {m: F.abs(F.ln(fs) - F.ln(F.lit(RATES[m]))) for m in MODALITIES}
    nearest = F.least(*gaps.values())

    def vote(m: str) -> Column:
        inside = F.lit(False)
        for t in NAMES[m]:
            if len(t) > 2:
                inside = inside | F.contains(low, F.lit(t))
        whole = F.arrays_overlap(words, F.array(*map(F.lit, NAMES[m])))
        told = F.when(F.coalesce(unit_modality(unit) == m, F.lit(False)), 3.0).otherwise(0.0) + F.when(inside, 2.0).otherwise(0.0) + F.when(whole, 2.0).otherwise(0.0)
        return F.struct(told.alias("told"), (told + F.when(gaps[m] == nearest, 0.5).otherwise(0.0)).alias("all"), F.lit(-MODALITIES.index(m)).alias("place"), F.lit(m).alias("m"))

    votes = F.array(*(vote(m) for m in MODALITIES))
    best = F.array_max(F.transform(votes, lambda v: F.struct(v["all"], v["place"], v["m"])))
    total = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v["all"])
    told = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v["told"])
    share = best["all"] / total
    return F.struct(best["m"].alias("modality"), F.when(told == 0, F.least(share, F.lit(0.35))).otherwise(share).alias("confidence"))


#: Parts of channel names that are preferred for a modality.
PREFERRED = {"ecg": ("ii", "mlii", "ecg", "ekg", "lead"), "ppg": ("pleth", "ppg", "bvp", "pulse"), "eda": ("eda", "gsr", "scl", "scr"), "eeg": ("fpz", "fp1", "fp2", "cz", "eeg", "oz", "pz")}


def preferred_channel(channels: DataFrame, modality: str, key: str = "recording_id") -> DataFrame:
    """(key, channel): the first channel whose name holds a token of the modality, else the first."""
    low = F.lower("channel")
    told = F.lit(False)
    for token in PREFERRED.get(modality, ()):
        told = told | F.contains(low, F.lit(token))
    return channels.groupBy(key).agg(F.min_by("channel", F.struct((~told).alias("other"), "channel_index")).alias("channel"))


def open_warnings(votes: DataFrame, forced: Column, mismatch: float = 0.6, unsure: float = 0.4) -> DataFrame:
    """`votes` (modality, confidence) with flags: a forced modality against a vote that is sure, and a vote that is not."""
    against = forced.isNotNull() & (forced != F.col("modality")) & (F.col("confidence") >= mismatch)
    return votes.withColumn("mismatch", F.coalesce(against, F.lit(False))).withColumn("unsure", F.col("confidence") < unsure)
