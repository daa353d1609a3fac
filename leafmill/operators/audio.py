"""Figures of audio segments: loudness, trimming, validity, tempo."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the audio checks.
SILENT_RMS, SILENT_SAMPLE, TAIL_SECONDS = 0.005, 0.01, 0.3
MIN_BYTES, MIN_SECONDS = 1024, 0.5


def rms(samples: Column) -> Column:
    squares = F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(squares / F.size(samples))).otherwise(0.0)


def is_audible(samples: Column) -> Column:
    return rms(samples) > SILENT_RMS


def trim_silence(samples: Column, rate: Column) -> Column:
    """Samples up to the last loud one and a tail of 0.3 s (the end is exclusive); all if none is loud."""
    loud = F.filter(F.transform(samples, lambda v, i: F.when(F.abs(v) > SILENT_SAMPLE, i)), lambda i: i.isNotNull())
    end = F.least(F.size(samples), F.array_max(loud) + (rate * TAIL_SECONDS).cast("int"))
    return F.when(F.size(loud) == 0, samples).otherwise(F.slice(samples, F.lit(1), F.greatest(end, F.lit(0))))


def is_valid(size: Column, has_stream: Column, seconds: Column) -> Column:
    return F.coalesce((size >= MIN_BYTES) & has_stream & (seconds >= MIN_SECONDS), F.lit(False))


def tempo_chain(speed: Column) -> Column:
    """Filter chain of a tempo: factors within 0.5 to 2; a speed that isn't positive raises an error."""
    speed = F.when(speed > 0, speed.cast("double")).otherwise(F.raise_error(F.lit("speed must be positive")).cast("double"))
    spare = lambda x: F.greatest(F.ceil(F.log2(x) - 1e-12).cast("int") - 1, F.lit(0))  # noqa: E731  factors beyond the first
    doubled, halved = spare(speed), spare(1 / speed)
    rest = F.format_string("%.4f", speed / F.pow(F.lit(2.0), doubled) * F.pow(F.lit(2.0), halved))
    factors = F.concat(F.array_repeat(F.lit("2.0000"), doubled), F.array_repeat(F.lit("0.5000"), halved), F.array(rest))
    return F.concat_ws(",", F.transform(factors, lambda x: F.concat(F.lit("atempo="), x)))
