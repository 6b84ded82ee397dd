"""Offline and online decoding: windows, features, a fitted scaler and model, predictions and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators import metrics, windows
from ..operators.decoder import Decoder


def measured_rate(samples: DataFrame) -> float:
    """Samples a second, from the mean of all recordings' mean intervals; one number."""
    return 1.0 / windows.sampling_freq(samples, "recording_id").agg(F.avg("interval")).first()[0]


def window_features(samples: DataFrame, names: list[str], milliseconds: float, step: float, channels: tuple[str, ...] = ("value",), label: str = "label", fs: float | None = None) -> DataFrame:
    """recording_id, window_id, label and the features of full windows, sized by the measured sampling rate unless ``fs`` is given."""
    fs = fs or measured_rate(samples)
    cut = windows.sliding_windows(samples, windows.window_samples(milliseconds, fs), windows.window_samples(step, fs), channels, label)
    return feats.extract(cut, names, channels)


def offline_decoding(rows: DataFrame, is_test, fit: Callable[[DataFrame], Decoder]) -> tuple[Decoder, DataFrame, DataFrame]:
    """A decoder fitted to the feature rows that aren't test rows, the predictions for those that are, and their scores."""
    decoder = fit(rows.filter(~is_test))
    predictions = decoder.predict(rows.filter(is_test))
    return decoder, predictions, metrics.scores(predictions)
