"""Spectrograms and their robust baselines.

A tile row holds one channel of one tile: keys, and its samples, or its spectrogram as a matrix of frames. The Fourier transform and the
statistics of a matrix are small functions over Arrow batches of such rows, without a shuffle; only one number per channel and bin
is shuffled, for the baseline that runs across the channels of a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydrift.functions import exprs as X

_ARRAY = T.ArrayType(T.DoubleType())


def window_values(size: int, kind: str) -> np.ndarray:
    """The symmetric window as an array."""
    return {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman}.get(kind.lower(), np.ones)(size)


def stft_power(samples: np.ndarray, nfft: int, hop: int, kind: str) -> np.ndarray:
    """Power (frames, bins in ascending frequency) of complex samples, their mean taken off; the tail is dropped."""
    x = samples - samples.mean()
    n = 1 + (len(x) - nfft) // hop
    frames = np.lib.stride_tricks.sliding_window_view(x, nfft)[::hop][:n] * window_values(nfft, kind)
    return np.abs(np.fft.fftshift(np.fft.fft(frames, axis=1), axes=1)) ** 2


def spectrograms(tiles: DataFrame, keys: list[str], nfft: int, hop: int, kind: str = "hann") -> DataFrame:
    """(keys, matrix array<array<double>>), the powers by frame and bin, of tile rows with arrays ``i`` and ``q``. Tiles shorter than nfft
    fail: tiles must overlap by at least nfft rows."""
    fields = ", ".join(f"`{k}` {t}" for k, t in tiles.dtypes if k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, q in zip(pdf["i"], pdf["q"]):
                x = np.asarray(i, float) + 1j * np.asarray(q, float)
                if len(x) < nfft:
                    raise ValueError(f"a tile of {len(x)} rows is shorter than nfft {nfft}")
                out.append(list(stft_power(x, nfft, hop, kind)))
            yield pdf[keys].assign(matrix=out)

    return tiles.select(*keys, "i", "q").mapInPandas(run, f"{fields}, matrix array<array<double>>")


def stft(tiles: DataFrame, keys: list[str], nfft: int, hop: int, kind: str = "hann") -> DataFrame:
    """(keys, frame, power array<double>) of the same."""
    return spectrograms(tiles, keys, nfft, hop, kind).select(*keys, F.posexplode("matrix").alias("frame", "power"))


def matrices(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, matrix) of frames with an array ``power``."""
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col("power").cast("array<double>").alias("power"))))
    return frames.groupBy(*keys).agg(F.transform(ordered, lambda x: x["power"]).alias("matrix"))


def bins(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, bin, p) of frames with an array ``power``."""
    return frames.select(*keys, "frame", F.posexplode("power").alias("bin", "p")).withColumn("p", F.col("p").cast("double"))


def by_bin(df: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """(keys, bin, arrays): one row per element of arrays of the same length."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("bin", "x"))
    return rows.select(*keys, "bin", *[F.col(f"x.{c}").alias(c) for c in arrays])


def running_median(values: np.ndarray, size: int) -> np.ndarray:
    """Centred running median, edges repeated; size is made odd and not more than the length."""
    n = len(values)
    size = min(max(3, size | 1), n if n % 2 else n - 1) if n > 2 else 1
    if size < 3:
        return values.copy()
    padded = pd.Series(np.pad(values, size // 2, mode="edge"))
    return padded.rolling(size).median().to_numpy()[size - 1:]


@F.pandas_udf(_ARRAY)
def _median_db(matrix: pd.Series) -> pd.Series:
    return pd.Series([10 * np.log10(np.median(np.stack(m), axis=0) + X.EPS) for m in matrix])


@F.pandas_udf(T.StructType([T.StructField(n, _ARRAY) for n in ("mean_db", "max_db", "p90_db")]))
def _stats_db(matrix: pd.Series) -> pd.DataFrame:
    out = []
    for m in matrix:
        m = np.stack(m)
        out.append([10 * np.log10(v + X.EPS) for v in (m.mean(axis=0), m.max(axis=0), np.percentile(m, 90, axis=0))])
    return pd.DataFrame(out, columns=["mean_db", "max_db", "p90_db"])


def bin_medians(m: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, med_db): median over frames of each bin, in dB."""
    return m.select(*keys, _median_db("matrix").alias("med_db"))


def smooth(medians: DataFrame, tile: list[str], channel: str, size: int) -> DataFrame:
    """Adds base_db, the running median along channel and bin within a tile; the window crosses channel borders.

    A tile's medians are one number per channel and bin, whatever the length of the recording.
    """
    fields = ", ".join(f"`{k}` {t}" for k, t in medians.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(channel)
        level = running_median(np.concatenate(pdf["med_db"].to_list()), size)
        return pdf.assign(base_db=np.split(level, np.cumsum([len(v) for v in pdf["med_db"]])[:-1]))

    return medians.groupBy(*tile).applyInPandas(run, f"{fields}, base_db array<double>")


def normalise(m: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, norm): matrices over the baselines of their bins."""
    level = F.transform("base_db", lambda b: X.ratio(b) + X.EPS)
    both = m.join(base.select(*keys, level.alias("level")), keys)
    return both.select(*keys, F.transform("matrix", lambda f: F.zip_with(f, "level", lambda p, b: p / b)).alias("norm"))


def bin_stats(norm: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, norm, mean_db, max_db, p90_db): statistics of the normalised power over frames, by bin."""
    return norm.select(*keys, "norm", _stats_db("norm").alias("s")).select(*keys, "norm", "s.*")


def inner_bins(df: DataFrame, nfft: int, edge: int) -> DataFrame:
    """Rows whose bin isn't at the edge of its channel."""
    return df.where((F.col("bin") >= edge) & (F.col("bin") < nfft - edge))


def qc_display(frames: DataFrame, tile: list[str], channel: str, size: int, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Display matrix (keys, frame, bin, db), flattened in frequency and in time, and its range (tile, low_db, high_db)."""
    keys = [*tile, channel]
    level = by_bin(smooth(bin_medians(matrices(frames, keys), keys), tile, channel, size), keys, "base_db")
    flat = bins(frames, keys).join(level, [*keys, "bin"]).withColumn("d", X.db(F.col("p")) - F.col("base_db"))
    mid = flat.groupBy(*tile, "frame").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    out = flat.join(mid, [*tile, "frame"]).select(*keys, "frame", "bin", (F.col("d") - F.col("m")).alias("db"))
    limits = out.groupBy(*tile).agg(F.percentile("db", F.lit(low / 100)).alias("low_db"), F.percentile("db", F.lit(high / 100)).alias("high_db"))
    return out, limits
