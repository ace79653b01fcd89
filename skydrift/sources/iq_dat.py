"""Recordings of 16-bit I/Q words: a Spark data source, reading by parts, and writing.

A file has no header; a row is one time sample of all channels, two bytes each, the low one I and the high one Q. The
files must be in a folder that all executors see.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from skydrift.params import Contract

SCHEMA = "obs_id string, tile long, row0 long, row1 long, channel int, i array<tinyint>, q array<tinyint>"


@dataclass
class Tile(InputPartition):
    """One tile of an observation: its rows, and the parts of files that hold them."""

    obs_id: str
    tile: int
    row0: int
    row1: int
    parts: tuple[tuple[str, int, int], ...]


def file_rows(path: str, contract: Contract) -> int:
    """Rows of a file; fails if its length isn't a whole number of them."""
    size, row = Path(path).stat().st_size, contract.channels * contract.bytes_per_cell
    if contract.bytes_per_cell != 2 or size % row:
        raise ValueError(f"{path}: {size} bytes are no whole number of rows of {row}")
    return size // row


def read_words(parts, channels: list[int], contract: Contract) -> np.ndarray:
    """Words (rows, channels) of parts of files, in their order."""
    got = [np.memmap(p, dtype="<u2", mode="r").reshape(-1, contract.channels)[a:b][:, channels] for p, a, b in parts]
    return np.concatenate(got) if got else np.empty((0, len(channels)), np.uint16)


def split_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """I and Q of words."""
    b = np.ascontiguousarray(words).view(np.int8).reshape(*words.shape, 2)
    return b[..., 0], b[..., 1]


def join_words(i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Words of I and Q: rounded half to even and clipped to signed bytes."""
    both = np.stack([np.clip(np.rint(x), -128, 127).astype(np.int8) for x in (i, q)], axis=-1)
    return both.view("<u2")[..., 0]


def overlaps(segments: list[tuple[str, int]], row0: int, row1: int) -> tuple[tuple[str, int, int], ...]:
    """Parts (path, first, last) of files laid end to end that hold rows row0..row1; fails outside of them."""
    total = sum(n for _, n in segments)
    if not 0 <= row0 <= row1 <= total:
        raise ValueError(f"rows {row0}..{row1} of {total}")
    out, start = [], 0
    for path, n in segments:
        a, b = max(row0, start), min(row1, start + n)
        if a < b:
            out.append((path, a - start, b - start))
        start += n
    return tuple(out)


def tile_rows(total: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Rows of overlapping tiles; the last is cut at the end."""
    step, row0 = max(1, size - overlap), 0
    while total:
        yield row0, min(row0 + size, total)
        if row0 + size >= total:
            return
        row0 += step


class IqDatSource(DataSource):
    """format("iq_dat"): one partition per observation and tile, one row per channel.

    Options: observations (JSON list of {obs_id, dat_paths}), contract (JSON), tile_rows, overlap_rows, and channels (JSON list,
    in the wanted order). Filters on obs_id, tile and channel by = or IN keep tiles and channels from being read.
    """

    @classmethod
    def name(cls) -> str:
        return "iq_dat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IqDatReader:
        return IqDatReader(self.options)


class IqDatReader(DataSourceReader):
    def __init__(self, options):
        self.contract = Contract(**json.loads(options.get("contract", "{}")))
        self.observations = json.loads(options["observations"])
        self.size, self.overlap = int(options.get("tile_rows", 31250)), int(options.get("overlap_rows", 4096))
        self.channels = json.loads(options.get("channels", "null")) or list(range(self.contract.channels))
        if not all(0 <= c < self.contract.channels for c in self.channels):
            raise ValueError("a channel is out of range")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("obs_id", "tile", "channel"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                at = f.attribute[0]
                self.wanted[at] = self.wanted.get(at, values) & values
            else:
                yield f

    def partitions(self) -> list[Tile]:
        out = []
        for o in self.observations:
            if o["obs_id"] not in self.wanted.get("obs_id", {o["obs_id"]}):
                continue
            segments = [(p, file_rows(p, self.contract)) for p in o["dat_paths"]]
            for k, (a, b) in enumerate(tile_rows(sum(n for _, n in segments), self.size, self.overlap)):
                if k in self.wanted.get("tile", {k}):
                    out.append(Tile(o["obs_id"], k, a, b, overlaps(segments, a, b)))
        return out or [Tile("", -1, 0, 0, ())]

    def read(self, part: Tile) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        chosen = [c for c in self.channels if c in self.wanted.get("channel", {c})] if part.tile >= 0 else []
        for at in range(0, len(chosen), 16):
            block = chosen[at:at + 16]
            i, q = split_words(read_words(part.parts, block, self.contract))
            n = len(block)
            lists = [pa.array([x[:, k] for k in range(n)], pa.list_(pa.int8())) for x in (i, q)]
            keys = [pa.array([part.obs_id] * n), *[pa.array([v] * n, pa.int64()) for v in (part.tile, part.row0, part.row1)]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(block, pa.int32()), *lists], names)


def load(spark: SparkSession, observations: list[dict], contract: Contract, tile: int, overlap: int, channels: list[int] | None = None) -> DataFrame:
    """Tiles of recordings; see ``IqDatSource``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IqDatSource)
    given = [{"obs_id": o["obs_id"], "dat_paths": [str(p) for p in o["dat_paths"]]} for o in observations]
    reader = spark.read.format("iq_dat").option("observations", json.dumps(given)).option("contract", json.dumps(asdict(contract)))
    return reader.option("tile_rows", tile).option("overlap_rows", overlap).option("channels", json.dumps(channels)).load()


def samples_of_parts(parts: DataFrame, keys: list[str], contract: Contract) -> DataFrame:
    """(keys, i, q) of one channel's rows for each key: parts has keys, channel and parts, an array of (path, a, b) in order."""
    fields = ", ".join(f"`{k}` {t}" for k, t in parts.dtypes if k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                i, q = split_words(read_words([(p["path"], p["a"], p["b"]) for p in row.parts], [row.channel], contract)[:, 0])
                yield pd.DataFrame({**{k: [getattr(row, k)] for k in keys}, "i": [i.astype(float)], "q": [q.astype(float)]})

    return parts.select(*keys, "channel", "parts").mapInPandas(run, f"{fields}, i array<double>, q array<double>")


def write_overlay(base: str, changed: DataFrame, out_dir: str, contract: Contract, block_rows: int = 65536) -> DataFrame:
    """Writes a recording with changed channels, as files of block_rows rows that follow each other, and lists them.

    changed: channel, row, i, q of the changed cells; all others are copied. Each block is read, overlaid and written by its
    own task. Returns (block, path, n_rows), whose order is that of the rows; a manifest lists the paths in it.
    """
    rows = file_rows(base, contract)
    blocks = changed.sparkSession.range(-(-rows // block_rows)).withColumnRenamed("id", "block")
    cells = changed.select(F.expr(f"row div {block_rows}").alias("block"), "channel", "row", F.col("i").cast("double"), F.col("q").cast("double"))
    Path(out_dir).mkdir(parents=True, exist_ok=True)

    def write(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        a, b = k * block_rows, min(rows, (k + 1) * block_rows)
        words = read_words([(base, a, b)], list(range(contract.channels)), contract).copy()
        if len(right):
            words[right["row"].to_numpy() - a, right["channel"].to_numpy()] = join_words(right["i"].to_numpy(), right["q"].to_numpy())
        path = f"{out_dir}/part-{k:06d}.dat"
        tmp = f"{path}.{np.random.default_rng().integers(1 << 60):x}"
        words.tofile(tmp)
        Path(tmp).replace(path)  # a task that runs again leaves a whole file
        return pd.DataFrame({"block": [k], "path": [path], "n_rows": [b - a]})

    return blocks.groupBy("block").cogroup(cells.groupBy("block")).applyInPandas(write, "block long, path string, n_rows long")
