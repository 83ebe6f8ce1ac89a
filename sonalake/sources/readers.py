"""Reading recordings, metadata and tables. Paths are Spark paths: only Spark's readers touch them."""

from __future__ import annotations

import io
import os
import struct
import unicodedata
import wave
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleanse

#: Encodings that metadata may have, in the order they are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
AUDIO = "path string, conversion_status string, sample_rate int, num_frames long, num_channels int, error string, samples array<float>"


def read_table(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet or CSV by suffix, all columns or those named; CSV without a schema is read as strings."""
    if columns is not None:
        return read_table(spark, path, schema).select(*columns)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.csv(path)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def resolved(path: str | None, roots: Sequence[str] = (), exists: Callable[[str], bool] = os.path.exists) -> str | None:
    """The first place of a path that exists: as it is if absolute, below each root, or from its part data/ on; else the first of these."""
    if not path:
        return None
    tail = path[path.index("data/") :] if "data/" in path else None
    tried = [path] if path.startswith("/") else [*(f"{r.rstrip('/')}/{path}" for r in roots), path]
    tried += [f"{r.rstrip('/')}/{tail}" for r in roots] if tail else []
    return next((p for p in tried if exists(p)), tried[0])


def recordings(spark: SparkSession, root: str, suffix: str = "nsp", contents: bool = True, classes: Sequence[str] | None = None) -> DataFrame:
    """path, class, recording_id, modality, stem (and content) of root/<class>/<digits>/<modality>/<stem>.<suffix>, of all classes or those named."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    out = files.select(
        "path", part(4).alias("class"), part(3).alias("recording_id"), part(2).alias("modality"), F.regexp_replace(part(1), r"\.[^.]*$", "").alias("stem"), *(["content"] if contents else [])
    )
    fine = F.col("recording_id").rlike("^[0-9]+$") & F.col("modality").isin("vowels", "sentences")
    return out.where(fine if classes is None else fine & F.col("class").isin(*classes))


def manifest(spark: SparkSession, root: str, overview: DataFrame | None = None) -> DataFrame:
    """One row a recording: keys, token, flags, and the first overview row of its id. Empty files, sidecars too, count as absent."""
    rows = recordings(spark, root, contents=False)
    remarks = recordings_remarks(spark, root)
    sidecars = recordings(spark, root, "egg", contents=False).select("recording_id", F.regexp_replace("stem", "-egg$", "").alias("stem"), F.lit(True).alias("has_egg")).distinct()
    token = cleanse.sample_token("stem", "recording_id")
    out = rows.withColumn("token", token).join(sidecars, ["recording_id", "stem"], "left").withColumn("has_egg", F.coalesce("has_egg", F.lit(False)))
    out = out.join(remarks, ["class", "recording_id"], "left").withColumn("has_remarks", F.col("remarks_path").isNotNull())
    out = out.withColumn("pathology_en", cleanse.english("class")).withColumn("sample_key", cleanse.composite_key("class", "recording_id", "modality", "token")).withColumn("is_healthy", F.lower("class") == "healthy")
    if overview is not None:
        from ..operators.joins import lookup

        out = lookup(out, overview, "recording_id", [F.col(c) for c in sorted(overview.columns)], "overview_match_status")
        missing = F.concat_ws("_", F.lit("missing"), "class", "recording_id")
        out = out.withColumn("speaker_id", F.coalesce(cleanse.blank_to_null("speaker_id"), missing))
        out = cleanse.overlap_flag(out, "speaker_id", "class", "is_overlap_speaker_id")
    return cleanse.overlap_flag(out, "recording_id", "class", "is_overlap_speaker")


def recordings_remarks(spark: SparkSession, root: str) -> DataFrame:
    """class, recording_id, remarks_path: the first remarks file of each recording."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*-remarks.txt").load(root)
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    return files.select("path", part(4).alias("class"), part(3).alias("recording_id")).groupBy("class", "recording_id").agg(F.min("path").alias("remarks_path"))


def decode_text(content: bytes) -> str:
    """The first encoding that fits; latin-1 always does."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes anything")


def overview(spark: SparkSession, path: str) -> DataFrame:
    """Overview files in any of the encodings: renamed, trimmed, dates that can't be read are null, text in NFC."""
    names = list(cleanse.OVERVIEW_COLUMNS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                table = pd.read_csv(io.StringIO(unicodedata.normalize("NFC", decode_text(content))), dtype=str)
                if missing := [n for n in names if n not in table.columns]:
                    raise ValueError(f"{p} lacks columns: {', '.join(missing)}")
                yield table[names].assign(overview_path=p).astype(object).where(lambda t: t.notna(), None)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, ", ".join(f"`{n}` string" for n in [*names, "overview_path"]))
    rows = cleanse.renamed(rows, cleanse.OVERVIEW_COLUMNS)
    dates = ("recording_date", "birth_date")
    cleaned = [F.try_to_timestamp(F.trim(c)).alias(c) if c in dates else F.lower(F.trim(c)).alias(c) if c == "sex" else F.trim(c).alias(c) for c in rows.columns]
    return rows.select(*cleaned).withColumn("pathology_csv_raw", F.col("pathologies_de"))


def read_nsp(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and (frames, channels) of a chunked DS16 file."""
    if content[:8] != b"FORMDS16":
        raise ValueError("not a DS16 file")
    at, rate, data = 12, None, None
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if kind in (b"HEDR", b"HDR8"):
            rate = struct.unpack("<I", body[20:24])[0]
        elif kind in (b"SDA_", b"SD_B", b"SDAB"):
            flat = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
            data = flat.reshape(-1, 2) if kind == b"SDAB" else flat.reshape(-1, 1)
        at += 8 + size + size % 2
    if rate is None or data is None:
        raise ValueError("no header or no samples")
    return rate, data


def read_wav(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as f:
        if f.getsampwidth() != 2:
            raise ValueError("only 16-bit samples are read")
        return f.getframerate(), np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())


def to_wav(rate: int, data: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(data.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.ascontiguousarray(data, "<i2").tobytes())
    return out.getvalue()


def resampled(x: np.ndarray, rate: int, target: int | None) -> np.ndarray:
    """By straight lines between samples, after a windowed-sinc low-pass where the rate falls; None keeps the rate."""
    if not target or target == rate or not len(x):
        return x
    if target < rate:
        half = 16 * -(-rate // target)
        k = np.arange(-half, half + 1)
        kernel = np.sinc(k * target / rate) * np.hanning(2 * half + 3)[1:-1]
        x = np.convolve(x, kernel / kernel.sum(), "same") if len(x) > len(kernel) else x
    return np.interp(np.arange(0, len(x), rate / target), np.arange(len(x)), x)


def decoded(files: DataFrame, target_rate: int | None = None, normalise: bool = True) -> DataFrame:
    """files(path, content) as mono signals with a status each: converted or failed, never an error of the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rate, data = read_wav(content) if content[:4] == b"RIFF" else read_nsp(content)
                    x = resampled(data.mean(1), rate, target_rate) if len(data) else np.zeros(0)
                    peak = np.abs(x).max() if len(x) else 0.0
                    x = x / peak if normalise and peak else x / 32768
                    rows.append((path, "converted", target_rate or rate, len(data), data.shape[1], None, x.astype(np.float32)))
                except (ValueError, EOFError, wave.Error, struct.error) as e:
                    rows.append((path, "failed", None, None, None, str(e), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in AUDIO.split(", ")])

    return files.select("path", "content").mapInPandas(run, AUDIO)


def converted(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """files(path, content) as WAV files in a folder that all executors share: path, wav_path, wav_conversion_status, wav_error.

    converted, skipped_exists or failed; a file appears whole or not at all, so
    a task that runs again does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                wav = f"{folder}/{zlib.crc32(path.encode()):08x}-{os.path.splitext(os.path.basename(path))[0]}.wav"
                try:
                    if os.path.exists(wav) and not overwrite:
                        rows.append((path, wav, "skipped_exists", None))
                        continue
                    made = to_wav(*read_nsp(content))
                    os.makedirs(folder, exist_ok=True)
                    part = f"{wav}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(made)
                    os.replace(part, wav)
                    rows.append((path, wav, "converted", None))
                except (ValueError, EOFError, wave.Error, struct.error, OSError) as e:
                    rows.append((path, None, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["path", "wav_path", "wav_conversion_status", "wav_error"])

    return files.select("path", "content").mapInPandas(run, "path string, wav_path string, wav_conversion_status string, wav_error string")
