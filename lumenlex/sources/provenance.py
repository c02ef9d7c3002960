"""Where a corpus came from: checksums and provenance records."""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a record.
TEXTS = ("source_id", "source_name", "URL", "language", "license", "original_format", "description")
FIELDS = ("source_id", "source_name", "URL", "language", "license", "access_date", "original_format", "original_size", "description", "processing_steps", "notes", "sha256")
SCHEMA = "source_id string, source_name string, URL string, language string, license string, access_date string, original_format string, original_size bigint, sha256 string, description string, processing_steps array<string>, notes string"


def sha256_file(path: str, chunk_size: int = 1 << 20) -> str:
    """SHA-256 of one file in hex, read a chunk at a time."""
    if chunk_size < 1:
        raise ValueError(f"chunk_size must be at least 1, not {chunk_size}")
    digest = hashlib.sha256()
    with open(path, "rb") as source:
        for chunk in iter(lambda: source.read(chunk_size), b""):
            digest.update(chunk)
    return digest.hexdigest()


def sha256_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of many files, one task each; for files that fit a row (below 2 GB)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_checksum(path: str, expected: object) -> bool:
    """Is the file's SHA-256 the expected one, white space around it and case aside?"""
    return str(expected).strip().lower() == sha256_file(path)


def _is_date(value: object) -> bool:
    try:
        return isinstance(value, str) and date.fromisoformat(value).isoformat() == value
    except ValueError:
        return False


def validate_record(record: object) -> None:
    """ValueError unless the record is complete and well-formed."""
    if not isinstance(record, dict):
        raise ValueError("a provenance record is a dict")
    if absent := [name for name in FIELDS if name not in record]:
        raise ValueError(f"the record lacks {absent}")
    size, steps = record["original_size"], record["processing_steps"]
    rules = {name: isinstance(record[name], str) and bool(record[name].strip()) for name in TEXTS}
    rules |= {
        "notes": isinstance(record["notes"], str),
        "access_date": _is_date(record["access_date"]),
        "original_size": isinstance(size, int) and not isinstance(size, bool) and size >= 0,
        "processing_steps": isinstance(steps, list) and all(isinstance(step, str) for step in steps),
        "sha256": isinstance(record["sha256"], str) and re.fullmatch("[0-9a-f]{64}", record["sha256"]) is not None,
    }
    if wrong := [name for name, good in rules.items() if not good]:
        raise ValueError(f"malformed fields: {', '.join(f'{name}={record[name]!r}' for name in wrong)}")


def build_provenance_record(
    source_id, source_name, url, language, license, access_date, original_format, original_size, sha256, description, processing_steps=None, notes=""
) -> dict:
    """A validated record. The steps are copied; a bare string is refused."""
    if isinstance(processing_steps, (str, bytes)):
        raise ValueError("processing_steps is a list of strings, not one string")
    record = {"source_id": source_id, "source_name": source_name, "URL": url, "language": language, "license": license, "access_date": access_date}
    record |= {"original_format": original_format, "original_size": original_size, "sha256": sha256, "description": description}
    record |= {"processing_steps": list(processing_steps or ()), "notes": notes}
    validate_record(record)
    return record


def save_provenance(path: str, record: dict, overwrite: bool = False) -> None:
    """Validate and write as UTF-8 JSON; FileExistsError if there is a file and it is not to be overwritten."""
    validate_record(record)
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    with open(path, "w" if overwrite else "x", encoding="utf-8") as out:
        json.dump(record, out, ensure_ascii=False, indent=2)


def load_provenance(path: str) -> dict:
    with open(path, encoding="utf-8") as source:
        try:
            record = json.load(source)
        except ValueError as error:
            raise ValueError(f"{path} holds no valid JSON: {error}") from error
    validate_record(record)
    return record


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Many records as a table; a file that is not valid JSON fails the job."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def record_rules(records: DataFrame) -> DataFrame:
    """source_id and a boolean for every rule of ``validate_record``, for tables of records."""
    rules = [F.coalesce(F.rlike(F.col(name), F.lit(r"(?U)\S")), F.lit(False)).alias(f"{name}_ok") for name in TEXTS[1:]]
    rules += [
        (F.coalesce(F.rlike("access_date", F.lit(r"\A\d{4}-\d\d-\d\d\z")), F.lit(False)) & F.expr("try_to_date(access_date) IS NOT NULL")).alias("access_date_ok"),
        F.coalesce(F.col("original_size") >= 0, F.lit(False)).alias("original_size_ok"),
        F.coalesce(F.forall("processing_steps", lambda s: s.isNotNull()), F.lit(False)).alias("processing_steps_ok"),
        F.coalesce(F.rlike("sha256", F.lit(r"\A[0-9a-f]{64}\z")), F.lit(False)).alias("sha256_ok"),
        F.col("notes").isNotNull().alias("notes_ok"),
    ]
    return records.select("source_id", *rules)
