"""Result tables, manifests and write-once sheets."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import ContractError


@dataclass(frozen=True)
class Paths:
    """Inputs and outputs of a run."""

    speech_dir: Path
    metadata_path: Path
    conflicts_path: Path
    spending_path: Path
    output_dir: Path

    @classmethod
    def from_env(cls, root: str | Path, env: dict[str, str] | None = None) -> Paths:
        """Paths below ``root``; a variable of a field's name in capitals goes before, and a TXT folder is entered."""
        env, root = dict(os.environ if env is None else env), Path(root)
        defaults = {"speech_dir": "speeches", "metadata_path": "Speakers_by_session.xlsx", "conflicts_path": "conflicts.csv", "spending_path": "spending.xlsx", "output_dir": "outputs"}
        found = {f.name: Path(env.get(f.name.upper(), root / defaults[f.name])) for f in fields(cls)}
        if (found["speech_dir"] / "TXT").is_dir():
            found["speech_dir"] = found["speech_dir"] / "TXT"
        return cls(**found)

    def validate(self) -> None:
        """Raises with all inputs that are missing."""
        missing = [str(getattr(self, f.name)) for f in fields(self) if f.name != "output_dir" and not getattr(self, f.name).exists()]
        if missing:
            raise FileNotFoundError("missing: " + ", ".join(missing))


#: Cells come back as they were: quotes doubled, line breaks and blanks kept; null is empty, an empty text is quoted.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str, digits: int | None = None) -> None:
    """A small result table as one CSV file, doubles rounded at the sink alone."""
    if digits is not None:
        df = df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    df.coalesce(1).write.mode("overwrite").options(**CSV).csv(path)


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_manifest(path: str | Path, *, sources: Iterable[str | Path], rows: dict[str, int], fingerprint: str, settings: dict) -> dict:
    """A JSON record of what a run read and made."""
    import pyspark

    made = {"sources": {str(s): file_hash(s) for s in sorted(map(str, sources))}, "rows": rows, "corpus_fingerprint": fingerprint, "settings": settings, "settings_hash": canonical_hash(settings), "versions": {"pyspark": pyspark.__version__}}
    Path(path).write_text(json.dumps(made, indent=2, sort_keys=True))
    return made


def write_once(df: DataFrame, path: str, identity: list[str]) -> DataFrame:
    """Writes a review sheet, or, if it is there, checks that it is about the same rows and leaves it as it is."""
    spark = df.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        df.write.parquet(path)
        return df
    there = spark.read.parquet(path)
    one, two = there.select(*identity), df.select(*identity)
    if one.exceptAll(two).limit(1).count() or two.exceptAll(one).limit(1).count():
        raise ContractError(f"{path} is about other rows")
    return there


def write_markdown(df: DataFrame, path: str | Path, title: str, text: str) -> None:
    """Passages one after another; rows stream through the driver."""
    with open(path, "w", encoding="utf-8") as f:
        for row in df.toLocalIterator():
            f.write(f"## {row[title]}\n\n{row[text]}\n\n")
