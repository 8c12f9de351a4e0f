"""Where the tables and models of a scoring setup lie, under one folder or each in a place of its own."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Folders and files that the command line and its parts read; each is under root unless it is an address of its own."""

    root: str
    tables: str = "tables"
    global_scores: str = "global_scores.json"
    local_scorer: str = "local_scorer"
    template_scorer: str = "template_scorer"
    reference: str = "reference"
    agreement: str = "agreement"

    def path(self, name: str) -> str:
        if name == "root" or name not in {f.name for f in fields(self)}:
            raise ValueError(f"no setting is called {name!r}")
        value = getattr(self, name)
        return value if value.startswith("/") or "://" in value else f"{self.root.rstrip('/')}/{value}"

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Settings:
        """From a JSON object in a file that Spark can read; a name that is no setting is an error."""
        given = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**given)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class MembraneSettings(Settings):
    """Settings with the tables and scorer of residues in a membrane."""

    membrane_tables: str = "membrane_tables"
    membrane_scorer: str = "membrane_scorer"
