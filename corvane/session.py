"""The session that the operators expect, and settings from the environment."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from corvane.errors import ConfigurationError

#: Fixed value: how a line of the log looks.
LOG_FORMAT = "%(asctime)s %(levelname)-8s %(name)s: %(message)s"


def configure_logging(level: str | int = "INFO", form: str | None = None) -> None:
    """The driver's own log lines: the level by name, in any case, or number."""
    known = logging.getLevelNamesMapping()
    if isinstance(level, str) and level.upper() not in known:
        raise ConfigurationError(f"unknown level {level!r}")
    logging.basicConfig(level=known[level.upper()] if isinstance(level, str) else level, format=form or LOG_FORMAT, force=True)


def is_local(master: str) -> bool:
    """Whether driver and tasks are one process and share its folders."""
    return master == "local" or master.startswith("local[")


def build_session(name: str = "corvane", **conf: str) -> SparkSession:
    """UTC times, adaptive plans, and maps whose later entries win."""
    builder = SparkSession.builder.appName(name)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh name in spark.checkpoint.dir, which driver and executors share; where that is unset, as in tests, in a local folder, which needs a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Settings:
    """What a retrieval job can be told; each also from the environment, as PREFIX_NAME."""

    top_k: int = 10
    dpi: int = 150
    batch_size: int = 4
    index_path: str = ""

    def __post_init__(self):
        if self.top_k < 0 or self.dpi < 1 or self.batch_size < 1:
            raise ConfigurationError("top_k must not be negative; dpi and batch_size must be positive")

    @classmethod
    def from_env(cls, prefix: str = "CORVANE", env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls(**{f.name: type(f.default)(env[key]) for f in fields(cls) if (key := f"{prefix}_{f.name}".upper()) in env})
