"""What a session needs: the package on its Python workers, and a folder that all of them share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; a local session makes one of its own where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexeum-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch(spark)}/lexeum/{tag}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return

    atexit.register(remove)
    return path


def with_conf(spark: SparkSession, conf: dict[str, object]) -> SparkSession:
    """A session of the same application with settings of its own; the caller's keep theirs."""
    other = spark.newSession()
    for k, v in conf.items():
        other.conf.set(k, str(v))
    return other


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: workers can then import ``lexeum``."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        path = f"{tempfile.mkdtemp(prefix='lexeum-')}/lexeum.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"lexeum/{f.relative_to(root)}")
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark
