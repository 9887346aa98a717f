"""Session factory and the folder that all executors share.

Results that must outlive a stage (cut lineage, published tables, ledgers) are kept as
Parquet below the folder in ``spark.checkpoint.dir``. Losing an executor then never
loses them. They are removed when the application ends, or before by ``discard`` and ``scope``. Only where the setting is absent, as in local tests, a folder is made here.
"""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
_shipped: set[str] = set()
_cleaned_at_exit: set[str] = set()
_made: list[tuple[str, str]] = []  # (application, path) of the tables made in open scopes
_scopes = 0


def get_session(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer; ``conf`` overrides any of it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of all executors; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f"{home.name}/{f.relative_to(home)}")
        uri = f"{shared_root(spark)}/{home.name}-source.zip"
        fs, path = hadoop_fs(spark, uri)
        out = fs.create(path, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(uri)
        _shipped.add(app)
    return spark


def shared_root(spark: SparkSession) -> str:
    """URI of this application's folder below ``spark.checkpoint.dir``."""
    global _own_root
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_root is None:
            _own_root = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
        base = f"file://{_own_root}"
    root = f"{base.rstrip('/')}/tessera/{spark.sparkContext.applicationId}"
    if root not in _cleaned_at_exit:
        _cleaned_at_exit.add(root)
        atexit.register(_remove, spark._jvm.org.apache.hadoop.fs.Path(root), spark.sparkContext._jsc.hadoopConfiguration())
    return root


def _remove(path, configuration) -> None:
    try:
        path.getFileSystem(configuration).delete(path, True)
    except Exception:  # the JVM may be gone; nothing can be done any more
        pass


def new_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is there lives as long as the application, or the ``scope`` that is open."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _made.append((spark.sparkContext.applicationId, path))
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was put into the shared folder within it; results must have been written elsewhere or used up by then."""
    global _scopes
    first = len(_made)
    _scopes += 1
    try:
        yield
    finally:
        _scopes -= 1
        for _, path in _made[first:]:
            fs, p = hadoop_fs(spark, path)
            fs.delete(p, True)
        del _made[first:]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    The location is kept as ``df.tessera_path`` so that ``discard`` can remove it once a
    later table replaces it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def cut_counting(df: DataFrame, test: Column, label: str = "cut") -> tuple[DataFrame, int]:
    """``cut``, and how many rows meet ``test``, counted as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.when(test, 1)).alias("n")), label)
    return out, seen.get["n"]


def discard(*tables: DataFrame | None) -> None:
    """Removes tables made by ``cut``; nothing that still reads them may run afterwards."""
    for df in tables:
        path = getattr(df, "tessera_path", None)
        if path:
            fs, p = hadoop_fs(df.sparkSession, path)
            fs.delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Removes everything that this application left in the shared folder; frames that read it are of no use afterwards."""
    fs, p = hadoop_fs(spark, shared_root(spark))
    fs.delete(p, True)
    _shipped.discard(spark.sparkContext.applicationId)


def hadoop_fs(spark: SparkSession, uri: str):
    """The Hadoop file system of ``uri`` and its Path object."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that ``df`` reads, from the plan; runs no job. Sources of unknown size count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 62)
