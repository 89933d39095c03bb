"""Session helpers: table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from folioquery.errors import StoreError


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and all executors are threads of this machine, as in tests, a temporary
    folder takes its place; on any other master it is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioquery-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet, for this driver only: it
    is deleted when the driver's Python ends; ``sweep`` removes what a killed
    driver left."""
    if not _mine:
        atexit.register(_forget)
    _mine.append(f"{shared_dir(spark)}/folioquery/{label}-{uuid.uuid4().hex}")
    return _mine[-1]


_mine: list[str] = []


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its
    lineage: a lost executor costs no recomputation beyond the reader's own. ``by``: a column to partition by."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _forget() -> None:
    spark = SparkSession.getActiveSession()
    for path in _mine if spark else ():
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 the JVM may be gone
            return


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def sweep(spark: SparkSession, hours: float = 48.0) -> list[str]:
    """Delete what this package left in the shared folder and nothing changed for
    ``hours``. States that are kept between runs belong elsewhere. Returns the
    folders deleted."""
    top = f"{shared_dir(spark)}/folioquery"
    if not path_exists(spark, top):
        return []
    fs, p = _fs(spark, top)
    oldest = (time.time() - hours * 3600) * 1000
    gone = [str(s.getPath()) for s in fs.listStatus(p) if s.getModificationTime() < oldest]
    for path in gone:
        delete(spark, path)
    return gone


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


class Commits:
    """Numbered markers under a folder; the last is the state of what the folder
    holds. A marker is written beside its place and moved there, so readers see
    whole markers only, and files that no marker names do not exist for them: a
    run that fails before its marker has changed nothing. Two runs that both
    follow the same marker collide, and the second raises."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self) -> list[int]:
        at = f"{self.path}/commits"
        if not path_exists(self.spark, at):
            return []
        fs, p = _fs(self.spark, at)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> dict:
        """The state, {} before the first commit."""
        n = self._numbers()
        if not n:
            return {}
        return self.get(f"commits/{n[-1]}.json") | {"commit": n[-1]}

    def get(self, name: str) -> dict:
        """The small file of that name."""
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, what: dict) -> None:
        """A small file beside the tables, which counts once a marker names it."""
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        stream = fs.create(p, True)
        stream.write(json.dumps(what).encode())
        stream.close()

    def add(self, state: dict, after: dict) -> dict:
        """Make ``state`` follow ``after``, a state read before."""
        n = after.get("commit", 0) + 1
        name = f"commits/.{n}-{uuid.uuid4().hex}"
        self.put(name, {k: v for k, v in state.items() if k != "commit"})
        fs, beside = _fs(self.spark, f"{self.path}/{name}")
        _, place = _fs(self.spark, f"{self.path}/commits/{n}.json")
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, False)
            raise StoreError(f"another run has committed {place}")
        for old in self._numbers():
            if old < n - 1:
                delete(self.spark, f"{self.path}/commits/{old}.json")
        return state | {"commit": n}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless they find it
    by themselves (same machine, or installed)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_folioquery_shipped", False):
        return
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent
    name = shutil.make_archive(f"{tempfile.mkdtemp()}/folioquery", "zip", root.parent, root.name)
    sc.addPyFile(name)
    sc._folioquery_shipped = True
