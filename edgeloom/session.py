"""Session helpers: one place that knows about the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "edgeloom", cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only in local mode without it.

    The folder comes back as a full path of its file system, whatever the session's default file system is.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="edgeloom-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        named = f"file://{named}"
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by ``clean``."""
    path = f"{ensure_checkpoint_dir(spark)}/edgeloom-{uuid.uuid4().hex}"
    _written[path] = spark.sparkContext
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage reliably: the rows are written once to the shared folder and read back from there.

    A lost executor costs no recomputation of what came before. Unlike checkpoint(), a written table is computed once, not
    twice, and the planner knows its size; columns that are not needed later are not read.
    """
    return cut_counted(df)[0]


def cut_counted(df: DataFrame, *more: Column) -> tuple[DataFrame, tuple]:
    """``cut``, and the row count and further aggregates of the same rows, taken while they are written."""
    path = scratch(df.sparkSession)
    seen = Observation()
    watched = [F.count(F.lit(1)).alias("m0"), *[m.alias(f"m{i + 1}") for i, m in enumerate(more)]]
    df.observe(seen, *watched).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    got = seen.get
    return out, tuple(got[f"m{i}"] for i in range(len(watched)))


def written(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a table of ``cut``, else cut: for inputs that are read several times."""
    return df if "_written_at" in vars(df) else cut(df)


_written: dict[str, SparkContext] = {}


def _delete(path: str, sc: SparkContext) -> None:
    """Delete with the session's own file system settings. A context that has stopped cannot: its folder keeps the table."""
    if sc._jsc is None:
        return
    hp = sc._jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hp, True)


def discard(*frames: DataFrame | None) -> None:
    """Delete tables of ``cut`` that nothing reads any more, such as the round before the last of a loop. Other frames stay."""
    for df in frames:
        path = vars(df).get("_written_at") if df is not None else None
        if path in _written:
            _delete(path, _written.pop(path))


def clean() -> None:
    """Delete all tables that ``cut`` has written; results that read them must be stored before. Runs at exit."""
    while _written:
        _delete(*_written.popitem())


@atexit.register
def _clean_at_exit() -> None:
    try:
        clean()
    except Exception as e:  # noqa: BLE001  at exit the gateway may be gone: say what is left behind
        print(f"edgeloom: intermediate tables were not deleted: {e}", file=sys.stderr)
