"""Session defaults and the shared folder for intermediate tables."""

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Settings the jobs rely on.  Partition counts are left to the cluster and AQE.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A speculative copy of a labelling task would call the model twice.
    "spark.speculation": "false",
}


def build_session(app_name="feedsieve", master=None, **settings):
    """Session with the settings above; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark):
    """Folder named by ``spark.checkpoint.dir``, the one all executors can reach.

    Only a local master may go without: there the driver is the only machine,
    so a temporary folder is made and set.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="feedsieve-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_table_path(spark, name):
    """Unused path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/feedsieve/{name}-{uuid.uuid4().hex}"


def write_shared(df, name):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what has been written is neither computed again nor
    different on a second look, whichever executors are lost.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark, path):
    """The cluster's file system of a path, and the path as it takes it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(conf), hadoop_path


def path_exists(spark, path):
    """Whether the cluster's file system has the path."""
    files, hadoop_path = file_system(spark, path)
    return files.exists(hadoop_path)


def child_folders(spark, path, column):
    """Values of ``column`` in the names ``column=value`` of the folders in a folder."""
    if not path_exists(spark, path):
        return []
    files, hadoop_path = file_system(spark, path)
    names = [status.getPath().getName() for status in files.listStatus(hadoop_path)]
    return sorted(name.partition("=")[2] for name in names if name.startswith(f"{column}="))


def drop_shared(df):
    """Remove the table that ``write_shared`` returned, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)
