"""Sources of already-fetched pages."""

from ..schema import PAGE


def read_pages(spark, path):
    """Pages of a Parquet table."""
    return spark.read.schema(PAGE).parquet(path)


# Bytes of page files that one batch of a stream takes, unless it says otherwise.
BATCH_BYTES = 8 << 30


def stream_pages(spark, path, max_files=None, max_bytes=None):
    """Pages of the files that arrive in a folder, in batches of bounded size.

    A batch takes files up to ``max_bytes``, 8 GiB by default and at least one file, or
    else ``max_files`` files; so a backlog is worked off in several batches.
    """
    reader = spark.readStream.schema(PAGE)
    if max_files is not None and max_bytes is not None:
        raise ValueError("a batch is bounded by files or by bytes, not by both")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES if max_bytes is None else max_bytes)
    return reader.parquet(path)
