"""Tables of posts: CSV that survives any text, and Parquet."""

import hashlib
import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import CORE_COLUMNS
from ..operators.posts import union_posts
from ..schema import LABELLED_POST, POST
from ..session import child_folders, file_system, path_exists

# Keeps quotes, commas, line breaks of all kinds, backslashes and outer blanks.
# Empty text and null are one and the same in CSV; Parquet keeps them apart.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

# A file with line breaks inside values cannot be split when it is read.
MAX_RECORDS_PER_FILE = 10_000

# Folders of a sink: one per run or query, and one per batch in it.
RUN_COLUMN, BATCH_COLUMN = "run", "batch_id"
BATCH_FIELDS = (T.StructField(RUN_COLUMN, T.StringType()), T.StructField(BATCH_COLUMN, T.LongType()))
# Numbered batches that do not say whose they are.
UNNAMED_RUN = "unnamed"
# Files count at whatever depth they are, and folder names are no columns.
ALL_FILES = {"recursiveFileLookup": True}


def read_posts_csv(spark, path, schema=LABELLED_POST, folders=(), base=None):
    """Posts of a CSV folder; a value that does not fit its column is an error.

    Numbers are read as text first: a tool that met a missing label may have
    written the others as ``1.0``.  ``folders`` are columns that the names of the folders
    hold, last in the schema; the names count below the folder ``base``.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = (
        spark.read.schema(as_text)
        .options(**CSV_OPTIONS)
        .options(**({"basePath": base} if folders else ALL_FILES))
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )

    def typed(field):
        value = F.col(field.name)
        if isinstance(field.dataType, T.IntegralType):
            value = F.regexp_replace(value, r"\.0+$", "")
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*map(typed, schema))


def csv_columns(spark, path):
    """Header of a CSV folder, None where there is no table yet."""
    try:
        found = spark.read.options(**CSV_OPTIONS, **ALL_FILES).csv(path).columns
    except AnalysisException as problem:
        if problem.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            return None
        raise
    return found or None


# Files of a CSV folder, and the folders of a sink, that have its first columns.
OWN_FILES, OWN_RUNS = "*.csv*", "run=*"

# Each set of columns of a CSV table has a folder of its own and a note of its header;
# files with the columns the table began with lie beside these folders.
SET_COLUMN, HEADER_NOTE = "columns", "_columns"


def _noted_header(spark, folder):
    files, note = file_system(spark, f"{folder}/{HEADER_NOTE}")
    if not files.exists(note):
        return None
    source = files.open(note)
    try:
        scanner = spark.sparkContext._jvm.java.util.Scanner(source, "UTF-8")
        return json.loads(scanner.useDelimiter("\\A").next())
    finally:
        source.close()


def _note_header(spark, folder, columns):
    files, note = file_system(spark, f"{folder}/{HEADER_NOTE}")
    out = files.create(note, True)
    try:
        out.write(bytearray(json.dumps(list(columns)).encode()))
    finally:
        out.close()


def column_sets(spark, path, own_files):
    """``(folder, files, columns)`` of each set of columns of a CSV table.

    ``own_files`` is the pattern of the files of the first set.  Headers are noted, so
    no file is opened to tell them, but for a table that has no notes yet.
    """
    header = _noted_header(spark, path)
    if header is None:
        names = file_system(spark, f"{path}/{own_files}")
        header = csv_columns(spark, f"{path}/{own_files}") if names[0].globStatus(names[1]) else None
    found = [] if header is None else [(path, f"{path}/{own_files}", header)]
    for digest in child_folders(spark, path, SET_COLUMN):
        folder = f"{path}/{SET_COLUMN}={digest}"
        columns = _noted_header(spark, folder) or csv_columns(spark, folder)
        if columns:
            found.append((folder, folder, columns))
    return found


def folder_for(posts, path, own_files):
    """Folder of the table for the columns of the posts, and the posts in its order."""
    spark = posts.sparkSession
    sets = column_sets(spark, path, own_files)
    for folder, _, columns in sets:
        if sorted(columns) == sorted(posts.columns):
            return folder, posts.select(*columns)
    if not sets:
        folder = path
    else:
        digest = hashlib.sha256(json.dumps(sorted(posts.columns)).encode()).hexdigest()
        folder = f"{path}/{SET_COLUMN}={digest[:16]}"
    _note_header(spark, folder, posts.columns)
    return folder, posts


def read_column_sets(spark, path, schema, own_files, folders=()):
    """All rows of a CSV table: the sets of columns united by name, missing ones null."""
    parts = []
    for folder, files, columns in column_sets(spark, path, own_files):
        known = {field.name: field for field in schema}
        own = [known.get(name) or T.StructField(name, T.StringType()) for name in columns]
        rows = read_posts_csv(spark, files, T.StructType([*own, *folders]), folders, folder)
        parts.append(rows.select(*(c for c in rows.columns if c in known)))
    empty = spark.createDataFrame([], schema)
    return reduce(union_posts, parts, empty).select(*schema.names)


def write_posts_csv(posts, path, mode="append", max_records=MAX_RECORDS_PER_FILE):
    """Write a CSV folder; ``max_records`` bounds what one task has to read of it."""
    writer = posts.write.mode(mode).options(**CSV_OPTIONS)
    writer.option("maxRecordsPerFile", max_records).csv(path)


def append_posts_csv(posts, path, union_path=None):
    """Append to a CSV folder, made if missing; returns the old and new rows.

    Only new files are added.  Where the columns differ they go to a folder of their
    own in the table, and the table is read as the union of both, matched by name; or,
    with a ``union_path``, the union is written to that new path, which is the table
    from then on.
    """
    spark = posts.sparkSession
    sets = column_sets(spark, path, OWN_FILES)
    types = {field.name: field for field in (*LABELLED_POST, *posts.schema)}
    names = list(dict.fromkeys([*(c for *_, columns in sets for c in columns), *posts.columns]))
    schema = T.StructType([types.get(name) or T.StructField(name, T.StringType()) for name in names])
    if union_path is not None and any(sorted(c) != sorted(posts.columns) for *_, c in sets):
        rows = union_posts(read_column_sets(spark, path, schema, OWN_FILES), posts)
        write_posts_csv(rows.select(*names), union_path, "errorifexists")
        return read_posts_csv(spark, union_path, schema)
    folder, posts = folder_for(posts, path, OWN_FILES)
    write_posts_csv(posts, folder)
    return read_column_sets(spark, path, schema, OWN_FILES)


def append_core_csv(posts, path):
    """Append content, url and profile name only; one header per part file."""
    write_posts_csv(posts.select(*CORE_COLUMNS), path)


def batch_path(path, run_id, batch_id):
    """Folder of one batch of a run or query."""
    return f"{path}/{RUN_COLUMN}={run_id}/{BATCH_COLUMN}={batch_id}"


@dataclass(frozen=True)
class PostSink:
    """Folder that runs and streams write to, as ``csv`` or ``parquet``.

    Every write has a folder of its own, ``run=<id>/batch_id=<n>``, so none can
    hide or replace the rows of another.  ``max_records`` bounds the CSV files.
    A column that is new is null in the older rows, without a rewrite: Parquet tells its
    columns, and a CSV sink keeps a folder per set of columns.
    """

    path: str
    format: str = "parquet"
    max_records: int = MAX_RECORDS_PER_FILE

    def __post_init__(self):
        if self.format not in ("csv", "parquet"):
            raise ValueError(f"unknown format: {self.format!r}")

    def write(self, posts, batch_id=None, run_id=None):
        """Append the posts; a numbered batch replaces its own earlier attempt.

        A batch is known by its number and the run or query it belongs to.
        """
        if batch_id is None:
            run_id, batch_id, mode = run_id or uuid.uuid4().hex, 0, "errorifexists"
        else:
            run_id, mode = run_id or UNNAMED_RUN, "overwrite"
        path = batch_path(self.path, run_id, batch_id)
        if self.format == "parquet":
            posts.write.mode(mode).parquet(path)
            return
        folder, posts = folder_for(posts, self.path, OWN_RUNS)
        write_posts_csv(posts, batch_path(folder, run_id, batch_id), mode, self.max_records)
        # An earlier attempt may have had other columns.
        for other, *_ in column_sets(posts.sparkSession, self.path, OWN_RUNS) if mode == "overwrite" else ():
            if other != folder:
                files, old = file_system(posts.sparkSession, batch_path(other, run_id, batch_id))
                files.delete(old, True)

    def read(self, spark, schema=LABELLED_POST, batches=False):
        """The posts; with ``batches`` also the run and the number of the batch they came in."""
        folders = BATCH_FIELDS if batches else ()
        schema = T.StructType([*schema.fields, *folders])
        if self.format == "csv":
            return read_column_sets(spark, self.path, schema, OWN_RUNS, folders)
        reader = spark.read.schema(schema).options(**({} if batches else ALL_FILES))
        return reader.parquet(self.path)

    def batch_total(self, spark, run_id, batch_id):
        """Rows that one batch has stored, counted in its files."""
        reader, tables = spark.read.schema(POST), [self.path]
        if self.format == "csv":
            reader, tables = reader.options(**CSV_OPTIONS), [f for f, *_ in column_sets(spark, self.path, OWN_RUNS)]
        paths = [batch_path(table, run_id, batch_id) for table in tables]
        paths = [path for path in paths if path_exists(spark, path)]
        return reader.format(self.format).load(paths).count() if paths else 0

    def total(self, spark):
        """Rows stored so far; a look at the footers for Parquet."""
        return self.read(spark).count()
