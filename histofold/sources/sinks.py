"""Inspection CSV sink (S14): a folder of parts, or one file to read by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histofold.functions.ordinal import file_row_number
from histofold.operators.inspection import CSV_COLUMNS
from histofold.schemas import INSPECTION_CSV
from histofold.session import scratch_dir
from histofold.sources.documents import _filesystem


def write_inspection_csv(rows: DataFrame, path: str) -> bool:
    """14 columns in fixed order, header, minimal quoting (only fields with a
    comma, quote or line break, quotes doubled, empty fields bare -- the usual
    CSV dialect); nothing written when there are no rows.  Returns whether a
    file was written."""
    spark = rows.sparkSession
    seen = Observation()
    (rows.select(*CSV_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path))
    if seen.get["rows"]:
        return True
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # nothing but an empty folder
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return False


#: Bytes copied at once.
CHUNK = 1 << 20


def write_inspection_file(rows: DataFrame, path: str) -> bool:
    """S14 as one file ``path`` with one header line, rows in the order of ``rows`` (``operators.inspection.inspection_sorted``);
    nothing written when there are no rows.  Returns whether a file was written.

    The sort and the formatting run in many tasks, which write headless parts below the shared scratch folder; one task
    then copies their bytes in order, a chunk at a time, into a file that gets its name when it is whole.  A repeated
    task starts a file of its own.  ``path`` is one that ``pyarrow.fs`` knows (see ``sources.documents``).
    """
    spark = rows.sparkSession
    parts = f"{scratch_dir(spark)}/histofold/inspection-{uuid.uuid4().hex}"
    seen = Observation()
    (rows.select(*CSV_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows")).write
     .option("header", False).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(parts))
    if not seen.get["rows"]:
        return False

    def join(batches):
        files, target = _filesystem(path)
        folder, _, _ = target.rpartition("/")
        if folder:
            files.create_dir(folder, recursive=True)
        unfinished = f"{target}.{uuid.uuid4().hex}"
        with files.open_output_stream(unfinished) as out:
            out.write((",".join(CSV_COLUMNS) + "\n").encode())
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    source, inside = _filesystem(part)
                    with source.open_input_stream(inside, compression=None) as raw:
                        while chunk := raw.read(CHUNK):
                            out.write(chunk)
        files.move(unfinished, target)
        yield from ()

    listing = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(parts).select("path")
    listing.coalesce(1).sortWithinPartitions("path").mapInArrow(join, "path string").collect()
    return True


def _breaks_inside(spark: SparkSession, path: str) -> bool:
    """Whether some line may not be a row of its own: a field that goes on in the next line leaves an odd number of
    quotes (a quote inside a field is doubled); a carriage return may end a line as well."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter((quotes % 2 == 1) | F.col("value").contains("\r")).isEmpty()


def read_inspection_csv(spark: SparkSession, path: str, number: str | None = None) -> DataFrame:
    """Read an inspection CSV back (quoted fields may hold line breaks), with the 1-based row number in file order
    in a column ``number`` if one is named.

    CSV has no null: an empty text field reads as ''.  A file is read by many tasks, unless some quoted field holds
    a line break: then a row cannot be found without the text before it, and each file is read by one task.
    """
    read = spark.read.schema(INSPECTION_CSV).option("header", True).option("escape", '"').option("mode", "FAILFAST")
    df = (read.option("multiLine", True) if _breaks_inside(spark, path) else read.option("lineSep", "\n")).csv(path)
    if number:
        df = file_row_number(df.select("*", "_metadata"), number).drop("_metadata")
    return df.select(*([number] if number else []), *[F.coalesce(F.col(f.name), F.lit("")).alias(f.name)
                       if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in INSPECTION_CSV.fields])
