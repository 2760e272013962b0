"""What the corpus operators share: tables, word rules and intermediate tables.

Texts are never changed by locale or Unicode rules: lower-casing touches A-Z only, and both word
rules are stated over code points, so that the JVM, Python bytes and DuckDB agree on every text.
"""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that are not part of a normalised word: ASCII but for 0-9 and a-z (text is lower-cased first).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters that part the words of raw text.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows in an Arrow batch of texts.
BATCH_ROWS = 1000

#: Byte table for Python tasks: A-Z lower-cased, other characters outside a normalised word made a space.
#: Bytes from 0x80 belong to characters beyond ASCII, which are word characters.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b) in string.digits + string.ascii_lowercase else b + 32 if chr(b) in string.ascii_uppercase else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table; the path goes to Spark as it is, whatever store it names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def squeeze(text: Column, gaps: str) -> Column:
    """Words parted by one space, without spaces at the ends; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), gaps, " "))


def count_words(squeezed: Column) -> Column:
    """Words of a squeezed text: its spaces and one more."""
    return F.when(squeezed == "", F.lit(0).cast("long")).otherwise((F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where it is unset and there is one machine, as in tests, a temporary one."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-drawgraph-"))
        held = spark.sparkContext.getCheckpointDir()
    if held.startswith("file:/") and not held.startswith("file://"):
        held = "file://" + held.removeprefix("file:")
    return held.rstrip("/")


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives the loss of any executor.

    What led to df is not needed any more. Spark deletes its shuffle files once the driver's JVM has collected their
    last reference, so collection is asked for here; else they would stay until the heap happens to fill."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more. Listeners may hold the last query for a moment after it ended."""
    spark.sparkContext._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Delete a table that settle() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(shared_dir(spark)) or shared_dir(spark).removeprefix("file://") in path:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def short_batches(df: DataFrame) -> DataFrame:
    """df, after making sure that Arrow batches for Python tasks hold few rows: texts can be long, and a batch is in memory on both sides. Another setting than Spark's default is left as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def key_of(text: Column) -> Column:
    """Tells rows apart that share an id: a hash of the whole text, -1 for null."""
    return F.coalesce(F.xxhash64(text), F.lit(-1))
