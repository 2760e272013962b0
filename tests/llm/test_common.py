"""The shared folder on a session without spark.checkpoint.dir, and ids that are not whole numbers."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from drawgraph.llm import suffix_dedup, warc

PLAIN = """
import sys
sys.path.insert(0, sys.argv[1])
from drawgraph.session import build
from drawgraph.llm.common import forget, settle, shared_dir
spark = build("plain", master="local[1]", partitions=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
held = settle(spark.range(7).toDF("i"), "some")
assert held.count() == 7 and shared_dir(spark) == shared_dir(spark) and all(f.startswith(shared_dir(spark)) for f in held.inputFiles())
forget(held)
print("settled")
"""


def test_shared_folder_without_settings(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK")} | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PLAIN, str(Path(__file__).resolve().parents[2])], env=env, capture_output=True, text=True, timeout=300)
    assert "settled" in done.stdout, done.stderr[-2000:]


def test_suffix_dedup_by_text_ids(spark):
    passage = "the same passage of more than a hundred bytes stands in several of these documents, word for word and sign for sign"
    rows = [("b", "1 " + passage), ("a", passage + " 2"), (None, "3 " + passage + " 4"), ("c", "nothing of it"), ("c", None)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    n = len(passage)  # the space beside it repeats too
    assert got == {(None, n + 4): 0, ("a", n + 2): n + 1, ("b", n + 2): n + 1, ("c", 13): 0, ("c", 0): 0}


def test_suffix_dedup_of_many_rows_without_id(spark):
    """60,000 rows without an id: numbered by a sort over several tasks; all but one copy of each text goes."""
    text = F.concat(F.lit("a line of text that many rows share, with a number so that there are some different ones, and a few words more: "), (F.col("id") % 50).cast("string"), F.lit(" " + "and so on " * 12))
    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    got = suffix_dedup.removal_report(docs).agg(F.count(F.lit(1)), F.sum("n_bytes"), F.sum((F.col("n_removed") == F.col("n_bytes")).cast("int"))).first()
    assert got[0] == 60_000 and got[2] >= 60_000 - 50
    numbers = suffix_dedup.number_documents(docs)
    assert numbers.select("doc").distinct().count() == 60_000


def test_pages_with_text_ids(spark):
    with pytest.raises(TypeError, match="whole number"):
        warc.write_archives(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))
    with pytest.raises(Exception, match="(?i)scheme|libhdfs|hdfs|unrecogni"):
        warc.write_archives(spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string"), folder="nosuch://host/folder")
