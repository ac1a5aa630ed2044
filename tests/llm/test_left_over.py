"""What the stages of the pipeline leave on the shared disk, and the size of their plans."""

import pathlib
import re

from framelode.llm import common, linededup, mixing


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark, docs):
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = common.materialise(docs.groupBy("text").count(), "counts")
    assert shuffle_files(spark) <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert out.count() == docs.select("text").distinct().count()
    common.discard(out)


def test_stages_leave_only_what_they_return(spark, docs):
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    lines = linededup.remove_lines(docs)
    assert [p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before] == ["gone"]
    assert lines.count() > 0


def test_mixture_is_a_short_plan(docs):
    """The driver plans each use of an unwritten table anew: over 30 joins took hundreds of MB of its memory."""
    plan = mixing.mixture(docs)._jdf.queryExecution().sparkPlan().toString()
    assert len(re.findall("Join", plan)) <= 8
