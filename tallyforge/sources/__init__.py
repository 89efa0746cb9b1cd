"""Sources and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import safe_skill_name

MESSAGE = "method string, params struct<threadId:string, turnId:string, delta:string, item:struct<type:string, text:string, message:string>, turn:struct<status:string, error:struct<message:string>>>"


def shared_top(spark: SparkSession) -> str:
    """The folder that all executors see, from spark.checkpoint.dir; where that is unset, a local master gets one of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        top = spark.sparkContext.getCheckpointDir()
    return top


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below shared_top."""
    return f"{shared_top(spark)}/{name}/{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), top


def folders(spark: SparkSession, path: str, whole: bool = False) -> list[str]:
    """Names of the folders in a folder, none where it isn't there; if whole, of those that a writer has finished."""
    fs, top = _file_system(spark, path)
    found = [s.getPath() for s in fs.listStatus(top) if s.isDirectory()] if fs.exists(top) else []
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(p.getName() for p in found if not whole or done(p))


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, top = _file_system(spark, path)
    return fs.getContentSummary(top).getLength()


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, top = _file_system(spark, path)
    fs.delete(top, True)


def rename_folder(spark: SparkSession, path: str, to: str) -> bool:
    """Whether the folder has got its new name in one step; False if there is something of that name, which then stays as it is."""
    sc = spark.sparkContext
    (fs, top), (_, there) = _file_system(spark, path), _file_system(spark, to)
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    fs.mkdirs(there.getParent())
    try:
        context.rename(top, there, sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def written(df: DataFrame, name: str = "tables") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, kept when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df dealt out by ranges of these columns, nulls first, and in that order in each task: a key with many rows goes to many tasks."""
    by = [F.asc_nulls_first(c) for c in order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def skill_corpus(spark: SparkSession, path: str, file: str = "SKILL.md") -> DataFrame:
    """(skill, text) of path/<skill>/<file>; folders with unsafe names are left out. A folder skill=x is skill x."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file).text(path, wholetext=True)
    folder = F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return rows.select(F.regexp_replace(folder, "^skill=", "").alias("skill"), F.col("value").alias("text")).where(safe_skill_name(F.col("skill")))


def load_skills(wanted: DataFrame, skills: DataFrame, optional: bool = False) -> tuple[DataFrame, DataFrame]:
    """(found, rejected) of wanted (skill): found has the text, rejected a reason. If optional, a missing skill is found with a null text."""
    safe = F.coalesce(safe_skill_name(F.col("skill")), F.lit(False))
    rows = wanted.join(skills.select("skill", "text").withColumn("_there", F.lit(True)), "skill", "left")
    missing = F.lit(False) if optional else F.col("_there").isNull()
    reason = F.when(~safe, F.concat(F.lit("Invalid skill name: "), F.coalesce("skill", F.lit("")))).when(missing, F.concat(F.lit("Skill not found: "), "skill"))
    rows = rows.withColumn("reason", reason).drop("_there")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").drop("text")


def tagged_messages(lines: DataFrame) -> DataFrame:
    """JSON lines (value and any other columns), parsed once: the messages' fields and kind, `message` or `malformed`; value is kept of the malformed ones."""
    rows = lines.withColumn("_m", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}))
    good = F.coalesce(F.col("_m.method").isNotNull(), F.lit(False))
    p = F.col("_m.params")
    return rows.select(
        *[c for c in lines.columns if c != "value"], F.when(~good, F.col("value")).alias("value"), F.when(good, "message").otherwise("malformed").alias("kind"),
        F.col("_m.method").alias("method"), p["threadId"].alias("thread_id"), p["turnId"].alias("turn_id"), p["delta"].alias("delta"), p["item"]["type"].alias("item_type"),
        F.coalesce(F.when(p["item"]["text"] != "", p["item"]["text"]), p["item"]["message"]).alias("item_text"), p["turn"]["status"].alias("turn_status"), p["turn"]["error"]["message"].alias("turn_error"),
    )


def _apart(tagged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(messages, malformed) of tagged messages; columns are those of the lines."""
    fields = ["method", "thread_id", "turn_id", "delta", "item_type", "item_text", "turn_status", "turn_error"]
    return tagged.where("kind = 'message'").select(*[c for c in columns if c != "value"], *fields), tagged.where("kind = 'malformed'").select(*columns)


def parse_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, malformed) of JSON lines (value and any other columns), batch or stream; each frame parses for itself. route_messages parses once."""
    return _apart(tagged_messages(lines), lines.columns)


def route_messages(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of JSON lines over all that is there: (messages, malformed) as tables below path, the second a quarantine.

    A micro-batch is parsed once, and one write deals its rows out to the folders of both kinds. Its folder bears its
    number, so a batch that runs again replaces what it had written. In one run a batch is all that is there, or what
    the stream's options allow it.
    """
    schema = tagged_messages(lines.sparkSession.createDataFrame([], lines.schema)).schema

    def route(batch: DataFrame, n: int) -> None:
        tagged_messages(batch).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/n={n}")

    lines.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(route).start().awaitTermination()
    # a folder with no file yet can't be read
    there = folders(lines.sparkSession, f"{path}/rows", whole=True)
    rows = lines.sparkSession.read.schema(schema).parquet(f"{path}/rows") if there else lines.sparkSession.createDataFrame([], schema)
    return _apart(rows, lines.columns)


def read_messages(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """parse_messages over text files."""
    return parse_messages((spark.readStream if stream else spark.read).text(path))
