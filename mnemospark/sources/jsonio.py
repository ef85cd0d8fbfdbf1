"""JSON files: arrays of objects in, one object a line out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: an entry of the conversation benchmark.
BENCHMARK = "question_id string, question_type string, question string, answer string, question_date string, haystack_dates array<string>, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>, answer_session_ids array<string>"


def read_array(spark: SparkSession, path: str, schema: str = BENCHMARK) -> DataFrame:
    """Files that hold one JSON array (or object) each, read with a given schema; numbers where text is expected become text."""
    return spark.read.schema(schema).option("multiLine", True).option("primitivesAsString", True).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def sessions(entries: DataFrame) -> DataFrame:
    """(question_id, session, date, turn, role, text): the conversations of benchmark entries, row by row."""
    from pyspark.sql import functions as F

    s = entries.select("question_id", F.posexplode(F.arrays_zip("haystack_dates", "haystack_sessions")).alias("session", "z"))
    t = s.select("question_id", "session", F.col("z.haystack_dates").alias("date"), F.posexplode("z.haystack_sessions").alias("turn", "m"))
    return t.select("question_id", "session", "date", "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def question_prompt(entries: DataFrame) -> DataFrame:
    """(question_id, prompt): the date, the instruction (another one for abstention) and the question, a blank line apart."""
    from pyspark.sql import functions as F

    rule = F.when(F.col("question_id").endswith("_abs"), "Answer from memory; if the memories do not tell, say that you do not know.").otherwise("Answer from memory, as short as possible.")
    return entries.select("question_id", F.concat_ws("\n\n", F.concat(F.lit("Date: "), "question_date"), rule, "question").alias("prompt"))
