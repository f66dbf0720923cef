"""Texts from files, chats and pages; findings as reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024


def scan_files(spark: SparkSession, *paths: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, text) of files below the paths; larger files and such that are not UTF-8 are left out. The size filter reaches the file listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).where(F.col("length") <= most)
    text = F.expr("try_validate_utf8(cast(content as string))")
    return raw.select("path", text.alias("text")).where(F.col("text").isNotNull())


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("text"))


def chat_texts(body: str = "body") -> Column:
    """The texts of a chat or completion request in JSON: string contents, the text parts of lists, and the prompt."""
    schema = "struct<messages:array<struct<role:string,content:string>>,prompt:string>"
    parts = "from_json(m.content, 'array<struct<type:string,text:string>>')"
    return F.expr(f"""element_at(transform(array(from_json({body}, '{schema}')), b -> concat(
      flatten(transform(coalesce(b.messages, cast(array() as array<struct<role:string,content:string>>)), m -> if(m.content like '[%' and {parts} is not null,
        transform(filter({parts}, p -> p.type = 'text' and p.text is not null), p -> p.text), filter(array(m.content), c -> c is not null)))),
      filter(array(b.prompt), p -> p is not null))), 1)""")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of a folder's text files by line; what crosses a line's end is not seen whole."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def line_and_column(text: str, at: str) -> tuple[Column, Column]:
    """Line and column, from 1, of a character."""
    before = f"left({text}, {at})"
    line = F.expr(f"1 + length({before}) - length(replace({before}, '\\n', ''))")
    column = F.expr(f"1 + length(substring_index({before}, '\\n', -1))")
    return line, column


def sarif(findings: DataFrame, path: str = "path", text: str = "text", tool: str = "cloakframe", keep: tuple[str, ...] = ()) -> DataFrame:
    """One SARIF result in JSON for each finding (path, text, start, end, entity_type)."""
    line, column = line_and_column(text, "start")
    rule = F.concat(F.lit(f"{tool.upper()}/"), "entity_type")
    place = F.struct(F.struct(F.struct(F.col(path).alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine"), column.alias("startColumn")).alias("region")).alias("physicalLocation"))
    return findings.select(*keep, F.to_json(F.struct(rule.alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.concat(F.col("entity_type"), F.lit(" detected")).alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def sarif_logs(findings: DataFrame, path: str = "path", text: str = "text", tool: str = "cloakframe") -> DataFrame:
    """(path, log): a whole SARIF 2.1.0 document for each file, with the tool, its rules and the results."""
    results = sarif(findings.withColumn("__path", F.col(path)).withColumn("__type", F.col("entity_type")), path, text, tool, ("__path", "__type", "start"))
    rules = "transform(array_sort(collect_set(__type)), t -> named_struct('id', concat('{}/', t), 'name', t))".format(tool.upper())
    whole = results.groupBy("__path").agg(F.sort_array(F.collect_list(F.struct("start", "result"))).alias("rows"), F.expr(rules).alias("rules"))
    head = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":'), F.to_json("rules"), F.lit('}},"results":['))
    return whole.select(F.col("__path").alias("path"), F.concat(head, F.array_join(F.transform("rows", lambda r: r["result"]), ","), F.lit("]}]}")).alias("log"))


def code_quality(findings: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One code-quality issue in JSON for each finding; its fingerprint is path, start and end."""
    line, _ = line_and_column(text, "start")
    issue = F.struct(F.concat(F.col("entity_type"), F.lit(" detected")).alias("description"), F.col("entity_type").alias("check_name"), F.concat_ws(":", path, "start", "end").alias("fingerprint"), F.lit("major").alias("severity"), F.struct(F.col(path).alias("path"), F.struct(line.alias("begin")).alias("lines")).alias("location"))
    return findings.select(F.to_json(issue).alias("issue"))


def sql_model_hits(models: DataFrame, text: str = "text") -> DataFrame:
    """SQL texts that seem to carry an address or a phone number."""
    email = F.col(text).rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    phone = F.col(text).rlike(r"\+[0-9][0-9 .()-]{7,}[0-9]")
    return models.withColumn("has_email", email).withColumn("has_phone", phone)
