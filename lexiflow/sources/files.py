"""Lenient readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns every corpus record has.
RECORD = ("id", "source", "title", "text", "url")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object over several lines, or JSON lines: whichever gives rows."""
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    lines = read_jsonl(spark, path, schema)
    return lines if lines.count() >= whole.count() else whole


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """book, text of every .txt file of a folder."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("book"), F.col("value").alias("text")).orderBy("book")


def complete(df: DataFrame) -> DataFrame:
    """Missing record columns as empty texts."""
    return df.select(*df.columns, *[F.lit("").alias(c) for c in RECORD if c not in df.columns]).fillna("", subset=[c for c in RECORD])


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_runs(spark: SparkSession, folder: str, schema: str, dimensions: list[str]) -> DataFrame:
    """Result files in a tree: the folders above a file are its dimensions, innermost last."""
    parts = F.split(F.input_file_name(), "/")
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metrics.json").json(folder)
    return df.select("*", *[F.element_at(parts, -(len(dimensions) - i + 1)).alias(d) for i, d in enumerate(dimensions)])


def next_version(spark: SparkSession, path: str, most: int = 100) -> str:
    """``path``, or the first of path_v2, path_v3, ... that does not exist."""
    jvm = spark.sparkContext._jvm
    for i in range(1, most + 1):
        out = path if i == 1 else f"{path}_v{i}"
        p = jvm.org.apache.hadoop.fs.Path(out)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return out
    raise FileExistsError(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def manifest(df: DataFrame, by: str, nothing: str = "(none)") -> DataFrame:
    """Counts per value as one JSON text, rows without a value under ``nothing``. One row of all values: for columns of
    few values, such as sources."""
    name = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit(nothing)).alias("_by")
    pairs = df.groupBy(name).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_by", "n")))).alias("counts"))
    return pairs.select(F.to_json(F.struct("counts")).alias("manifest"))


def write_manifest(df: DataFrame, by: str, path: str) -> None:
    """The manifest as one text file of a folder."""
    manifest(df, by).coalesce(1).write.mode("overwrite").text(path)


def read_xml_articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, journal, year, malformed of every article of XML files: the parts of an abstract joined by
    a blank, its year a number or null. A record that cannot be read is one row with its text in ``malformed``; an
    article without a title or abstract has an empty one."""
    part = "struct<_VALUE:string,_Label:string>"
    schema = f"MedlineCitation struct<PMID:struct<_VALUE:string,_Version:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<{part}>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>>>, malformed string"
    rows = spark.read.schema(schema).option("rowTag", "PubmedArticle").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").format("xml").load(path)
    a = F.col("MedlineCitation.Article")
    texts = F.filter(F.transform(a["Abstract"]["AbstractText"], lambda x: F.trim(x["_VALUE"])), lambda x: x.isNotNull() & (x != ""))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    year = F.coalesce(date["Year"], F.regexp_extract(date["MedlineDate"], r"\b(\d{4})\b", 1)).try_cast("int")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.select(F.col("MedlineCitation.PMID._VALUE").alias("pmid"), text(a["ArticleTitle"]).alias("title"), F.coalesce(F.array_join(texts, " "), F.lit("")).alias("abstract"), text(a["Journal"]["Title"]).alias("journal"), year.alias("year"), "malformed")
