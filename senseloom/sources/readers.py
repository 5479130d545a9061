"""Readers of external formats, each as one DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from senseloom.operators.text import strip_spans

# Words whose vectors are listed under another form, and a word that takes another one's vectors.
FORMS = {"lentil": "lentils", "tomato": "tomatoes", "child": "children", "canoe": "canoeing", "television": "televisions"}
ALIASES = {"skyscrapers": "skyscraper"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their number from 0 in each file.

    Numbers come from the order within each split and the splits' counts, a narrow table: no file passes through one task.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return raw.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("id") - F.col("least")).alias("line"), "value")


def select_files(df: DataFrame, prefix: str = "", first: int | None = None, last: int | None = None) -> DataFrame:
    """Keep rows of files whose name starts with ``prefix`` and whose number (all its digits in a row) is in [first, last]."""
    name = F.col("_metadata.file_name")
    number = F.regexp_replace(name, "[^0-9]", "").cast("long")
    keep = name.startswith(prefix)
    return df.where(keep & number.between(first, last) if first is not None and last is not None else keep)


def wiki_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(guid, text): guid is the part of id before its colon."""
    rows = spark.read.schema("id string, metadata struct<paragraph_:string>").json(path)
    return rows.select(F.split_part("id", F.lit(":"), F.lit(1)).alias("guid"), F.col("metadata.paragraph_").alias("text"))


def cord_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, guid, text): guid is the number of the line in its file."""
    return lines(spark, path).select("file", F.col("line").alias("guid"), F.get_json_object("value", "$.text").alias("text"))


def cord_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(uid, abstract, json_path): the first of the listed paths; rows without abstract are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    uid, abstract, paths = (F.col(f"`{rows.columns[i]}`") for i in (0, 8, 15))
    return rows.where(F.coalesce(abstract, F.lit("")) != "").select(uid.alias("uid"), abstract.alias("abstract"), F.trim(F.split(paths, ";")[0]).alias("json_path"))


def cord_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, text): body texts with their citations removed."""
    rows = spark.read.schema("body_text array<struct<text:string,cite_spans:array<struct<start:int,end:int,text:string>>>>").option("multiLine", True).json(path)
    parts = rows.select(F.input_file_name().alias("file"), F.posexplode("body_text").alias("section", "b"))
    spans = F.coalesce(F.col("b.cite_spans"), F.array().cast("array<struct<start:int,end:int,text:string>>"))
    return parts.select("file", F.col("section").cast("long").alias("section"), strip_spans(F.col("b.text"), spans).alias("text"))


def _xml(spark: SparkSession, path: str, one, schema: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.strip().split()[0] for x in schema.split(",")]
        for b in batches:
            yield pd.DataFrame([row for text in b["value"] for row in one(ElementTree.fromstring(text.encode()))], columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(parse, schema)


def semeval_2010(spark: SparkSession, path: str) -> DataFrame:
    """(inst_id, lemma, sentence): elements are named by instance, their first child holds the target sentence; ``nth`` is its place in the file."""

    def one(root: ElementTree.Element) -> Iterator[tuple]:
        for i, child in enumerate(root):
            yield child.tag, child.tag.split(".")[0], "".join(child[0].itertext()), i

    return _xml(spark, path, one, "inst_id string, lemma string, sentence string, nth long")


def semeval_2013(spark: SparkSession, path: str, gold: DataFrame) -> DataFrame:
    """(inst_id, text, target, which): the text in lower case, its target and how many targets stand before; only instances in ``gold`` (inst_id)."""

    def one(root: ElementTree.Element) -> Iterator[tuple]:
        for word in root:
            for inst in word:
                before, target, after = inst.find("context").itertext()
                yield inst.attrib["id"], (before + target + after).replace("  ", " ").lower(), target.lower(), before.count(f" {target} ")

    rows = _xml(spark, path, one, "inst_id string, text string, target string, which long")
    return rows.join(gold.select("inst_id").distinct(), "inst_id", "left_semi")


def gold_key(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, inst_id, senses): whitespace-separated; senses may carry a weight after a slash."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 3)
    return parts.select(F.col("p")[0].alias("lemma"), F.col("p")[1].alias("inst_id"), F.slice("p", F.lit(3), F.size("p")).alias("senses"))


def wic(spark: SparkSession, data: str, gold: str | None = None) -> DataFrame:
    """(item, word, loc1, loc2, sent1, sent2, gold): gold is joined by line and null without a gold file."""
    parts = lines(spark, data).select("line", F.split("value", "\t").alias("p"))
    place = F.split(F.col("p")[2], "-")
    rows = parts.select(F.col("line").alias("item"), F.col("p")[0].alias("word"), place[0].cast("int").alias("loc1"), place[1].cast("int").alias("loc2"), F.split(F.col("p")[3], " +").alias("sent1"), F.split(F.col("p")[4], " +").alias("sent2"))
    if gold is None:
        return rows.withColumn("gold", F.lit(None).cast("boolean"))
    return rows.join(lines(spark, gold).select(F.col("line").alias("item"), (F.trim("value") == "T").alias("gold")), "item", "left")


def outlier_groups(spark: SparkSession, path: str) -> DataFrame:
    """(name, inliers, distractor, outliers): lines before the blank one are inliers, the last of them is the distractor; lines after it are outliers."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("name"), F.transform(F.split("value", "\n"), F.trim).alias("w"))
    blank = F.array_position("w", "")
    tail = F.filter(F.slice("w", blank + 1, F.size("w")), lambda x: x != "")
    return text.select("name", F.slice("w", F.lit(1), (blank - 2).cast("int")).alias("inliers"), F.get("w", (blank - 2).cast("int")).alias("distractor"), tail.alias("outliers"))


def sense_vectors(spark: SparkSession, senses: str, vectors: str, words: list[str], forms: dict[str, str] = FORMS, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(word, key, vector) of the listed words: ``senses`` has a word, a tab and its sense names; ``vectors`` (may be bz2) a sense name and numbers per line after one header line."""
    parts = spark.read.text(senses).select(F.split("value", "\t").alias("p"))
    renamed = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair)) if forms else F.create_map().cast("map<string,string>")
    named = parts.select(F.col("p")[0].alias("w"), F.explode(F.split(F.trim(F.col("p")[1]), r"\s+")).alias("key"))
    known = named.where(F.col("w").isin(*words) | F.lower("w").isin(*words) | F.col("w").isin(*forms)).select(F.lower(F.coalesce(renamed[F.col("w")], F.col("w"))).alias("word"), "key")
    rows = spark.read.text(vectors).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 2)
    held = rows.select(F.col("p")[0].alias("key"), F.slice("p", F.lit(2), F.size("p")).cast("array<double>").alias("vector")).join(known, "key").select("word", "key", "vector")
    for new, old in aliases.items():
        held = held.union(held.where(F.col("word") == old).select(F.lit(new), "key", "vector"))
    return held


def nasari(spark: SparkSession, path: str) -> DataFrame:
    """(word, key, vector, full_lemma) from a JSON map of words to ids to vectors."""
    text = spark.read.text(path, wholetext=True)
    held = text.select(F.explode(F.from_json("value", "map<string,map<string,struct<embs:array<double>,full_lemma:string>>>")).alias("word", "m"))
    return held.select("word", F.explode("m").alias("key", "x")).select("word", "key", F.col("x.embs").alias("vector"), "x.full_lemma")
