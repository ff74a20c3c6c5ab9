"""The training-corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.decontaminate import without_leaks
from loomgraph.llm.mixing import pivotal_mix
from loomgraph.llm.ngram_jaccard import ngram_jaccard_join
from loomgraph.llm.token_output import token_digest, write_tokens
from loomgraph.llm.toxicity import without_toxic
from loomgraph.storage import new_path, stored

#: Learned scores, random rounding and a file format have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
#: A row's own number within a stage: ids may be null or repeat.
ROW = "_row"
#: Names of so many files are broadcast at most.
MOST_FILES = 1 << 15


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW: the number of a row's file above its place in it, which every reading gives it again.

    Docs that aren't read from so many files are written out with numbers, so that these stay."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        placed = None
    files = stored(placed.select("_file").distinct(), "files") if placed else None
    if files is None or files.count() > MOST_FILES:
        return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    number = F.row_number().over(Window.orderBy("_file")).cast("long")  # a row for each file
    files = stored(files.withColumn("_number", number), "files")
    return placed.join(F.broadcast(files), "_file").withColumn(ROW, F.shiftleft("_number", 40) + F.col("_at")).select(*docs.columns, ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores 0.3 or more go."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, one with the smallest id stays.

    Rows are linked by their own numbers, so repeats of a row go and rows of one id with other texts are judged apart.
    Rows without an id stay, for they link with nothing."""
    rows = _numbered(docs)
    found = ngram_jaccard_join(rows.where("doc_id is not null"), ROW).select(ROW, "component_id")
    member = stored(rows.select(ROW, "doc_id").join(found, ROW), "members")
    first = member.groupBy("component_id").agg(F.min(F.struct("doc_id", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = stored(member.select(ROW).join(first, ROW, "left_anti"), "copies")
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, all columns kept.

    Draws follow from ids and texts, copies are counted by row number."""
    rows = _numbered(docs)
    mixed = pivotal_mix(rows.withColumn("_draw", F.xxhash64("doc_id", "text")), "_draw", key_col=ROW)
    copies = stored(mixed.where("copies > 0").select(ROW, F.col("copies").cast("int").alias("_copies")), "copies")
    joined = rows.join(copies, ROW)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Huffman-coded token files of what is left, told by document as they are read back."""
    import public_tokenizers

    folder = new_path(spark, "token-files")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        write_tokens(docs, folder, f.read(), end_id=2)
    return token_digest(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
