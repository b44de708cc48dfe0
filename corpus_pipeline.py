"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the docs of the next. All but the last give the columns they got, with the text and
its length as the stage leaves them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import bpe, common, jaccard, language, lines, mixing

# Share of a text's distinct n-grams that some landmark must hold. Texts of a learned language hold
# few others (held-out documents at sf0.1 have 0.67 at least), texts of another script hardly any
# known ones.
LEAST_KNOWN = 0.5
# SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def _with_text(docs: DataFrame, found: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` from the struct ``row`` and a text; ``n_chars`` follows it."""
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(text.alias("text"))
        elif name == "n_chars":
            columns.append(F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("row")[name].alias(name))
    return found.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) and those whose n-grams
    are mostly unknown to all languages; the others carry the predicted language. Repeated rows
    are judged alike, extra columns stay."""
    common.ship(spark)
    whole = docs.select(
        "doc_id", "lang", "text",
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    found = language.identify(whole).where(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("known") >= LEAST_KNOWN))
    return found.select(*[
        F.col("lang_pred").alias("lang") if c == "lang" else F.col("row.whole")[c].alias(c)
        for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document alone. A null text becomes an empty one; rows
    without an id and repeated rows are treated as the operator says."""
    common.ship(spark)
    found = lines.dedup_lines(docs)
    return _with_text(docs, found, F.col("kept").cast("string"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id. Texts without a
    word and rows without an id stay; equal rows of one id are one."""
    common.ship(spark)
    return jaccard.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without a word add nothing to a source
    and go where the mix takes none of them; a null source is a source."""
    common.ship(spark)
    found = mixing.mix(docs).where("copies > 0")
    repeated = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select("row.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with a digest of what they decode to. A null text has no ids."""
    common.ship(spark)
    path = bpe.tokenizer_path()
    found = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded=True)
    return found.select(
        "row.*", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
