"""A training corpus from `documents` in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the
tables between stages are written as Parquet.  All stages but the last return the columns of
`documents`.

Every stage takes empty tables, and columns of any further names, which it keeps.  Null ids and
rows that share an id are rows of their own unless a stage says otherwise; texts are read whole,
however long.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, phrases, simhash, toxicity
from quire.llm.common import release, written

#: The vocabulary of the last stage.
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of texts that a task of it holds: fewer than by default, beside what workers keep of the stages before.
BLOCK_BYTES = 6 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold; documents that score 0.5 or more go.

    Null and empty texts score by the bias alone; repeated rows score alike; 0.5 itself goes.
    Without labels of both kinds nothing is learned and all documents stay.
    """
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Null, empty and wordless texts share the fingerprint zero and are one group.  Rows without an
    id stay; repeated rows with the group's smallest id all stay; of rows that share an id each
    goes or stays by its own text.
    """
    return simhash.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 20 words or more that occur earlier; a document that loses every word goes.

    Null, empty and short texts stay as they are.  Rows without an id come first; unlike texts of
    one id come in the order of a hash; equal rows count as one document and are cut alike.  A cut
    text is its other words joined by one space, with n_chars counted anew.
    """
    found = phrases.cut(docs).where("n_removed = 0 OR document.text <> ''")
    length = F.when(F.col("n_removed") > 0, F.length("document.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("document.n_chars"))
    return found.select(*((length if c == "n_chars" else F.col(f"document.`{c}`")).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go.

    Null and wordless texts stay; without items all documents do.
    """
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of every document, their number, and the digest of the text that they decode to.

    Null and empty texts have no tokens; repeated rows are encoded one by one.
    """
    return bpe.tokens(docs, public_tokenizers.path(TOKENIZER), BLOCK_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can express neither the fitted classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release()
    return STAGES[-1][1](spark, docs, sf_dir)
