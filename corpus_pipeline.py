"""Five-stage corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it
kept, and returns a DataFrame; :func:`run` writes each result as Parquet and
reads it again as the next stage's docs.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.common import configure, fresh_name, materialize, table
from ledgerlens.llm.decontaminate import contamination
from ledgerlens.llm.mixing import mix_to_targets
from ledgerlens.llm.token_files import read_token_index, write_token_files
from ledgerlens.llm.toxicity import THRESHOLD, add_toxicity, fit
from ledgerlens.llm.weighted_minhash import near_duplicates
from ledgerlens.plans.materialize import drop_tables, recorded, scratch

TOKENIZER = "byte_bpe_50k.json"
CACHE_CHUNKS = 100_000  # the workers also hold what the other stages need

_behind: list[str] = []  # tables that the last stage's result is read from


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """Tables behind the stage before go once its result is written, which is
    when ``docs`` no longer reads them."""
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        configure(spark)
        files = docs.inputFiles()
        done = [p for p in _behind if not any(p in f for f in files)]
        _behind[:] = [p for p in _behind if p not in done]
        drop_tables(spark, done)
        with recorded(_behind):
            return fn(spark, docs, sf_dir)
    return run


@_stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the threshold (7)."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    score = fresh_name(docs, "toxicity")
    return add_toxicity(docs, model, score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` in a written table with a number each, and the name
    of its column: ids may be null or repeated, and each row has its own fate."""
    row = fresh_name(docs, "row_number")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (10)."""
    rows, row = _numbered(docs)
    with scratch(spark):
        kept = materialize(near_duplicates(rows, row=row).where("kept").select(row), "kept", keep=True)
    return rows.join(kept, row, "left_semi").select(*docs.columns)


@_stage
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window (2)."""
    rows, row = _numbered(docs)
    with scratch(spark):
        found = contamination(rows, table(spark, sf_dir, "benchmark"), row=row)
        bad = materialize(found.where("contaminated").select(row), "bad", keep=True)
    return rows.join(bad, row, "left_anti").select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its fitted rate asks for (9)."""
    prefix = fresh_name(docs, "mix")
    mixed = mix_to_targets(docs, table(spark, sf_dir, "labels"), prefix=prefix)
    copies = F.col(f"{prefix}_copies")
    times = F.explode(F.sequence(F.lit(1).cast("long"), copies))
    return mixed.where(copies > 0).withColumn(f"{prefix}_copy", times).select(*docs.columns)


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed corpus and their index, read back (4)."""
    import public_tokenizers

    folder = write_token_files(docs, str(public_tokenizers.path(TOKENIZER)), cache=CACHE_CHUNKS, keep_encoder=False)
    return read_token_index(spark, folder)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Trained models and tokenizers are outside SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
