"""From raw documents to token ids: five stages, each a table the next one reads.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.  A stage is called on the
written result of the one before, so when it begins, the tables that the earlier
stage's operators left in the shared folder are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import jaccard, linededup, mixing, quality, sentencepieces
from tilewright.llm.common import MADE, delete, documents, materialize, release
from tilewright.llm.queries import tokenizer


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete(spark, _left.pop())
        before = set(MADE)
        out = f(spark, docs, sf_dir)
        _left.extend(p for p in MADE if p not in before)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted, and documents all of whose lines are."""
    return linededup.remove_line_runs(docs)


@stage
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.keep_representatives(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the schedule of their source takes them."""
    return mixing.mix(docs)


@stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip and ids."""
    return sentencepieces.code(docs, tokenizer("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources", mix_sources),
    ("SentencePiece", sentencepiece),
]

#: Byte-pair encoding has no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, f in STAGES:
        done = materialize(f(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = done
    return docs
