"""A corpus from raw documents: five stages, each one operator of ``pathweave.llm``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.

A null text counts as an empty one, and the first stage rejects it as a text without a letter; an empty table
gives empty tables. Rows are judged on their whole texts, however long; columns of any other names pass
through, also those that an operator uses itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm import chunk_dedup, language_id, near_dedup, packing, quality
from pathweave.llm.common import table, tune, written
from pathweave.llm.queries import tokenizer_file

#: A text of so many n-grams or more whose best language explains less than this share of them is in no
#: known language. Of shorter texts nothing is concluded.
LEAST_GRAMS, LEAST_KNOWN = 40, 0.2


def _aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of the names that an operator adds under other names, and the way back."""
    own = {c: f"__own_{c}" for c in docs.columns if c in added}
    return docs.withColumnsRenamed(own), lambda df: df.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no learned language explains; repeated rows go or stay
    together. Where no row has a language nothing is learned and all rows go."""
    tune(spark)
    free, back = _aside(docs, ["lang_pred", "score", "known_share", "n_grams"])
    out = language_id.identify(free, language_id.fit(docs))
    known = (F.col("known_share") >= LEAST_KNOWN) | (F.col("n_grams") < LEAST_GRAMS)
    return out.where((F.col("lang_pred") != language_id.UNDETERMINED) & known).transform(back)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the positive-unlabelled classifier doesn't predict to be good.

    Without a text marked good there is nothing to learn from: all score 0.5 and go."""
    tune(spark)
    free, back = _aside(docs, ["score", "predicted"])
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(free, model).where("predicted = 1").transform(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the least id.

    Near duplicates share 0.8 of their five-word shingles. Rows without an id or without words stay; of rows
    that share an id all stay or go together.
    """
    tune(spark)
    verdicts = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(written(verdicts, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of over 50 words that occurred in an earlier document out of the texts; texts left empty go.

    "Earlier" is a smaller id. A passage that repeats only within one document stays; rows that share an id
    keep to their own texts; rows without an id stay as they are.
    """
    tune(spark)
    had_words = F.trim(F.coalesce(F.col("text"), F.lit(""))) != ""
    return chunk_dedup.without_repeats(docs).where(had_words).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 1024 tokens; a row for each piece, also of repeated rows."""
    tune(spark)
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: Trained models, MinHash links and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
