"""The corpus pipeline: five stages, each an operator of ``colprism.llm`` applied to all that the stage before kept.

``run`` writes what a stage returns as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colprism.llm import decontaminate, jaccard_join, language, mixing, token_store
from colprism.llm.common import fold, table, written

#: A language prediction below this cosine, no more than chance gives, rejects a document; so does a text without letters.
LEAST_SCORE = 0.05


def _set_aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with other names for its own columns that an operator's columns would replace."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})


def _given_back(found: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    return found.select(*[F.col(f"__own_{c}").alias(c) if c in names else F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or like no learned language, go; all others stay as they are.

    Prototypes come from the documents' own languages, without the held-out third.
    """
    prototypes = language.train_prototypes(docs.where(fold() != 1))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = ["lang_pred", "score"]
    found = language.identify(_set_aside(docs, names), prototypes)
    kept = found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return _given_back(kept, docs, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: of each group the document of the smallest id stays.

    Of repeated rows of that id and text one stays. Documents without words, and those without id, are their own group.
    """
    groups = written(jaccard_join.similar_groups(docs, shingle_words=5, percent=80), "groups")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    if groups.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("__mark", F.xxhash64("text")).dropDuplicates(["doc_id", "__mark"]).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wu-Manber search: documents with a twentieth of their words inside benchmark passages go."""
    names = ["n_words", "n_hit", "hit_words", "items", "hit_more", "items_more"]
    found = decontaminate.find_occurrences(_set_aside(docs, names), table(spark, sf_dir, "benchmark"))
    return _given_back(found.where(~decontaminate.contaminated()), docs, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entropy balancing: every document as often as the mix takes it, or not at all."""
    return mixing.apply_mix(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary store; the rows are what the store holds, read back."""
    import public_tokenizers

    return token_store.tokens_of(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("tokens", store_tokens),
]

#: SQL can't state the language prototypes, the tokenizer or the rounding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
