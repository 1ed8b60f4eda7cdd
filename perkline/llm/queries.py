"""Registered queries of the subpackage, one per operator, each beside its oracle SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkline.llm import collocations, lexical_search, line_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files in doc_id order and read back."""
    from perkline.llm import shared, token_files

    manifest = token_files.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), shared.new_folder(spark, "token-files"))
    return token_files.read(manifest)


@register("op7_line_rules", line_rules.ORACLE)
def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every text, and whether enough of it stands outside its host's common lines."""
    return line_rules.judge(table(spark, sf_dir, "documents"))


@register("op1_pattern_packing")
def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of at most 2048 tokens."""
    from perkline.llm import packing, shared

    pieces = shared.stored(packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")), "pieces")
    return packing.packed(pieces).drop("copy")


@register("op6_merge_pieces")
def op6_merge_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    from perkline.llm import merge_pieces

    return merge_pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@register("op5_byte_cnn")
def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every text, from labelled documents outside the held-out third."""
    from perkline.llm import byte_cnn

    docs, held_out = table(spark, sf_dir, "documents"), byte_cnn.fold(F.col("doc_id"), 3, 1)
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"), held_out=held_out)
    return byte_cnn.scored(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@register("op10_language_masks")
def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents outside the held-out quarter."""
    from perkline.llm import byte_cnn, language_masks

    docs, held_out = table(spark, sf_dir, "documents"), byte_cnn.fold(F.col("doc_id"), 4, 2)
    masks = language_masks.learned(docs.filter(~held_out))
    return language_masks.identified(docs, masks).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op8_grid_join")
def op8_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    from perkline.llm import grid_join

    return grid_join.linked(table(spark, sf_dir, "embeddings"))


@register("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without passages of 50 words that a smaller document has."""
    from perkline.llm import repeats

    return repeats.repeats(table(spark, sf_dir, "documents"))


@register("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are alike by 0.75 or more."""
    from perkline.llm import jaccard_join

    return jaccard_join.joined(table(spark, sf_dir, "documents"))


@register("op4_suffix_tree")
def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every text by the tree and by plain word counts."""
    from perkline.llm import byte_cnn, suffix_tree

    return suffix_tree.scored(table(spark, sf_dir, "documents"), byte_cnn.fold(F.col("doc_id"), 7, 2))


@register("op11_tiled_search", lexical_search.ORACLE)
def op11_tiled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_collocations", collocations.ORACLE)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language by how far they exceed what their parts foretell."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@register("op13_warc_chunks", warc.ORACLE)
def op13_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, and what reading those back finds."""
    from perkline.llm import shared

    manifest = warc.write(table(spark, sf_dir, "pages"), shared.new_folder(spark, "warc"))
    return warc.records(warc.read(manifest, with_data=False))
