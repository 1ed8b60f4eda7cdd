"""Small tables with the cases that every operator has to take."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Extra columns whose names the operators also use inside.
    *[T.StructField(c, T.StringType()) for c in ("words", "n", "host", "copy", "rows", "component_id", "removed", "key1", "score", "batch", "line.x")],
])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [a + b + c for a in ("ka", "Lo", "mi", "tu", "ré") for b in ("n", "st", "") for c in ("a", "or", "ing", "ü")]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(VOCABULARY) + rng.choice([" "] * 9 + [", ", ".\n"]) for _ in range(n)).strip()


def edge_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = [prose(rng, 180) for _ in range(12)]
    passage = prose(rng, 70)
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three four"), (5, "one two three four five"), (6, "ONE two three four FIVE")]
    rows += [(10 + i, t) for i, t in enumerate(base)]
    rows += [(30 + i, base[0]) for i in range(4)]
    rows += [(40 + i, base[1].replace("a ", "o ", 1 + i)) for i in range(5)]
    rows += [(50, base[2] + " " + passage), (51, passage + "\n" + base[3]), (52, prose(rng, 60) + " " + passage + " " + prose(rng, 60))]
    rows += [(60, "ha " * 400), (61, "ha " * 400 + base[4]), (62, prose(rng, 9000)), (63, "x" * 20_000), (64, "日本 語 テスト \x00 \x85 é ½")]
    rows += [(10, base[0]), (None, base[5]), (None, None)]
    return rows


def edge_docs(spark):
    langs, sources = ["en", "de", None], ["a", "b", None]
    rows = [(i, t, langs[k % 3], sources[k % 3], len(t or ""), *["clash"] * 11) for k, (i, t) in enumerate(edge_texts())]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
