"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, place long, kind int, size string, point long"


def prose(n: int, seed: int = 0) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["th", "on", "er", "an", "ti", "é", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    """Null and empty texts, null metadata and ids, a very long text, ties and repeated rows."""
    texts = [None, "", " \n\t ", "one", prose(30, 1), prose(30, 1), prose(3000, 2), prose(400, 3), "x" * 5000, "🙂 ▁ \0 é\n\n  end "]
    out = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None if t is None else len(t), 1.0, i, 1, "a", 5) for i, t in enumerate(texts)]
    return out + [out[4], out[7], (None, prose(40, 4), "en", "s", 10, 0.0, 0, 0, "", 0), (None, None, None, None, None, None, None, None, None, None)]


def table(spark, items=None):
    return spark.createDataFrame(rows() if items is None else items, SCHEMA)


def texts_table(spark, texts: dict):
    return table(spark, [(k, v, "en", "s", len(v or ""), None, None, None, None, None) for k, v in texts.items()])


def stored(spark, df, tmp_path, name="documents"):
    """The rows as a table read from files."""
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return spark.read.parquet(f"{tmp_path}/{name}.parquet")
