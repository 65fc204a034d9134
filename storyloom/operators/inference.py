"""Input tables for batch inference: one text per article and a batch number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.operators.ranking import ranked


def article_prompt(body_chars: int) -> Column:
    """Labelled lines of an article; the body is cut to the model's input budget."""
    line = lambda label, value: F.concat(F.lit(label + ": "), value)
    return F.concat_ws(
        "\n",
        line("Source", F.col("source")),
        line("Section", F.col("section")),
        line("Title", F.col("title")),
        line("Summary", F.col("summary")),
        line("Body", F.substring("article_text", 1, body_chars)),
    )


def input_batches(articles: DataFrame, batch_size: int = 20, body_chars: int = 6000) -> DataFrame:
    """(id, batch, prompt): consecutive ids share a batch of batch_size rows.

    Numbering runs over ids alone, in two levels, so no task orders the whole table or its texts.
    """
    ids = articles.select("id").withColumn("__all", F.lit(0))
    numbered = ranked(ids, ["__all"], [F.floor(F.col("id") / 65_536)], [F.col("id").asc()], "place")
    batches = numbered.select("id", F.floor((F.col("place") - 1) / batch_size).alias("batch"))
    return articles.select("id", article_prompt(body_chars).alias("prompt")).join(batches, "id")
