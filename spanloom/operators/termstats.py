"""Class-conditional term statistics: document frequencies, mutual information, ratio and direction tests, ranked banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def term_counts(documents: DataFrame, tokens: str, positive: str) -> DataFrame:
    """token, raw_pos, raw_neg, df_pos, df_neg over documents with an array of tokens and a boolean class.

    Tokens are counted within a document before the shuffle, so a frequent token sends one row a document at most.
    """
    distinct = F.explode(F.array_distinct(tokens)).alias("token")
    once = documents.select(F.col(positive).alias("pos"), tokens, distinct)
    times = F.size(F.filter(F.col(tokens), lambda t: t == F.col("token")))
    pos = F.col("pos")
    return once.withColumn("times", times).groupBy("token").agg(
        F.sum(F.when(pos, F.col("times")).otherwise(0)).alias("raw_pos"), F.sum(F.when(~pos, F.col("times")).otherwise(0)).alias("raw_neg"), F.count_if(pos).alias("df_pos"), F.count_if(~pos).alias("df_neg")
    )


def exploded_counts(tokens: DataFrame) -> DataFrame:
    """As term_counts() over rows (doc, pos, token), one a token: summed by document first."""
    pos = F.col("pos")
    per_doc = tokens.groupBy("doc", "pos", "token").agg(F.count("*").alias("times"))
    return per_doc.groupBy("token").agg(
        F.sum(F.when(pos, F.col("times")).otherwise(0)).alias("raw_pos"), F.sum(F.when(~pos, F.col("times")).otherwise(0)).alias("raw_neg"), F.count_if(pos).alias("df_pos"), F.count_if(~pos).alias("df_neg")
    )


def mutual_information(df_pos: Column, df_neg: Column, n_pos: Column, n_neg: Column) -> Column:
    """Of presence and class, in nats, over the four cells; empty cells add nothing."""
    total = (n_pos + n_neg).cast("double")

    def cell(n: Column, row: Column, column: Column) -> Column:
        return F.when(n <= 0, F.lit(0.0)).otherwise(n / total * F.ln(n * total / (row.cast("double") * column)))

    present, absent = df_pos + df_neg, n_pos + n_neg - df_pos - df_neg
    return cell(df_pos, present, n_pos) + cell(df_neg, present, n_neg) + cell(n_pos - df_pos, absent, n_pos) + cell(n_neg - df_neg, absent, n_neg)


def candidate_metrics(counts: DataFrame, sizes: DataFrame, rho: float = 3.0) -> DataFrame:
    """Counts with mi, ratio, eligible and directional, none of them rounded; sizes has one row: n_pos, n_neg. A class without documents is an error."""
    needed = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("n_pos")).otherwise(F.raise_error(F.lit("both classes need documents")).cast("long"))
    both = counts.crossJoin(F.broadcast(sizes.withColumn("n_pos", needed)))  # sizes is a single row of two numbers
    ratio = F.try_divide(F.col("raw_neg"), F.col("raw_pos"))
    out = both.withColumn("mi", mutual_information(F.col("df_pos"), F.col("df_neg"), F.col("n_pos"), F.col("n_neg"))).withColumn("ratio", ratio)
    out = out.withColumn("eligible", F.coalesce((F.col("raw_pos") > 0) & (ratio <= rho), F.lit(False)))
    return out.withColumn("directional", F.col("eligible") & (F.col("df_pos") / F.col("n_pos") > F.col("df_neg") / F.col("n_neg"))).drop("n_pos", "n_neg")


def _order() -> list[Column]:
    return [F.col("mi").desc(), F.col("df_pos").desc(), F.col("token")]


def paper_bank(metrics: DataFrame, size: int = 20) -> DataFrame:
    """The first terms of the ranking of all eligible terms, with paper_rank, and rank among the directional ones of these."""
    top = metrics.where("eligible").orderBy(*_order()).limit(size)
    rank = F.sum(F.col("directional").cast("int")).over(Window.orderBy(*_order())).cast("int")  # over size rows
    return top.withColumn("paper_rank", F.row_number().over(Window.orderBy(*_order()))).withColumn("rank", F.when(F.col("directional"), rank))


def bank(metrics: DataFrame, size: int = 20, complete: bool = False) -> DataFrame:
    """The first terms of the directional ranking: mi, then df_pos, then text. A top-k, so no partition holds all rows.

    complete: fewer terms than size are an error.
    """
    top = metrics.where("directional").orderBy(*_order()).limit(size)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))
    if complete:
        n = F.count("*").over(Window.partitionBy())  # over size rows
        ranked = ranked.withColumn("rank", F.when(n == size, F.col("rank")).otherwise(F.raise_error(F.concat(F.lit(f"{size} terms are needed, found "), n.cast("string"))).cast("int")))
    return ranked
