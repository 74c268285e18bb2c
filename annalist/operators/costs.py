"""What a run of each system on each tier costs before it runs: tokens by calls, prices, and the fee of the tier that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions import rules as R

#: Prices in dollars a token, and tokens of a judge's, an answerer's and a retrieval's call: fixed values.
PRICE_IN, PRICE_OUT = 3e-6, 15e-6
EMBEDDING = {"openai": 0.02e-6, "zeroentropy": 0.05e-6}
JUDGE, ANSWERER, RETRIEVAL = (2500, 4500), (4000, 3500), (3200, 400)
PROMPT = 500
#: Systems: calls an artifact, tokens out of each, retrieval calls a question, who runs the model, whose embeddings: fixed values.
PROFILES = [("mem0", 1.2, 150, 0, "anthropic", "openai"), ("mem0-platform", 1.2, 150, 0, "hosted", "hosted"), ("graphiti", 17.0, 600, 0, "anthropic", "openai"), ("zep-cloud", 17.0, 600, 0, "hosted", "hosted"), ("gbrain", 0.0, 0, 0, "anthropic", "zeroentropy"), ("graphify-oss", 3.0, 300, 0, "anthropic", "none")]
#: Hosted tiers: system, tier, fee a month, most units and most questions; units an artifact: fixed values.
TIERS = [("mem0-platform", "free", 0, 10_000, 1_000), ("mem0-platform", "starter", 19, 50_000, 5_000), ("mem0-platform", "growth", 79, 200_000, 20_000), ("mem0-platform", "pro", 249, 500_000, 50_000), ("zep-cloud", "free", 0, 1_000, 1 << 40), ("zep-cloud", "flex", 125, 100_000, 1 << 40)]
UNITS = {"mem0-platform": 1.5, "zep-cloud": 1.0}


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "system string, calls double, calls_out int, retrieval int, llm string, embed string")


def estimate(sizes: DataFrame) -> DataFrame:
    """Every system on every tier (tier, artifacts, tokens, questions): ingest, query, judge and embedding dollars, the fee, and all in.

    Both sides are a few rows of parameters. A hosted system bills only judge and answers, and the cheapest tier that holds it;
    a fee of -1 means that none does.
    """
    spark = sizes.sparkSession
    n, q, tokens = F.col("artifacts"), F.col("questions"), F.col("tokens")
    cells = profiles(spark).crossJoin(F.broadcast(sizes))
    hosted = F.col("llm") == "hosted"
    own = lambda x: F.when(hosted, 0.0).otherwise(x)
    per = lambda calls, pair: R.token_cost(calls * pair[0], calls * pair[1], PRICE_IN, PRICE_OUT)
    ingest = own(R.token_cost(n * F.col("calls") * (R.share(tokens, n) + PROMPT), n * F.col("calls") * F.col("calls_out"), PRICE_IN, PRICE_OUT))
    embed = F.coalesce(F.create_map(*[F.lit(x) for pair in EMBEDDING.items() for x in pair])[F.col("embed")], F.lit(0.0)) * tokens
    units = F.floor(n * F.coalesce(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[F.col("system")], F.lit(0.0)))
    cells = cells.withColumns({"ingest_usd": ingest, "query_usd": own(per(q * F.col("retrieval"), RETRIEVAL)) + per(q, ANSWERER), "judge_usd": per(q, JUDGE), "embed_usd": embed, "hosted": hosted, "units": units})
    offers = F.broadcast(spark.createDataFrame(TIERS, "of string, sub_tier string, fee int, most bigint, most_questions bigint"))
    fits = cells.join(offers, (F.col("of") == F.col("system")) & (F.col("units") <= F.col("most")) & (q <= F.col("most_questions")), "left")
    best = fits.groupBy(*cells.columns).agg(F.min_by(F.struct("sub_tier", "fee"), "fee").alias("s"))
    fee = F.when(F.col("hosted"), F.coalesce("s.fee", F.lit(-1))).otherwise(0)
    metered = F.round(F.col("ingest_usd") + F.col("query_usd") + F.col("judge_usd") + F.col("embed_usd"), 2)
    two = lambda c: F.round(c, 2).alias(c)
    return best.select(
        "system", "tier", two("ingest_usd"), two("query_usd"), two("judge_usd"), F.round("embed_usd", 3).alias("embed_usd"), "hosted",
        F.when(F.col("hosted"), F.coalesce("s.sub_tier", F.lit("over"))).otherwise("-").alias("sub_tier"), fee.alias("fee"), R.cell_cost(metered, "hosted", fee).alias("cost"),
    )


def within(cells: DataFrame, budget: float) -> DataFrame:
    return cells.withColumn("included", F.col("cost") < budget)
