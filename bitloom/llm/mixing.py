"""Temperature mixing: source shares to a power, and a schedule of budgeted block permutations.

A source's weight is its token share to the power ``alpha``, normalised.  ``alpha`` lies
between 1 (shares as they are) and 0 (all sources alike) and is bisected: the largest
that reaches the target entropy, raised where a source would be repeated beyond the
limit.  A budget of tokens times the weight is a source's quota; it is met by whole
epochs, each a new permutation of the source's documents, and one last epoch that
stops where the quota is used up.  A draw's place in its source's run of epochs puts it
in a block, so every block holds the sources at their weights.

Everything but ``alpha`` stays distributed: the last epoch's cut is one threshold per
source, found from token sums of hashed buckets and the rows of one bucket.

Edge cases: null sources form a source; null texts have no tokens; a source without
tokens has no weight and its documents are drawn once; repeated rows share their draws'
places, so they are drawn or left together; one source gets weight 1; an empty table
gives an empty result; other columns pass through :func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from bitloom.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
#: Share of the largest possible entropy, ln(sources), that the weights shall reach.
TARGET_ENTROPY = 0.98
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 1_000_000
#: Documents in a hashed bucket, and most buckets a source has.
BUCKET_DOCS = 1000
MOST_BUCKETS = 100_000
_STEPS = 16


def token_count(text: Column) -> Column:
    """Blank-separated words stand for tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _unit(*parts: Column) -> Column:
    """A hash of the parts as a number from 0 to below 1."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def curve(shares: DataFrame, alphas: list[float], budget: float | None) -> list[dict]:
    """For each exponent the norm, the entropy and the most epochs a source is repeated, in one aggregation."""
    p, found = F.col("share"), []
    for a in alphas:
        found += [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.ln(p)), F.max(F.pow(p, F.lit(a - 1))), F.max(F.pow(p, F.lit(1 - a)))]
    row = shares.agg(*[c.alias(f"c{i}") for i, c in enumerate(found)]).first()
    out = []
    for i, a in enumerate(alphas):
        norm, weighted, most, least = row[4 * i : 4 * i + 4]
        # no budget given: the smallest that uses every source at least once
        times = norm * least if budget is None else budget
        out.append({"alpha": a, "norm": norm, "entropy": math.log(norm) - a * weighted / norm, "epochs": times * most / norm, "times": times})
    return out


def solve(shares: DataFrame, n_sources: int, target_entropy: float | None, max_epochs: float | None, budget: float | None) -> dict:
    """Exponent, norm and budget (as a multiple of all tokens) by repeated section of [0, 1].

    Entropy and repetition both fall as the exponent grows; the repetition limit wins.
    """

    def search(fits_low) -> tuple[float, float]:
        """Bounds, low and high, of the exponent up to which ``fits_low`` holds."""
        low, high = 0.0, 1.0
        for _ in range(8):
            grid = [low + (high - low) * k / _STEPS for k in range(1, _STEPS)]
            holds = [fits_low(x) for x in curve(shares, grid, budget)]
            k = sum(holds)
            low, high = ([low, *grid][k], [*grid, high][k])
        return low, high

    alpha = 1.0
    if target_entropy is not None:
        wanted = target_entropy * math.log(n_sources) if n_sources > 1 else 0.0

        def entropic(x) -> bool:
            return x["entropy"] >= wanted

        alpha = 1.0 if entropic(curve(shares, [1.0], budget)[0]) else search(entropic)[0]  # still entropic
    elif max_epochs is not None:
        alpha = 0.0
    if max_epochs is not None:

        def too_often(x) -> bool:
            return x["epochs"] > max_epochs

        if too_often(curve(shares, [alpha], budget)[0]):
            alpha = max(alpha, search(too_often)[1])  # no longer too often
    return curve(shares, [alpha], budget)[0]


def plan(rows: DataFrame, target_entropy: float | None, max_epochs: float | None, budget_times: float | None, seed: int) -> tuple[DataFrame | None, dict]:
    """One row per source: weight, epochs, whole epochs and the last epoch's threshold.

    ``rows`` has doc_id, source_key and tokens and is cheap to read again.
    """
    totals = settle(rows.groupBy("source_key").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")), "mix-totals")
    everything = totals.agg(F.sum("total").alias("t"), F.sum((F.col("total") > 0).cast("int")).alias("n")).first()
    if not everything["t"]:
        return None, {"alpha": 1.0, "tokens": 0}
    shares = totals.where("total > 0").withColumn("share", F.col("total") / F.lit(float(everything["t"])))
    solved = solve(shares, everything["n"], target_entropy, max_epochs, budget_times)
    epochs = F.lit(solved["times"] / solved["norm"]) * F.pow("share", F.lit(solved["alpha"] - 1))
    sources = shares.withColumn("weight", F.pow("share", F.lit(solved["alpha"])) / solved["norm"])
    sources = sources.withColumn("epochs", F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs))
    sources = sources.withColumn("whole", F.floor("epochs").cast("int")).withColumn("quota", (F.col("epochs") - F.floor("epochs")) * F.col("total"))
    sources = sources.withColumn("buckets", F.least(F.greatest(F.ceil(F.col("docs") / BUCKET_DOCS), F.lit(1)), F.lit(MOST_BUCKETS)))
    sources = settle(sources.select("source_key", "weight", "epochs", "whole", "quota", "buckets"), "mix-sources")
    # the last epoch: token sums by bucket, the bucket where the quota ends, the threshold in it
    last = rows.join(sources, "source_key").where("quota > 0").withColumn("u", _unit(F.col("doc_id"), F.col("whole"), F.lit(seed))).withColumn("bucket", F.floor(F.col("u") * F.col("buckets")))
    sums = last.groupBy("source_key", "bucket").agg(F.sum("tokens").alias("t"), F.first("quota").alias("quota"))
    run = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("source_key").orderBy("bucket")))
    cut = run.where((F.col("upto") > F.col("quota")) & (F.col("upto") - F.col("t") <= F.col("quota"))).groupBy("source_key").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("cut"))
    cut = cut.select("source_key", F.col("cut.bucket").alias("bucket"), F.col("cut.before").alias("before"))
    # equal places are taken together: the running sum's default frame goes over peers
    inside = last.join(cut, ["source_key", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("source_key").orderBy("u")))
    edge = inside.groupBy("source_key").agg(F.min(F.when(F.col("upto") > F.col("quota"), F.col("u"))).alias("edge"))
    return settle(sources.join(edge, "source_key", "left"), "mix-plan"), {"alpha": solved["alpha"], "tokens": everything["t"] * solved["times"]}


def mix(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_epochs: float | None = MAX_EPOCHS, budget_times: float | None = 1.0, block_tokens: int = BLOCK_TOKENS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with one row per draw and columns mix_epoch, mix_block, mix_place and mix_weight.

    ``budget_times`` is the budget as a multiple of all tokens; None takes the smallest
    budget that draws every document at least once.  The documents aren't shuffled where
    the plan, a row per source, is small enough for Spark to broadcast.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    counted = settle(docs.select(F.col(id_col).alias("doc_id"), key.alias("source_key"), token_count(F.col(text_col)).alias("tokens")), "mix-tokens")
    sources, found = plan(counted, target_entropy, max_epochs, budget_times, seed)
    blocks = max(1, math.ceil(found["tokens"] / block_tokens))
    names = ("weight", "epochs", "whole", "edge", "quota")
    nothing = {"weight": F.lit(0.0), "epochs": F.lit(1.0), "whole": F.lit(1), "edge": F.lit(None).cast("double"), "quota": F.lit(0.0)}
    rows = docs.withColumn("_mix_key", key)
    if sources is None:
        rows = rows.withColumns({f"_mix_{n}": nothing[n] for n in names})
    else:
        rows = rows.join(sources.select(F.col("source_key").alias("_mix_key"), *[F.col(n).alias(f"_mix_{n}") for n in names]), "_mix_key", "left")
        rows = rows.withColumns({f"_mix_{n}": F.coalesce(f"_mix_{n}", nothing[n]) for n in names})

    def c(name: str) -> Column:
        return F.col(f"_mix_{name}")

    epochs = F.when(c("quota") > 0, F.sequence(F.lit(0), c("whole"))).when(c("whole") > 0, F.sequence(F.lit(0), c("whole") - 1)).otherwise(F.array().cast("array<int>"))
    drawn = rows.withColumn("mix_epoch", F.explode(epochs)).withColumn("_mix_u", _unit(F.col(id_col), F.col("mix_epoch"), F.lit(seed)))
    drawn = drawn.where((F.col("mix_epoch") < c("whole")) | c("edge").isNull() | (F.col("_mix_u") < c("edge")))
    place = F.least((F.col("mix_epoch") + F.col("_mix_u")) / c("epochs"), F.lit(1 - 1e-12))
    drawn = drawn.withColumn("mix_place", place).withColumn("mix_block", F.floor(place * blocks)).withColumn("mix_weight", c("weight"))
    return drawn.drop("_mix_key", "_mix_u", *[f"_mix_{n}" for n in names])
