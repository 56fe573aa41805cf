"""Temperature mixing of sources under a token budget.

A source's natural share of tokens p is raised to an exponent and normalised: w = p^a / sum(p^a). a = 1 keeps the
natural mix and a = 0 is uniform. The exponent is found by bisection, either so that the entropy of the weights meets a
target, or so that no source is seen more than ``max_repetition`` times as often as the least repeated one. Both
quantities are monotone in a on [0, 1].

The weights are realised as whole and part epochs: a source's documents are hashed into blocks, each epoch permutes the
source's blocks anew by hash, and the last, partial epoch ends when the source's token budget is used up. A copy's place says
where in the whole mix it stands: epoch and place of its block in the epoch's permutation, as a share of all the source's
epochs, so all sources run from the mix's begin to its end; :func:`mixed_corpus` puts the copies in that order. Running
totals are kept over blocks (MOST_BLOCKS a source at most, so their size grows with the source) and, for the one block
where the budget ends, over its documents, so a source that holds a third of all rows never meets in one task.

Only DataFrame and SQL functions run. Bisection evaluates the interior points of several halvings in one small job;
what reaches the driver is one number per point.

Defined cases: a null source is a source of its own; a null or blank text has 0 tokens and is taken once per whole
epoch; repeated rows are separate documents, and those that agree in doc_id and text are in or out of the partial epoch
together; null ids are told apart by their texts; sources without tokens get weight 0 and one epoch; no rows give no
rows; long texts are counted whole and stay whole; columns of any other name are ignored, and kept by the stage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BLOCK_TOKENS, MOST_BLOCKS = 262_144, 1 << 16
PLACES = 1_000_000
#: Block decisions are broadcast up to this number of blocks (some 50 bytes each), else joined by shuffle.
BROADCAST_BLOCKS = 500_000
HALVINGS_A_JOB = 6
JOBS = 5


def token_count(text: str = "text") -> F.Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame) -> DataFrame:
    """One row per source: tokens, rows, share. Partial sums are made before the shuffle, so a hot source is no skew."""
    totals = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_rows"))
    whole = totals.agg(F.sum("source_tokens").alias("all_tokens"))
    return totals.withColumn("share", F.col("source_tokens") / F.lit(whole.first()["all_tokens"] or 1))


def _points(low: float, high: float) -> list[float]:
    n = 1 << HALVINGS_A_JOB
    return [low + (high - low) * k / n for k in range(1, n)]


def bisect_exponent(shares: DataFrame, *, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target; the nearest end if it can't be met."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    low, high = 0.0, 1.0
    alive = shares.where(F.col("share") > 0)
    for _ in range(JOBS):
        points = _points(low, high)
        raised = alive.select("share", F.explode(F.array(*[F.lit(a) for a in points])).alias("a")).select("share", "a", F.pow("share", "a").alias("r"))
        by_point = raised.groupBy("a").agg(
            F.sum("r").alias("z"), F.sum(F.col("r") * F.log("r")).alias("rlogr"), F.max(F.col("r") / F.col("share")).alias("most"), F.min(F.col("r") / F.col("share")).alias("least")
        )
        found = sorted(by_point.collect())  # one row for each of the 63 points
        if not found:
            return 1.0
        # entropy falls and evenness of repetition rises with a: the bracket is where the sign changes
        over = [(-x["rlogr"] / x["z"] + math.log(x["z"]) > target_entropy) if target_entropy is not None else (x["most"] / x["least"] > max_repetition) for x in found]
        k = sum(over)
        edges = [low, *points, high]
        low, high = edges[k], edges[k + 1]
    return (low + high) / 2


def mixing_weights(shares: DataFrame, exponent: float, budget_tokens: float | None = None) -> DataFrame:
    """Adds weight, epochs (how often each token of the source is seen) and quota_tokens.

    Without a budget it is the smallest at which every source is seen at least once.
    """
    raised = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    weighed = shares.withColumn("__raised", raised)
    total = weighed.agg(F.sum("__raised").alias("z"), F.max(F.when(F.col("share") > 0, F.col("source_tokens") / F.col("__raised"))).alias("most")).first()
    z = total["z"] or 1.0
    budget = budget_tokens if budget_tokens is not None else z * (total["most"] or 0.0)
    quota = F.round(F.col("__raised") / F.lit(z) * F.lit(float(budget)), 6)
    return weighed.withColumns({"weight": F.col("__raised") / F.lit(z), "quota_tokens": quota}).withColumn(
        "epochs", F.when(F.col("source_tokens") > 0, F.col("quota_tokens") / F.col("source_tokens")).otherwise(F.lit(1.0))
    ).drop("__raised")


def _draw(*parts: str | int | F.Column) -> F.Column:
    """A hash to order by, the same on any engine that has md5."""
    texts = [F.lit(str(x)) if isinstance(x, int) else F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit("")) for x in parts]
    return F.md5(F.concat_ws(":", *texts))


def _fraction(draw: F.Column) -> F.Column:
    """A draw as a whole number of 52 bits."""
    return F.conv(F.substring(draw, 1, 13), 16, 10).cast("long")


def _tokens(docs: DataFrame) -> DataFrame:
    """What decisions need of a document: doc_id, source, n_tokens, text_md5."""
    return docs.select("doc_id", "source", token_count().alias("n_tokens"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def _numbered(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds the plan of the row's source, its block, and __key, its order inside the block."""
    own = docs.withColumn("__source", F.coalesce("source", F.lit("\u0000"))).withColumn("__draw", _draw("doc_id", "text_md5", seed))
    block = F.pmod(_fraction(F.col("__draw")), F.col("__blocks"))
    key = F.struct(F.substring("__draw", 14, 19).alias("draw"), F.col("doc_id").alias("doc_id"))
    return own.join(plan, "__source").withColumns({"block": block, "__key": key}).drop("__draw")


def draw_plan(slim: DataFrame, weights: DataFrame, *, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The source plans and the block decisions.

    The partial epoch walks a source's blocks in their permuted order and stops at its budget: blocks before that point
    are in, blocks after it are out, and the block at that point gives the first documents that fit, up to __upto.
    Only that block's documents are ever ordered.
    """
    plan = weights.select(F.coalesce("source", F.lit("\u0000")).alias("__source"), "weight", "epochs", F.floor(F.col("epochs") + F.lit(1e-9)).cast("int").alias("__whole"),
        F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_tokens") / F.lit(block_tokens)))).cast("long").alias("__blocks"),
        (F.col("quota_tokens") - F.floor(F.col("epochs") + F.lit(1e-9)) * F.col("source_tokens")).alias("__left"))
    plan = stored(plan, "mix-plan")
    numbered = _numbered(slim, plan, seed)
    blocks = numbered.groupBy("__source", "block").agg(F.sum("n_tokens").alias("__tokens"), F.first("__left").alias("__left"), F.first("__whole").alias("__whole"))
    order = Window.partitionBy("__source").orderBy(_block_draw(F.col("__whole"), seed), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__tokens").over(order), F.lit(0)))
    state = F.when(F.col("__left") <= F.col("__before"), "out").when(F.col("__before") + F.col("__tokens") <= F.col("__left"), "in").otherwise("edge")
    blocks = stored(blocks.withColumn("__state", state), "mix-blocks")
    edge = blocks.where("__state = 'edge'").select("__source", "block", "__before")
    inside = Window.partitionBy("__source", "block").orderBy("__key")  # equal keys count together
    fitting = numbered.join(edge, ["__source", "block"]).withColumn("__sum", F.col("__before") + F.sum("n_tokens").over(inside))
    upto = fitting.where(F.col("__sum") <= F.col("__left")).groupBy("__source", "block").agg(F.max("__key").alias("__upto"))
    return plan, stored(blocks.join(upto, ["__source", "block"], "left").select("__source", "block", "__state", "__upto"), "mix-decisions")


def _block_draw(epoch: F.Column, seed: int) -> F.Column:
    """The draw by which ``block`` is ordered in an epoch's permutation, one of its own for every source."""
    return _draw("__source", "block", epoch, seed + 1)


def realise(docs: DataFrame, plan: DataFrame, blocks: DataFrame, *, seed: int = 17) -> DataFrame:
    """``docs`` plus weight, epochs, block, copies (how often the mix holds the row) and places (where, in PLACES steps)."""
    few = blocks.count() <= BROADCAST_BLOCKS
    placed = _numbered(docs, plan, seed).join(F.broadcast(blocks) if few else blocks, ["__source", "block"])
    extra = (F.col("__state") == "in") | ((F.col("__state") == "edge") & F.coalesce(F.col("__key") <= F.col("__upto"), F.lit(False)))
    copies = placed.withColumn("copies", F.col("__whole") + extra.cast("int"))
    share = F.transform(F.sequence(F.lit(0), F.greatest("copies", F.lit(1)) - 1), lambda e: F.floor((e + _fraction(_block_draw(e, seed)) / F.lit(2.0**52)) / F.greatest("epochs", F.col("copies").cast("double")) * PLACES))
    places = F.slice(share, 1, F.col("copies"))
    return copies.withColumn("places", places).drop("__source", "__whole", "__blocks", "__left", "__key", "__state", "__upto", "text_md5")


def mix(docs: DataFrame, *, target_entropy: float | None = None, max_repetition: float | None = 2.0, budget_tokens: float | None = None, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, n_tokens, weight, epochs, block, copies, places."""
    slim = stored(_tokens(docs), "mix-tokens")
    shares = stored(source_shares(slim), "mix-shares")
    exponent = bisect_exponent(shares, target_entropy=target_entropy, max_repetition=None if target_entropy is not None else max_repetition)
    return realise(slim, *draw_plan(slim, mixing_weights(shares, exponent, budget_tokens), seed=seed), seed=seed)


def _copies(docs: DataFrame, max_repetition: float, seed: int) -> DataFrame:
    """row (a document with all its columns) and place of every copy in the mix."""
    slim = stored(_tokens(docs), "mix-tokens")
    shares = stored(source_shares(slim), "mix-shares")
    weights = mixing_weights(shares, bisect_exponent(shares, max_repetition=max_repetition))
    whole = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.struct(*docs.columns).alias("row"))
    return realise(whole, *draw_plan(slim, weights, seed=seed), seed=seed).select("row", "doc_id", F.explode("places").alias("place"))


def mixed_corpus(docs: DataFrame, *, max_repetition: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus in training order: place, then the columns of ``docs``. One range shuffle of the texts."""
    return _copies(docs, max_repetition, seed).orderBy("place", _draw("doc_id", seed)).select("place", "row.*")


def mix_stage(docs: DataFrame, *, max_repetition: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus: each document as often as the mix holds it, with the columns of ``docs``.

    Every source is seen at least once, so no document is lost; smaller sources repeat. Texts are not shuffled: the
    decisions come from small tables of sources and blocks, and the next stage places the records itself.
    """
    return _copies(docs, max_repetition, seed).select("row.*")
