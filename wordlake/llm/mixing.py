"""Operator 5, mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

A node's capacity is what its leaves hold in all allowed epochs. The budget goes down the tree level by level; among
siblings it is split by weight, a child takes no more than its capacity, and what it leaves goes to its siblings by
their weights. So a shortage reaches the ancestors' siblings only when no sibling below can take it. Each leaf turns
its quota into whole epochs and a token prefix of one more epoch, whose order is a seeded hash of the epoch and id.

All of it is DataFrame work. Windows run over nodes of the tree, over hash buckets of a leaf, and over the rows of one
bucket of one leaf, so a source with a third of the rows is spread over ``BUCKETS`` groups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Hex digits of the hash that name a bucket of a leaf.
BUCKET_DIGITS = 3


def domain_of(source: Column) -> Column:
    """The production tree's domain: sources are numbered, their last digit is even (``web``) or odd (``print``)."""
    return F.when(F.regexp_like(source, F.lit("[02468]$")), "web").when(F.regexp_like(source, F.lit("[13579]$")), "print").otherwise("other")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each node from ``parent_budget``, ``cap`` and ``weight``.

    With siblings in order of cap / weight, (budget left after the capacities before) / (weight from here on) rises
    while the children are filled and falls afterwards; its maximum is the common level of those that are not.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = nodes.withColumn("level", (F.col("parent_budget") - before) / rest)
    level = level.withColumn("level", F.max("level").over(Window.partitionBy(*parent)))
    return level.withColumn("budget", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("level", "parent_budget")


def leaf_quotas(leaves: DataFrame, weights: Mapping[str, float], budget_share: float, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, available) with quota, full_epochs and rest.

    ``weights`` maps ``domain``, ``domain/lang`` or ``domain/lang/source`` to a positive weight among its siblings, 1
    where it has none. The budget is ``budget_share`` of all available tokens, or all capacity if that is less.
    """
    if any(w <= 0 for w in weights.values()) or budget_share < 0 or max_epochs < 1:
        raise ValueError("weights must be positive, the budget share not negative and max_epochs at least 1")
    pairs = [F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]

    def weight(path: Column) -> Column:
        return F.coalesce(F.element_at(F.create_map(*pairs), path), F.lit(1.0)) if pairs else F.lit(1.0)

    total = leaves.agg(F.sum("available").alias("all_tokens"))
    up = leaves.withColumn("cap", F.col("available") * max_epochs)
    budgets = total.select(F.least((F.col("all_tokens") * F.lit(float(budget_share))), (F.col("all_tokens") * max_epochs).cast("double")).alias("parent_budget"))
    nodes = up.groupBy("domain").agg(F.sum("cap").alias("cap")).crossJoin(F.broadcast(budgets))  # one row
    nodes = _fill(nodes.withColumn("weight", weight(F.col("domain"))), [], "domain")
    for depth in (2, 3):
        parent, own = list(LEVELS[: depth - 1]), list(LEVELS[:depth])
        below = up.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("weight", weight(F.concat_ws("/", *own)))
        nodes = _fill(below.join(nodes.select(*parent, F.col("budget").alias("parent_budget")), parent), parent, own[-1])
    quota = nodes.select(*LEVELS, F.floor(F.col("budget") + 1e-6).cast("long").alias("quota"))
    full = F.when(F.col("available") > 0, F.floor(F.col("quota") / F.col("available"))).otherwise(0).cast("long")
    return leaves.join(quota, list(LEVELS)).withColumn("full_epochs", full).withColumn("rest", F.col("quota") - F.col("full_epochs") * F.col("available"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float], budget_share: float = 1.0, max_epochs: int = 4, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the leaf, n_tokens (words), full_epochs, prefix_tokens and total_tokens.

    ``prefix_tokens`` is n_tokens for rows wholly in the leaf's partial epoch, fewer for the one that crosses its end,
    0 beyond. A null language or source is the label ``none``; a null or empty text has 0 tokens and is never chosen
    beyond its full epochs. Equal hashes (repeated ids) go by id and tokens; wholly equal rows are interchangeable.
    Other columns pass through only if named in ``keep``; they don't clash with the added ones unless named alike.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"kept_{c}") for c in keep), F.coalesce(domain_of(F.col("source")), F.lit("other")).alias("domain"),
        *(F.coalesce(F.col(c), F.lit("none")).alias(c) for c in LEVELS[1:]),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))
    leaves = cut_lineage(d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available")))
    quotas = cut_lineage(leaf_quotas(leaves, weights, budget_share, max_epochs).select(*LEVELS, "full_epochs", "rest"))
    d = d.join(quotas, list(LEVELS))
    d = d.withColumn("order", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    d = d.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(domain_of(F.col("source")), F.lit("other")).alias("domain"),
                         *(F.coalesce(F.col(c), F.lit("none")).alias(c) for c in LEVELS[1:]),
                         F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")).join(quotas, list(LEVELS))
    narrow = narrow.withColumn("bucket", F.substring(F.md5(F.concat_ws(
        "|", F.lit(str(seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, BUCKET_DIGITS))
    buckets = narrow.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"))
    span = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*LEVELS, "bucket", F.coalesce(F.sum("held").over(span), F.lit(0)).alias("start"))
    within = Window.partitionBy(*LEVELS, "bucket").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(buckets, [*LEVELS, "bucket"])
    left = F.col("rest") - F.col("start") - F.col("before")
    d = d.withColumn("prefix_tokens", F.greatest(F.lit(0).cast("long"), F.least(F.col("n_tokens"), left)))
    return d.select("doc_id", *LEVELS, "n_tokens", "full_epochs", "prefix_tokens",
                    (F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("total_tokens"), *(f"kept_{c}" for c in keep))


def apply_mix(docs: DataFrame, weights: Mapping[str, float], **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row per epoch, the row that crosses a quota cut to its words.

    ``n_chars`` is counted again where the text was cut. Rows with no tokens have a copy per full epoch.
    """
    columns = docs.columns
    mixed = mix_sources(docs, weights, keep=tuple(columns), **options)
    text = F.col("kept_text")
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")  # each word with the white space behind it
    lead = F.when(F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")), 1).otherwise(0)
    short = F.concat_ws("", F.slice(pieces, F.lit(1), F.col("prefix_tokens").cast("int") + lead))
    copies = F.sequence(F.lit(0), F.col("full_epochs")).alias("epoch")
    rows = mixed.select("*", F.explode(copies).alias("epoch")).where((F.col("epoch") < F.col("full_epochs")) | (F.col("prefix_tokens") > 0))
    cut = (F.col("epoch") == F.col("full_epochs")) & (F.col("prefix_tokens") < F.col("n_tokens"))
    rows = rows.withColumn("cut", cut).withColumn("kept_text", F.when(F.col("cut"), short).otherwise(text))
    if "n_chars" in columns:
        rows = rows.withColumn("kept_n_chars", F.when(F.col("cut"), F.char_length("kept_text").cast("long")).otherwise(F.col("kept_n_chars")))
    return rows.select(*(F.col(f"kept_{c}").alias(c) for c in columns))
