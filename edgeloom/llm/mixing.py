"""Mixing sources to target shares of the total size by hash thresholds, without sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions.hashing import key_hash
from edgeloom.llm.tokens import TOKENIZER, with_tokens
from edgeloom.session import cut
from edgeloom.sources.tables import load

BITS = 12  # one round of the histogram: 4096 buckets a source
ROUNDS = 4  # 48 bits of the hash


def _hash48(seed: int, key: str) -> F.Column:
    return F.conv(F.substring(key_hash(seed, key), 1, BITS * ROUNDS // 4), 16, 10).cast("bigint")


def plan_budgets(stock: dict[str, int], weights: list[tuple[str, float, int]], total: int | None = None) -> dict[str, dict]:
    """Per source of ``weights``: its token budget, whole repeats and the part beyond them.

    Sources without tokens cannot contribute; the target shares of the others are scaled up to make 1. Without
    ``total`` the mixture is as large as the repeat caps allow with exact shares; a ``total`` beyond that gives each
    source what its cap allows. Shares and caps that are null, or not above 0, give a budget of 0.
    """
    live = {s: (w, r) for s, w, r in weights if stock.get(s, 0) > 0 and (w or 0) > 0 and (r or 0) > 0}
    mass = sum(w for w, _ in live.values())
    limit = min((r * stock[s] * mass / w for s, (w, r) in live.items()), default=0.0)
    size = limit if total is None else float(total)
    out = {}
    for s, w, r in weights:
        have = stock.get(s, 0)
        budget = min(size * w / mass, float(r * have)) if s in live else 0.0
        full = int(budget // have) if have else 0
        out[s] = {"target": w, "cap": r, "stock": have, "budget": budget, "full": full, "rest": budget - full * have if have else 0.0}
    return out


def _histogram(items: DataFrame, source: str, tokens: str, shift: int) -> dict[str, list[tuple[int, int]]]:
    """Per source the (bucket, tokens) of 12 hash bits in order; at most 4096 sums a source reach the driver."""
    hist = items.groupBy(source, F.shiftright("__h", shift).bitwiseAND((1 << BITS) - 1).alias("b")).agg(F.sum(tokens).alias("t"))
    sums: dict[str, list[tuple[int, int]]] = {}
    for r in hist.collect():
        sums.setdefault(r[0], []).append((int(r[1]), int(r[2])))
    return {s: sorted(v) for s, v in sums.items()}


def thresholds(items: DataFrame, source: str, tokens: str, first: dict[str, list[tuple[int, int]]], rest: dict[str, float]) -> dict[str, int]:
    """Per source the 48-bit hash below which items together come nearest to ``rest`` tokens.

    ``first`` is the histogram of the leading 12 bits. The boundary bucket of each source, one of 4096, is taken out once
    and refined by the next 12 bits, three times over; the items themselves are not read again.
    """
    prefix = {s: 0 for s in rest}
    left = dict(rest)
    spark = items.sparkSession
    inside, sums = items, first
    for k in range(ROUNDS):
        for s in prefix:
            bound = 1 << BITS  # all buckets fit: nothing is beyond the boundary
            for b, t in sums.get(s, []):
                if t > left[s]:
                    # the last round's bucket is one item, or copies of one: it goes in when that comes nearer
                    bound = b + (k == ROUNDS - 1 and t - left[s] < left[s])
                    break
                left[s] -= t
            # with all buckets in, this is the start of the next prefix, which holds none of them
            prefix[s] = (prefix[s] << BITS) + bound
        if k < ROUNDS - 1:
            shift = BITS * (ROUNDS - k - 1)
            at = spark.createDataFrame(list(prefix.items()), f"`{source}` string, __p bigint")
            # as many rows as there are sources in the plan
            hit = inside.join(F.broadcast(at), source).where(F.shiftright("__h", shift) == F.col("__p")).drop("__p")
            inside = cut(hit) if k == 0 else hit
            sums = _histogram(inside, source, tokens, shift - BITS)
    return prefix


def mix(docs: DataFrame, key: str, source: str, tokens: str, weights: list[tuple[str, float, int]], total: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(items, shares): the mixture and what each source really gets.

    ``items`` has key, source, tokens and copies (1 or more); items are nested: one with a smaller hash never has fewer
    copies than another of its source. ``shares`` has a row for every source of ``weights``, also for those without
    items. An item of a source not in ``weights``, with a null source, or of size 0 is not part of the mixture; equal
    keys get equal copies. ``weights`` is a few rows of (source, share, max_repeats); the last of repeated sources holds.
    """
    weights = list({s: (s, w, r) for s, w, r in weights if s is not None}.values())
    spark = docs.sparkSession
    names = [s for s, _, _ in weights]
    items = docs.select(F.col(key), F.col(source), F.col(tokens).cast("bigint").alias(tokens)).where(F.col(source).isin(names) & (F.col(tokens) > 0))
    items = items.withColumn("__h", _hash48(seed, key))
    first = _histogram(items, source, tokens, BITS * (ROUNDS - 1))
    plan = plan_budgets({s: sum(t for _, t in v) for s, v in first.items()}, weights, total)
    edge = thresholds(items, source, tokens, first, {s: p["rest"] for s, p in plan.items()})
    rows = [(s, int(p["full"]), int(edge[s])) for s, p in plan.items()]
    table = spark.createDataFrame(rows, f"`{source}` string, __full int, __edge bigint")
    copies = (F.col("__full") + (F.col("__h") < F.col("__edge")).cast("int")).alias("copies")
    chosen = items.join(F.broadcast(table), source).select(key, source, tokens, copies).where("copies > 0")
    got = chosen.groupBy(source).agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.col(tokens) * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies")
    )
    wants = spark.createDataFrame([(s, float(p["target"] or 0), p["cap"], p["stock"]) for s, p in plan.items()], f"`{source}` string, target_share double, max_repeats int, stock_tokens bigint")
    shares = wants.join(got, source, "left").na.fill(0, ["items", "taken_tokens", "most_copies"])
    everything = shares.agg(F.sum("taken_tokens").alias("all_tokens"))
    # one row
    shares = shares.join(F.broadcast(everything)).withColumn(
        "actual_share", F.when(F.col("all_tokens") > 0, F.round(F.col("taken_tokens") / F.col("all_tokens"), 6)).otherwise(F.lit(0.0))
    )
    return chosen, shares.drop("all_tokens")


def _mixture(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    w = load(spark, d, "mix_weights").select("source", "target_share", "max_repeats").collect()
    # tokens are counted once and read by every round
    sized = cut(with_tokens(load(spark, d, "documents"), "text", ["doc_id", "source"], tokenizer))
    return mix(sized, "doc_id", "source", "n_tokens", [tuple(r) for r in w])


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the weights, what must hold: the cap, the target share among sources with documents up to one item, nesting."""
    w = [tuple(r) for r in load(spark, d, "mix_weights").select("source", "target_share", "max_repeats").collect()]
    sized = cut(with_tokens(load(spark, d, "documents"), "text", ["doc_id", "source"], TOKENIZER))
    items, shares = mix(sized, "doc_id", "source", "n_tokens", w)
    items = cut(items)
    h = sized.where("n_tokens > 0").select("doc_id", "source", "n_tokens", _hash48(42, "doc_id").alias("h")).join(items.select("doc_id", "copies"), "doc_id", "left").fillna(0, ["copies"])
    level = h.groupBy("source", "copies").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("n_tokens").alias("longest"))
    per = level.groupBy("source").agg(
        F.max(F.when(F.col("copies") == 0, F.lit(0)).otherwise(F.col("copies"))).alias("most"), F.max("longest").alias("longest"),
        F.array_sort(F.collect_list(F.struct("copies", "lo", "hi"))).alias("levels"),  # a source has two levels, or three
    )
    nested = F.expr("forall(sequence(1, greatest(size(levels) - 1, 1)), i -> size(levels) < 2 or levels[i].hi < levels[i - 1].lo)")
    all_tokens = items.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all"))
    live = shares.where("stock_tokens > 0 and target_share > 0 and max_repeats > 0").agg(F.sum("target_share").alias("mass"))
    j = shares.join(per.withColumnRenamed("source", "s"), F.col("source") == F.col("s"), "left").join(F.broadcast(all_tokens)).join(F.broadcast(live))  # one row each
    want = F.when(F.col("stock_tokens") > 0, F.col("target_share") / F.col("mass")).otherwise(0)
    ok = F.abs(F.col("taken_tokens") - want * F.col("all")) <= F.lit(len(w)) * F.coalesce("longest", F.lit(0))
    return j.select("source", "target_share", "max_repeats", (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"), ok.alias("share_kept"), F.coalesce(nested, F.lit(True)).alias("nested"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_check": p7_check}
ORACLE: dict[str, str] = {"p7_check": "select source, target_share, max_repeats, true cap_kept, true share_kept, true nested from mix_weights"}
