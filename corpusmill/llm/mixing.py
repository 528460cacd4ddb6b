"""Mixing sources to target weights (problem 9).

Every document has a hash; each source keeps the documents whose hash lies under its threshold. The
thresholds come from histograms of tokens by source and hash bucket: only the bucket on the border
is split again, so no row is sorted and the driver sees ``sources x BUCKETS`` numbers at a time.
Thresholds are nested: with a larger budget, a source's earlier choice stays in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize

BITS = 10
BUCKETS = 1 << BITS
#: The hash has LEVELS x BITS bits.
LEVELS = 6


def budgets(have: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens that each source of ``targets`` (weight, most repeats) shall give.

    Without ``total`` the mix is as large as the repeats let it be while every source that has tokens
    still reaches its weight. A source without tokens can give nothing: its weight is lost and shows
    in the shares that are reached. With ``total``, a source gives at most its tokens times its repeats.
    """
    live = {s: (w, r) for s, (w, r) in targets.items() if have.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    if total is None:
        total = min((r * have[s] / w for s, (w, r) in live.items()), default=0)
    return {s: min(w * total, r * have[s]) for s, (w, r) in live.items()}


def thresholds(sized: DataFrame, part: dict[str, float]) -> dict[str, int]:
    """For each source the greatest hash bound under which its documents hold at most ``part`` tokens."""
    spark = sized.sparkSession
    open_, left, bound = dict.fromkeys(part, 0), dict(part), {}
    for level in range(1, LEVELS + 1):
        if not open_:
            break
        shift = (LEVELS - level) * BITS
        at = spark.createDataFrame([*open_.items()], "source string, __prefix bigint")
        inside = sized.join(F.broadcast(at), "source").where(F.shiftright("hash", shift + BITS) == F.col("__prefix"))
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count_distinct("hash").alias("n")).collect():
            by.setdefault(r.source, {})[r.bucket] = r.tokens, r.n
        for s, start in [*open_.items()]:
            bucket, end, own = start << BITS, (start + 1) << BITS, by.get(s, {})
            while bucket < end and own.get(bucket, (0, 0))[0] <= left[s]:
                left[s] -= own.get(bucket, (0, 0))[0]
                bucket += 1
            if bucket == end or own[bucket][1] <= 1 or level == LEVELS:
                bound[s] = bucket << shift
                del open_[s]
            else:
                open_[s] = bucket
    return bound


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The mix and the report.

    ``docs`` has ``key``, ``source`` and ``tokens``; ``targets`` has ``source``, ``weight`` and
    ``max_repeats`` and is a small table (one row a source). The mix has ``key``, ``source``,
    ``tokens`` and ``copies`` (1 or more); a document is used floor or ceil of its source's repeats,
    which is at most ``max_repeats``. Documents with a null or unlisted source and those of an empty
    source are left out; documents without tokens go with their hash. Rows repeated under one key have
    one hash and go together. The report has, for each source of ``targets``, ``weight``,
    ``max_repeats``, the tokens at hand and in the mix, and the share really reached.
    """
    spark = docs.sparkSession
    bits = LEVELS * BITS
    hashed = docs.select(key, "source", "tokens", F.shiftrightunsigned(F.xxhash64(key), 64 - bits).alias("hash"))
    listed = F.broadcast(targets.where("source is not null").select("source").distinct())  # one row a source that is asked for
    sized = materialize(hashed.join(listed, "source", "left_semi").select(key, "source", "tokens", "hash"), "mix")
    goal = {r.source: (r.weight, r.max_repeats) for r in targets.where("source is not null").collect()}
    have = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    want = budgets(have, goal, total)
    whole = {s: min(int(want[s] // have[s]), goal[s][1]) for s in want}
    rest = {s: want[s] - whole[s] * have[s] for s in want}
    bound = thresholds(sized, rest)
    for s in want:  # nothing may go beyond the most repeats
        if whole[s] >= goal[s][1]:
            bound[s] = 0
    plan = spark.createDataFrame([(s, whole[s], bound[s]) for s in want], "source string, __whole int, __bound bigint")
    copies = F.col("__whole") + (F.col("hash") < F.col("__bound")).cast("int")
    mixed = sized.join(F.broadcast(plan), "source").withColumn("copies", copies).where("copies > 0").select(key, "source", "tokens", "copies")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count(F.lit(1)).alias("documents"))
    at_hand = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    got = materialize(got, "reached")
    every = got.agg(F.sum("mix_tokens")).first()[0]
    report = (
        targets.where("source is not null").select("source", "weight", "max_repeats")
        .join(F.broadcast(at_hand), "source", "left").join(F.broadcast(got), "source", "left")
        .select("source", "weight", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("source_tokens", "mix_tokens", "documents")), (F.coalesce("mix_tokens", F.lit(0)) / F.lit(every or None).cast("bigint")).alias("share"))
    )
    return mixed, report
