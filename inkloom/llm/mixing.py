"""Mixing sources to target weights by hash thresholds.

Every document has a hash; tokens are summed by source and leading hash bits.
The budget of a source is a threshold in hash space: it is found in the summed
buckets, and only the bucket it falls into is refined with the next bits.  The
documents below the threshold are then filtered, without any sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps
from inkloom.llm.tokens import DEFAULT_TOKENIZER, bpe
from inkloom.session import written

#: Hash bits of a document, and bits refined at a time.
HASH_BITS, STEP_BITS = 60, 10
#: Sources up to this number are broadcast; more are joined by shuffle.
MAX_SOURCES = 10_000


def source_name(source: Column) -> Column:
    """A source as it is compared: trimmed and in lower case."""
    return F.lower(F.trim(source))


def _targets(targets: DataFrame) -> DataFrame:
    """Targets by name; of repeated names the weights add up and the least cap counts."""
    named = targets.select(source_name(F.col("source")).alias("source"), "weight", "max_repeat").filter("source is not null and weight > 0 and max_repeat > 0")
    return named.groupBy("source").agg(F.sum("weight").alias("weight"), F.min("max_repeat").alias("max_repeat"))


def token_counts(docs: DataFrame, targets: DataFrame, *, id_col: str, text_col: str, source_col: str, tokenizer_path: str = DEFAULT_TOKENIZER, seed: int = 0) -> DataFrame:
    """``(id, source, hash, n_tokens)`` of the documents whose source is in the mix."""
    slim = docs.select(F.col(id_col).alias("__id"), source_name(F.col(source_col)).alias("__source"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    wanted = _targets(targets).select(F.col("source").alias("__source"))
    few = wanted.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    slim = slim.join(F.broadcast(wanted) if few else wanted, "__source", "left_semi")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("__id").cast("string")), 64 - HASH_BITS)
    slim = slim.select("__id", "__source", hashed.alias("__hash"), "__text")
    schema = T.StructType([slim.schema["__id"], slim.schema["__source"], T.StructField("__hash", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe(tokenizer_path).encode_ordinary
        for batch in (part for whole in batches for part in steps(whole, [3], 5000)):
            sizes = pa.array([len(encode(t)) for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sizes], names=schema.names)

    out = slim.mapInArrow(count, schema)
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias("source"), F.col("__hash").alias("hash"), "n_tokens")


def _thresholds(counts: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """For each source the threshold below which its tokens come nearest to ``rest``.

    The histograms stay distributed: of each source only the bucket in which
    its budget ends comes to the driver, and only that bucket is refined.
    """
    spark = counts.sparkSession
    found: dict[str, int] = {}
    open_: dict[str, tuple[int, float]] = {s: (0, r) for s, r in rest.items()}
    for used in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        if not open_:
            break
        shift = HASH_BITS - used
        at = spark.createDataFrame([(s, p, float(r)) for s, (p, r) in open_.items()], "source string, prefix long, rest double")
        at = F.broadcast(at) if len(open_) <= MAX_SOURCES else at
        part = counts.join(at, "source")
        if used > STEP_BITS:
            part = part.filter(F.shiftright("hash", shift + STEP_BITS) == F.col("prefix"))
        sums = part.groupBy("source", "rest", F.shiftright("hash", shift).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        # at most 2**STEP_BITS buckets a source
        reached = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("source").orderBy("b")))
        over = reached.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("b", "n", "t", "upto")).alias("e"))
        edges = {r["source"]: r["e"] for r in over.collect()}
        for source, (prefix, left) in list(open_.items()):
            edge = edges.get(source)
            if edge is None:  # everything in reach fits
                found[source] = (prefix + 1) << (shift + STEP_BITS) if used > STEP_BITS else 1 << HASH_BITS
                del open_[source]
                continue
            left -= edge["upto"] - edge["t"]
            if edge["n"] == 1 or shift == 0:
                # one document (or equal hashes) is left on the edge: in if that comes nearer
                found[source] = (edge["b"] + (edge["t"] - left < left)) << shift
                del open_[source]
            else:
                open_[source] = (edge["b"], left)
    return found


def plan_mix(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """How often each source is used: whole passes and a hash threshold for a last, partial one.

    Shares are weights over the sources that have tokens.  Without
    ``total_tokens`` the mix is as large as the caps allow with every share
    met; with it, a source that its cap stops short stays short.
    """
    available = {r["source"]: r["t"] for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect() if r["t"]}
    rows = [r.asDict() for r in _targets(targets).collect()]
    weight = sum(r["weight"] for r in rows if r["source"] in available)
    for r in rows:
        r["available"] = available.get(r["source"], 0)
        r["share"] = r["weight"] / weight if r["available"] else 0.0
    reach = [r["max_repeat"] * r["available"] / r["share"] for r in rows if r["share"]]
    total = min(reach, default=0.0) if total_tokens is None else float(total_tokens)
    rest = {}
    for r in rows:
        quota = min(r["share"] * total, r["max_repeat"] * r["available"]) if r["available"] else 0.0
        # a whole pass that is missed only by rounding is a whole pass
        r["passes"] = int(quota / r["available"] + 1e-9) if r["available"] else 0
        left = quota - r["passes"] * r["available"]
        r["threshold"] = 0
        if r["passes"] < r["max_repeat"] and left >= 1:
            rest[r["source"]] = left
    for source, threshold in (_thresholds(counts, rest) if rest else {}).items():
        next(r for r in rows if r["source"] == source)["threshold"] = threshold
    return rows


_PLAN_SCHEMA = "source string, weight double, max_repeat int, share double, available long, passes int, threshold long"


def _plan_frame(counts: DataFrame, plan: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in _PLAN_SCHEMA.split(", ")]
    return counts.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in plan], _PLAN_SCHEMA)


def _copies(counts: DataFrame, plan: DataFrame) -> DataFrame:
    slim = plan.select("source", "passes", "threshold")
    by_plan = counts.join(F.broadcast(slim) if slim.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else slim, "source")
    copies = F.col("passes") + (F.col("hash") < F.col("threshold")).cast("int")
    return by_plan.withColumn("copies", copies).drop("passes", "threshold", "hash").filter(F.col("copies") > 0)


def mix(docs: DataFrame, targets: DataFrame, *, id_col: str, text_col: str, source_col: str, total_tokens: int | None = None, tokenizer_path: str = DEFAULT_TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix ``(id, source, n_tokens, copies)`` and its report, one row per target source.

    ``targets`` has source, weight, max_repeat.  Names are compared trimmed and
    in lower case.  Documents without source or of a source that is no target
    are left out; NULL and empty texts have no tokens; a target without
    documents is reported with share 0.  Equal ids have equal hashes and go in
    together.  Empty tables give an empty mix.
    """
    counts = written(token_counts(docs, targets, id_col=id_col, text_col=text_col, source_col=source_col, tokenizer_path=tokenizer_path, seed=seed), "mix-tokens")
    plan = _plan_frame(counts, plan_mix(counts, targets, total_tokens))
    chosen = _copies(counts, plan)
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"))
    both = plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    all_used = both.agg(F.sum("used").alias("all_used"))
    report = both.join(F.broadcast(all_used), F.lit(True))  # one row beside each
    report = report.select(
        "source", "weight", F.col("share").alias("target_share"), F.coalesce(F.try_divide(F.col("used").cast("double"), F.col("all_used").cast("double")), F.lit(0.0)).alias("actual_share"),
        F.col("available").alias("available_tokens"), F.col("used").alias("used_tokens"), "max_repeat", F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return chosen, report
