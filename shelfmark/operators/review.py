"""Review decisions as log replay: state is folded from an append-only decision log.

The folds are ``max_by``/``min_by`` aggregates, so they combine before the shuffle
and one much-reviewed attribute is no hot spot.

``decisions(product_id, attribute, action, selected_value, reason, ts, decision_id)``"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.units import with_norm
from shelfmark.operators.score import needs_review, verified_ratio

KEYS = ["product_id", "attribute"]


def split_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable decisions and rejected ones with a reason."""
    reason = (F.when(F.coalesce(F.col("attribute"), F.lit("")) == "", "attribute_name and action are required")
              .when(F.coalesce(F.col("action"), F.lit("")) == "", "attribute_name and action are required")
              .when(~F.col("action").isin(*vocab.REVIEW_ACTIONS), F.concat(F.lit("Invalid action '"), "action", F.lit("'")))
              .when((F.col("action") == "SELECT_ALTERNATIVE") & F.col("selected_value").isNull(),
                    "selected_value is required for SELECT_ALTERNATIVE"))
    d = decisions.withColumn("reject_reason", reason)
    return d.filter(F.col("reject_reason").isNull()).drop("reject_reason"), d.filter(F.col("reject_reason").isNotNull())


def fold(decisions: DataFrame) -> DataFrame:
    """Net effect of all usable decisions per attribute."""
    order = F.struct("ts", "decision_id")
    sets = F.when(F.col("action").isin("SELECT_ALTERNATIVE", "MARK_UNKNOWN"), order)
    moves = F.when(F.col("action") != "DISMISS_CONFLICT", order)
    return decisions.groupBy(*KEYS).agg(
        F.max_by(F.struct("action", "selected_value"), sets).alias("set"),
        F.max_by("action", moves).alias("last_move"),
        F.min_by("action", order).alias("first_action"),
        F.count("*").alias("n_decisions"))


def partial_fold(usable: DataFrame) -> DataFrame:
    """``fold`` in a form that merges: each effect with its place in the log.

    Merging is a maximum or minimum, so it takes parts in any order and the same decision any number of times. An id that comes
    again with other content counts by its greatest content."""
    order = F.struct("ts", "decision_id", "action", "selected_value")
    return usable.groupBy(*KEYS).agg(
        F.max(F.when(F.col("action").isin("SELECT_ALTERNATIVE", "MARK_UNKNOWN"), order)).alias("set"),
        F.max(F.when(F.col("action") != "DISMISS_CONFLICT", order)).alias("move"),
        F.min(order).alias("first"))


def merge_folds(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(F.max("set").alias("set"), F.max("move").alias("move"), F.min("first").alias("first"))


def folded(state: DataFrame) -> DataFrame:
    """Net effects as ``fold`` gives them, without the number of decisions."""
    return state.select(*KEYS, F.struct("set.action", "set.selected_value").alias("set"), F.col("move.action").alias("last_move"),
                        F.col("first.action").alias("first_action"))


def apply_decisions(attributes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Attributes after replay.  ``attributes(product_id, name, value, normalized_value, unit, confidence, status)``."""
    usable, _ = split_decisions(decisions)
    return apply_folded(attributes, fold(usable))


def apply_folded(attributes: DataFrame, effects: DataFrame) -> DataFrame:
    f = effects.select("product_id", F.col("attribute").alias("name"), "set", "last_move")
    d = attributes.join(f, ["product_id", "name"], "left")
    chosen = F.col("set.action") == "SELECT_ALTERNATIVE"
    voided = F.col("set.action") == "MARK_UNKNOWN"
    d = with_norm(d.withColumn("picked", F.when(chosen, F.col("set.selected_value"))), "name", "picked")
    unknown = F.col("last_move") == "MARK_UNKNOWN"
    moved = F.col("last_move").isNotNull()
    rest = [c for c in attributes.columns if c not in ("value", "normalized_value", "unit", "confidence", "status")]
    return d.select(
        *rest,
        F.when(chosen, F.col("set.selected_value")).when(voided, None).otherwise(F.col("value")).alias("value"),
        F.when(chosen, F.col("norm.normalized_value")).when(voided, None).otherwise(F.col("normalized_value")).alias("normalized_value"),
        F.when(chosen, F.col("norm.unit")).otherwise(F.col("unit")).alias("unit"),
        F.when(unknown, 0.0).when(moved, 1.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(unknown, "UNKNOWN").when(moved, "VERIFIED").otherwise(F.col("status")).alias("status"))


def close_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open conflicts of reviewed attributes closed by the first decision on them."""
    usable, _ = split_decisions(decisions)
    return close_folded(conflicts, fold(usable))


def close_folded(conflicts: DataFrame, effects: DataFrame) -> DataFrame:
    d = conflicts.join(effects.select(*KEYS, "first_action"), KEYS, "left")
    closing = (F.col("status") == "OPEN") & F.col("first_action").isNotNull()
    new = F.when(F.col("first_action") == "DISMISS_CONFLICT", "DISMISSED").otherwise("RESOLVED")
    return d.withColumn("status", F.when(closing, new).otherwise(F.col("status"))).drop("first_action")


def review_products(products: DataFrame, attributes: DataFrame, conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Score and status of reviewed products, from the state after replay."""
    usable, _ = split_decisions(decisions)
    touched = usable.select("product_id").distinct().withColumn("touched", F.lit(True))
    still_open = conflicts.filter(F.col("status") == "OPEN").groupBy("product_id").agg(F.count("*").alias("n_open"))
    d = (products.join(touched, "product_id", "left").join(still_open, "product_id", "left")
         .join(verified_ratio(attributes).withColumnRenamed("quality_score", "new_score"), "product_id", "left"))
    done = F.col("touched") & F.col("n_open").isNull() & (F.col("status") == "REQUIRES_REVIEW")
    score = F.when(F.col("touched"), F.coalesce("new_score", F.lit(0.0))).otherwise(F.col("overall_quality_score"))
    return (d.withColumn("status", F.when(done, "REVIEWED").otherwise(F.col("status")))
            .withColumn("overall_quality_score", score).drop("touched", "n_open", "new_score"))


def last_before(df: DataFrame, keys: list[str], order: list[str], mark: Column, bucket: Column, out: str) -> DataFrame:
    """Latest non-null ``mark`` before each row of its key.

    Ranks inside (key, time bucket), then carries each bucket's last mark forward
    over the short list of buckets: a key with a third of all rows is spread over
    its buckets instead of sorted in one task."""
    d = df.withColumn("_mark", mark).withColumn("_bucket", bucket)
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_near", F.last("_mark", ignorenulls=True).over(here))
    position = F.when(F.col("_mark").isNotNull(), F.struct(*order))
    per_bucket = d.groupBy(*keys, "_bucket").agg(F.max_by("_mark", position).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.withColumn("_carry", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    joined = d.join(carried, [*keys, "_bucket"])
    return joined.withColumn(out, F.coalesce("_near", "_carry")).drop("_mark", "_bucket", "_near", "_carry")


def previous_values(decisions: DataFrame, attributes: DataFrame, bucket: str = "day") -> DataFrame:
    """Each usable decision with the value it replaced and the value it left."""
    usable, _ = split_decisions(decisions)
    sets = F.col("action").isin("SELECT_ALTERNATIVE", "MARK_UNKNOWN")
    mark = F.when(sets, F.struct(F.when(F.col("action") == "SELECT_ALTERNATIVE", F.col("selected_value")).alias("v")))
    d = last_before(usable, KEYS, ["ts", "decision_id"], mark, F.date_trunc(bucket, "ts"), "prior")
    original = attributes.select("product_id", F.col("name").alias("attribute"), F.col("value").alias("original"))
    d = d.join(original, KEYS, "left")
    previous = F.when(F.col("prior").isNotNull(), F.col("prior.v")).otherwise(F.col("original"))
    left = (F.when(F.col("action") == "SELECT_ALTERNATIVE", F.col("selected_value"))
            .when(F.col("action") == "MARK_UNKNOWN", None).otherwise(previous))
    return d.withColumn("previous_value", previous).withColumn("selected_value", left).drop("prior", "original")


def audit_trail(decisions: DataFrame, attributes: DataFrame) -> DataFrame:
    """Decision history rows as exported; write with ``append`` only."""
    return previous_values(decisions, attributes).select(
        "product_id", "attribute", F.col("action").alias("reviewer_action"), "previous_value", "selected_value",
        "reason", "ts", "decision_id")


def resolve_conflicts(conflicts: DataFrame, attributes: DataFrame, products: DataFrame, resolutions: DataFrame,
                      ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply per-conflict resolutions or dismissals; latest per conflict counts.

    ``resolutions(conflict_id, action, selected_value, reason, ts)`` where action
    ``DISMISS`` dismisses and anything else resolves."""
    last = resolutions.groupBy("conflict_id").agg(F.max_by(F.struct("action", "selected_value"), F.struct("ts", "action", "selected_value", "reason")).alias("r"))
    c = conflicts.join(last, "conflict_id", "left")
    dismissed = F.col("r.action") == "DISMISS"
    status = F.when(F.col("r").isNull(), F.col("status")).when(dismissed, "DISMISSED").otherwise("RESOLVED")
    new_conflicts = c.withColumn("status", status).drop("r")
    picked = c.filter(F.col("r").isNotNull() & ~dismissed & F.col("r.selected_value").isNotNull()).select(
        "product_id", F.col("attribute").alias("name"), F.col("r.selected_value").alias("picked"))
    a = attributes.join(picked, ["product_id", "name"], "left")
    a = with_norm(a, "name", "picked")
    hit = F.col("picked").isNotNull()
    new_attributes = a.select(
        *[c_ for c_ in attributes.columns if c_ not in ("value", "normalized_value", "unit", "status")],
        F.coalesce("picked", "value").alias("value"),
        F.when(hit, F.col("norm.normalized_value")).otherwise(F.col("normalized_value")).alias("normalized_value"),
        F.when(hit, F.col("norm.unit")).otherwise(F.col("unit")).alias("unit"),
        F.when(hit, "VERIFIED").otherwise(F.col("status")).alias("status"))
    state = (c.withColumn("new_status", status).groupBy("product_id")
             .agg(F.count_if(F.col("new_status") == "OPEN").alias("n_open"), F.count("r").alias("n_decided")))
    cleared = state.filter((F.col("n_open") == 0) & (F.col("n_decided") > 0)).select("product_id", F.lit(True).alias("cleared"))
    new_products = products.join(cleared, "product_id", "left").withColumn(
        "status", F.when(F.col("cleared"), "REVIEWED").otherwise(F.col("status"))).drop("cleared")
    return new_conflicts, new_attributes, new_products


def dismiss_conflicts(conflicts: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Conflicts with ``dismissals(conflict_id, reason)`` applied; a reason may be null, the latest by ``ts, decision_id`` is kept."""
    order = F.struct(*(c for c in ("ts", "decision_id") if c in dismissals.columns), "reason")
    found = dismissals.groupBy("conflict_id").agg(F.max_by("reason", order).alias("dismiss_reason"), F.lit(True).alias("met"))
    d = conflicts.join(found, "conflict_id", "left")
    return d.withColumn("status", F.when(F.col("met"), "DISMISSED").otherwise(F.col("status"))).drop("met")


def _blocking(conflicts: DataFrame) -> DataFrame:
    return conflicts.filter((F.col("status") == "OPEN") & F.col("severity").isin("HIGH", "CRITICAL"))


def approve(products: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Publishable products (now PUBLISHED) and blocked ones with their open count."""
    blocking = _blocking(conflicts)
    approved = products.join(blocking.select("product_id"), "product_id", "left_anti").withColumn("status", F.lit("PUBLISHED"))
    counts = blocking.groupBy("product_id").agg(F.count("*").alias("n_blocking"))
    return approved, products.join(counts, "product_id")


def eligible(attributes: DataFrame) -> DataFrame:
    """Attributes a person should look at.

    Needs ``confidence, confidence_band, has_open_conflict, status``."""
    weak = (F.col("confidence") < 0.9) | (F.col("confidence_band") != "HIGH")
    return attributes.filter(weak | F.col("has_open_conflict") | needs_review(F.col("status")))


