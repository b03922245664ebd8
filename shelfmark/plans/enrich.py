"""The whole enrichment as one plan, for one product or a whole catalog.

Identify and discover are narrow (projections and small-table joins); facts meet in
``claims``, which is shuffled by (product, attribute) and staged once for its many
readers; everything later groups on the same keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.functions import vocab
from shelfmark.functions.units import with_norm
from shelfmark.operators import claims as cl
from shelfmark.operators import classify, describe, extract, resolve, retrieve, score, validate
from shelfmark.sources import defaults
from shelfmark.sources.documents import line_chunks
from shelfmark.sources.feed import clean_feed
from shelfmark.sources.store import Staging


@dataclass
class Rules:
    """Masters and rule tables of a run."""

    brands: DataFrame
    manufacturers: DataFrame
    taxonomy: list[dict] = field(default_factory=lambda: defaults.TAXONOMY)
    types: list[tuple] = field(default_factory=lambda: defaults.PRODUCT_TYPES)
    required: tuple = vocab.REQUIRED_ATTRIBUTES
    checks: tuple = ()
    dim: int = 128

    @staticmethod
    def starter(spark) -> "Rules":
        return Rules(defaults.brand_master(spark), defaults.manufacturer_master(spark))


class RunLog:
    """What the eight stages of a run did, by figures observed while their tables were written.

    A stage is COMPLETED once the table it makes is written, FAILED if the run broke before that (with the error), and PENDING after one that failed.
    Figures are counted right below the write, so a task that is done again counts once."""

    def __init__(self):
        self.figures: dict[int, dict[str, int]] = {}
        self.error: str | None = None

    def keep(self, stage: Staging, df: DataFrame, name: str, figures: dict[int, dict[str, Column]]) -> DataFrame:
        """``df`` written; ``figures`` by stage number and name."""
        seen = Observation()
        columns = [c.cast("bigint").alias(f"{no} {k}") for no, of in figures.items() for k, c in of.items()]
        out = stage.keep(df.observe(seen, *columns), name)
        got = seen.get
        for no, of in figures.items():
            self.figures[no] = {k: got[f"{no} {k}"] or 0 for k in of}
        return out

    def fail(self, error: Exception) -> None:
        self.error = f"{type(error).__name__}: {str(error).strip().splitlines()[0] if str(error).strip() else ''}"

    def table(self, spark) -> DataFrame:
        """(stage_no, stage, status, figure, n, message): a row per figure, one without a figure for a stage that has none."""
        rows, broken = [], False
        for no, name in enumerate(vocab.STAGES, 1):
            if no in self.figures:
                rows += [(no, name, "COMPLETED", k, n, None) for k, n in self.figures[no].items()]
            elif self.error is not None and not broken:
                broken = True
                rows.append((no, name, "FAILED", None, None, self.error))
            else:
                rows.append((no, name, "PENDING", None, None, None))
        return spark.createDataFrame(rows, "stage_no int, stage string, status string, figure string, n bigint, message string")


def identify(feed: DataFrame, rules: Rules) -> DataFrame:
    """Cleaned feed with resolved brand and manufacturer."""
    d = clean_feed(feed)
    text = extract.mined_text(F.col("part_number"), F.col("description"))
    found = resolve.candidate_brand(d.select("product_id", text.alias("text")), resolve.brand_aliases(rules.brands), "product_id", "text")
    d = d.join(found, "product_id", "left")
    more = {"mfr_res": (resolve.MAKER, "manufacturer")}, {resolve.MAKER: rules.manufacturers}
    return resolve.brand_with_fallback(d, rules.brands, more=more)


def discover(identified: DataFrame, rules: Rules) -> DataFrame:
    """Product rows with taxonomy and resolution columns."""
    d = identified.withColumnsRenamed({"brand": "source_brand", "manufacturer": "source_manufacturer"})
    d = d.withColumn("brand", F.coalesce("brand_res.canonical_value", "candidate_brand", "source_brand"))
    d = d.withColumn("manufacturer", F.coalesce("mfr_res.canonical_value", "source_manufacturer"))
    d = classify.apply_category(classify.classify(d, rules.taxonomy))
    return d.select(
        "product_id", "part_number", "brand", "manufacturer", "source_brand", "source_manufacturer", "candidate_brand",
        "description", "category",
        F.col("brand_res.status").alias("brand_status"), F.col("brand_res.match_type").alias("brand_match_type"),
        F.col("mfr_res.status").alias("manufacturer_status"), F.col("mfr_res.match_type").alias("manufacturer_match_type"),
        F.col("mfr_res.confidence").alias("manufacturer_confidence"),
        F.col("tax.dept").alias("taxonomy_dept"), F.col("tax.class_name").alias("taxonomy_class"),
        F.col("tax.fine").alias("taxonomy_fine"), F.col("tax.classpath").alias("taxonomy_classpath"),
        F.col("tax.confidence").alias("taxonomy_confidence"), F.col("tax.status").alias("taxonomy_status"))


def gather_claims(products: DataFrame, rules: Rules, documents: DataFrame | None, stage: Staging) -> tuple[DataFrame, DataFrame | None]:
    """Claims from the description and, where a product has documents, from them too.

    ``documents(document_id, document_name, product_id, page_number, text)``."""
    source = products.select("product_id", "part_number", "description", F.col("source_brand").alias("brand"), "candidate_brand")
    facts = extract.extract_facts(source, rules.types, candidate="candidate_brand")
    parts = [cl.claims_from_facts(facts, products)]
    index = None
    if documents is not None:
        own = documents.join(products.select("product_id"), "product_id", "left_semi")
        # read for its vectors, for its texts and as a result
        index = stage.keep(retrieve.index_chunks(line_chunks(own), rules.dim), "index")
        parts.append(retrieve.spec_evidence(index, dim=rules.dim))
    return cl.union_claims(*parts), index


def best_attributes(claims: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Best claim per attribute with its normalised form, taken over where claims carry it."""
    d = cl.best_claims(claims)
    if "norm" not in d.columns:
        d = with_norm(d, known=known)
    return d.select("product_id", F.col("attribute").alias("name"), "value",
                    F.col("norm.normalized_value").alias("normalized_value"), F.col("norm.unit").alias("unit"),
                    F.coalesce("norm.is_ambiguous", F.lit(False)).alias("is_ambiguous"), "attr_ord", "n_claims", "similarity")


def enrich(feed: DataFrame, rules: Rules, documents: DataFrame | None = None, staging: Staging | None = None, log: RunLog | None = None) -> dict[str, DataFrame]:
    """All stages over a feed: products, attributes, claims, conflicts, validation, scores, stage log.

    With a ``log``, the tables of every stage are written here and their figures observed; without, some are left to their readers."""
    try:
        return _enrich(feed, rules, documents, staging or Staging(feed.sparkSession), log)
    except Exception as error:
        if log is not None:
            log.fail(error)
        raise


def _enrich(feed: DataFrame, rules: Rules, documents: DataFrame | None, stage: Staging, log: RunLog | None) -> dict[str, DataFrame]:
    def keep(df: DataFrame, name: str, figures: dict[int, dict[str, Column]], always: bool = True) -> DataFrame:
        if log is not None:
            return log.keep(stage, df, name, figures)
        return stage.keep(df, name) if always else df

    every, when = F.count("*"), F.count_if
    base = keep(discover(identify(feed, rules), rules), "base", {
        1: {"products": every, "without_text": when(F.col("part_number").isNull() & F.col("description").isNull()),
            "brands_resolved": when(F.col("brand_status") == "RESOLVED"), "manufacturers_resolved": when(F.col("manufacturer_status") == "RESOLVED")},
        2: {"taxonomy_resolved": when(F.col("taxonomy_status") == "RESOLVED"), "taxonomy_heuristic": when(F.col("taxonomy_status") == "HEURISTIC")}})
    raw_claims, index = gather_claims(base, rules, documents, stage)
    claims = keep(cl.with_canonical(raw_claims), "claims", {
        3: {"claims": every, "from_documents": when(F.col("source_type").isin("PDF", "DOCUMENT"))},
        4: {"normalized": F.count("norm.normalized_value"), "ambiguous": when(F.col("norm.is_ambiguous"))}})

    # read by two rules, for the scores and with them
    found = stage.keep(best_attributes(claims).drop("similarity"), "found").withColumn("status", F.lit("VERIFIED"))
    values = cl.claim_values(cl.stated(claims))
    open_conflicts = keep(cl.conflict_headers(values), "conflicts", {5: {"conflicts": every}}, always=False)
    compared = cl.compare_sources(claims)
    conflicts_seen = log.figures.pop(5, {}) if log is not None else {}
    checks = keep(validate.all_results(
        validate.required_rule(base, found, rules.required),
        validate.row_rules(found, *rules.checks),
        validate.cross_source_results(compared)), "validation", {5: {
            "checks": every, "passed": when(F.col("status") == "PASSED"), "failed": when(F.col("status") == "FAILED")}}, always=False)
    if log is not None:
        log.figures[5] |= conflicts_seen
    evidence = claims.select("product_id", "attribute", "source_name", F.col("source_name").alias("document_name"),
                             "similarity", "source_type", "evidence_id", "page_number", "snippet")
    # the cross-source verdict is already the conflict factor; it must not count twice
    scored = score.score_attributes(found, evidence, checks.filter(F.col("rule") != "CrossSourceConsistencyCheck"), open_conflicts)
    final = scored.select("product_id", F.col("attribute").alias("name"), "confidence_score", "confidence_band", "is_blocked",
                          "evidence_count", score.attribute_status(F.col("has_conflict"), F.col("confidence_band")).alias("status"))
    attributes = keep(
        found.drop("status").join(final, ["product_id", "name"]).withColumn("confidence", F.round(F.col("confidence_score") / 100.0, 4)),
        "attributes", {
            6: {"attributes": every, "high": when(F.col("confidence_band") == "HIGH"), "blocked": when(F.col("is_blocked"))},
            7: {"to_review": when(score.needs_review(F.col("status"))), "in_conflict": when(F.col("status") == "CONFLICT")}})

    totals = attributes.groupBy("product_id").agg(
        F.count("*").alias("n_attributes"), F.sum("n_claims").alias("evidence_count"),
        F.count_if(score.needs_review(F.col("status"))).alias("review_count"),
        F.count_if(F.col("status") == "CONFLICT").alias("conflict_count"),
        # without float noise, or a tie goes by the order in which tasks add
        score.score_round(F.avg("confidence_score"), 1).alias("overall_confidence"))
    p = base.join(totals, "product_id", "left").fillna(
        0, ["n_attributes", "evidence_count", "review_count", "conflict_count", "overall_confidence"])
    p = p.withColumn("overall_quality_score", score.quality_score(
        F.col("manufacturer_status"), F.col("brand_status"), F.col("taxonomy_status"), F.col("n_attributes"),
        F.col("evidence_count"), F.col("conflict_count") > 0))
    p = p.withColumn("status", score.product_status(F.col("review_count"), F.col("overall_quality_score")))
    products = keep(describe.describe(p, attributes), "products", {
        8: {"products": every, "to_review": when(F.col("status") == "REQUIRES_REVIEW"), "reviewed": when(F.col("status") == "REVIEWED")}}, always=False)
    out = {"products": products, "attributes": attributes, "claims": claims, "evidence": evidence, "conflicts": open_conflicts,
           "conflict_values": values, "validation": checks, "reports": validate.report(checks), "scores": scored,
           "stage_log": stage_log(p)}
    if index is not None:
        out["index"] = index
    return out


def stage_log(products: DataFrame) -> DataFrame:
    """Eight stage rows per product, told from the finished row's own figures."""
    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def n(c: str) -> Column:
        return F.col(c).cast("string")

    missing = F.col("part_number").isNull() & F.col("description").isNull()
    messages = (
        (15, text("Product identified: ", F.concat_ws(" ", "manufacturer", "brand", "part_number"))),
        (30, text("Taxonomy: ", F.col("taxonomy_classpath"), " (", F.col("taxonomy_status"), ")")),
        (50, text(n("n_attributes"), " attribute(s) extracted from ", n("evidence_count"), " piece(s) of evidence")),
        (65, F.lit("Specifications standardized into canonical units")),
        (75, F.when(F.col("conflict_count") > 0, text(n("conflict_count"), " conflict(s) detected")).otherwise("Validation passed, 0 conflicts")),
        (85, text("Confidence scored (overall ", n("overall_confidence"), "%)")),
        (92, F.when(F.col("review_count") > 0, text(n("review_count"), " attribute(s) flagged for human review")).otherwise("No review required")),
        (100, text("Published (quality ", n("overall_quality_score"), "%, status ", F.col("status"), ")")),
    )
    rows = [F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.lit(pct).alias("progress"), msg.alias("message"))
            for i, (name, (pct, msg)) in enumerate(zip(vocab.STAGES, messages), 1)]
    long = products.select("product_id", missing.alias("missing"), F.explode(F.array(*rows)).alias("s"))
    # a row with neither part number nor description stops at the first stage
    failed = F.col("missing") & (F.col("s.stage_no") == 1)
    state = F.when(failed, "FAILED").when(F.col("missing"), "PENDING").otherwise("COMPLETED")
    message = F.when(failed, "Neither part number nor description given").when(F.col("missing"), "Waiting to start...").otherwise(F.col("s.message"))
    return long.select("product_id", F.col("s.stage_no").alias("stage_no"), F.col("s.stage").alias("stage"),
                       F.col("s.progress").alias("progress"), state.alias("status"), message.alias("message"))
