"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import embedding, text, units, vocab
from shelfmark.operators import (catalog, claims as cl, classify, delivery, describe, evaluate, extract, resolve, retrieve,
                                 review, score, validate)
from shelfmark.sources import documents as docs
from shelfmark.sources import feed as fd
from shelfmark.sources import sinks, store
from shelfmark.sources.chunk_index import ChunkIndex
from workload import sql_views as sv
from workload import views


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def scratch(spark: SparkSession) -> str:
    """Fresh folder below the one all executors share."""
    return store.shared_folder(spark, "queries")


def once(df: DataFrame) -> DataFrame:
    """Written for its several readers, which would each make it again."""
    return store.Staging(df.sparkSession).keep(df, "once")


c = F.col
DIM = 64

sv.VIEWS["usable_decisions"] = """SELECT * FROM decisions WHERE action IN ('ACCEPT_AI_VALUE', 'SELECT_ALTERNATIVE', 'MARK_UNKNOWN', 'DISMISS_CONFLICT')
    AND NOT (action = 'SELECT_ALTERNATIVE' AND selected_value IS NULL)"""

# ---------------------------------------------------------------- sources and sinks

FEED_COLS = ("part_number", "brand", "manufacturer", "description", "category")


@query("src_feed_csv", "SELECT CAST(product_id AS VARCHAR) AS product_id, "
       + ", ".join(f"coalesce({x}, '') AS {x}" for x in FEED_COLS) + " FROM feed")
def _(spark, sf):
    folder = scratch(spark)
    sinks.write_csv(views.feed(spark, sf).select("product_id", *FEED_COLS), f"{folder}/feed")
    return fd.read_feed_csv(spark, f"{folder}/feed").fillna("")


@query("src_header_alias", "SELECT product_id, part_number, brand, description, '' AS category, manufacturer FROM feed")
def _(spark, sf):
    odd = views.feed(spark, sf).select("product_id", c("part_number").alias("MPN"), c("brand").alias("Manufacturer"),
                                       c("description").alias("Description"), c("manufacturer").alias("Part_Manuf"))
    return fd.canonical_header(odd)


def _missing(col: str) -> str:
    return f"WHEN coalesce({sv.strip(col)}, '') = '' THEN 'Missing {col.replace('_', ' ')}'"


@query("src_reject_split", f"SELECT product_id, CASE {_missing('part_number')} {_missing('brand')} {_missing('description')} END AS reject_reason FROM feed")
def _(spark, sf):
    good, bad = fd.reject_split(views.feed(spark, sf), ("part_number", "brand", "description"))
    return bad.select("product_id", "reject_reason").unionByName(good.select("product_id", F.lit(None).cast("string").alias("reject_reason")))


@query("src_file_gate")
def _(spark, sf):
    return docs.file_gate(spark, sf).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "extension", "length", "reject_reason")


@query("src_doc_chunk")
def _(spark, sf):
    pages = views.documents(spark, sf).select("document_id", "page_number", "text")
    return docs.chunk_pages(pages)


LINES = f"""SELECT document_id, document_name, source, product_id, page_number, CAST(u.i - 1 AS INT) AS chunk_index, u.t AS text FROM (
    SELECT * EXCLUDE (text), unnest(list_transform(ls, lambda t, i: {{'t': t, 'i': i}})) AS u FROM (
      SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda l: {sv.strip('l')}), lambda l: l <> '') AS ls FROM docs))"""
sv.VIEWS["lines"] = LINES


@query("src_line_chunk", "SELECT document_id, chunk_index, text FROM lines")
def _(spark, sf):
    return docs.line_chunks(views.documents(spark, sf)).select("document_id", "chunk_index", "text")


@query("src_table_text", """SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, line) AS table_text FROM (
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN ' |  | ' ELSE
      CAST(l_partkey AS VARCHAR) || ' | ' || CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END || ' | ' || l_linestatus END AS line FROM lineitem)
    WHERE line <> ' |  | ' GROUP BY 1""")
def _(spark, sf):
    blank = c("l_returnflag") == "R"
    cells = F.array(F.when(~blank, c("l_partkey").cast("string")), F.when(~blank & (c("l_suppkey") % 2 != 0), c("l_suppkey").cast("string")),
                    F.when(~blank, F.concat(F.lit(" "), "l_linestatus")))
    rows = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", cells.alias("cells"))
    return docs.table_text(rows, ["l_orderkey"], "l_linenumber")


@query("src_doc_ingest")
def _(spark, sf):
    d = views.documents(spark, sf)
    name = F.concat("source", F.when(c("document_id") % 7 == 0, ".docx").otherwise(".pdf"))
    files = d.select("document_id", name.alias("filename"), F.when(c("document_id") % 11 == 0, 0).otherwise(F.length("text")).alias("file_size"), "product_id")
    return docs.ingest(files, d.select("document_id", "page_number", "text"), DIM)["documents"]


def twin_parts(spark, sf):
    """Stored attributes with scores, results, decisions and conflicts."""
    attributes, evidence, found = once(views.attributes(spark, sf)), views.evidence(spark, sf), once(views.conflicts(spark, sf))
    results = once(validate.row_rules(attributes))
    scores = score.score_attributes(attributes, evidence, results, found.filter(c("status") == "OPEN"))
    usable, _ = review.split_decisions(views.decisions(spark, sf))
    return attributes, evidence, results, scores, usable, found


@query("snk_twin_json", """SELECT p.product_id, p.part_number, coalesce(a.n, 0) AS n_attributes, coalesce(e.n, 0) AS n_evidence, coalesce(f.n, 0) AS n_conflicts,
    coalesce(d.n, 0) AS n_decisions, coalesce(a.first_name, '') AS first_attribute FROM products p
    LEFT JOIN (SELECT product_id, count(*) AS n, min(name) AS first_name FROM attributes GROUP BY 1) a USING (product_id)
    LEFT JOIN (SELECT product_id, count(*) AS n FROM evidence GROUP BY 1) e USING (product_id)
    LEFT JOIN (SELECT product_id, count(*) AS n FROM conflicts GROUP BY 1) f USING (product_id)
    LEFT JOIN (SELECT product_id, count(*) AS n FROM usable_decisions GROUP BY 1) d USING (product_id)""")
def _(spark, sf):
    attributes, evidence, results, scores, usable, found = twin_parts(spark, sf)
    doc = sinks.twin_json(views.products(spark, sf), sinks.scored_twin(attributes, scores, usable), evidence, results, found,
                          usable, {"attributes": ["name"], "evidence": ["attribute", "evidence_id"], "validation": ["attribute", "rule"],
                                   "conflicts": ["attribute"], "review_history": ["ts", "decision_id"]})

    def n(section):
        return F.json_array_length(F.get_json_object("document", f"$.{section}")).cast("bigint")

    return doc.select("product_id", F.get_json_object("document", "$.product.part_number").alias("part_number"), n("attributes").alias("n_attributes"),
                      n("evidence").alias("n_evidence"), n("conflicts").alias("n_conflicts"), n("review_history").alias("n_decisions"),
                      F.coalesce(F.get_json_object("document", "$.attributes[0].name"), F.lit("")).alias("first_attribute"))


def scored(spark, sf):
    attributes, evidence, results, scores, usable, _ = twin_parts(spark, sf)
    return attributes, sinks.scored_twin(attributes, scores, usable)


TWIN = """SELECT a.*, s.confidence_score, s.confidence_band, s.evidence_count AS sources_count, s.has_conflict AS has_open_conflict,
    EXISTS (SELECT 1 FROM usable_decisions d WHERE d.product_id = a.product_id AND d.attribute = a.name) AS is_human_reviewed
    FROM attributes a JOIN scores s ON a.product_id = s.product_id AND a.name = s.attribute"""
sv.VIEWS["twin"] = TWIN

AMB = sv.lit("Attribute ")
sv.VIEWS["v_numeric"] = f"""SELECT product_id, name AS attribute, 'NumericFormatCheck' AS rule, ok AS passed, CASE WHEN ok THEN 'PASSED' ELSE 'FAILED' END AS status,
    CASE WHEN ok THEN 'LOW' WHEN len(nums) = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
    CASE WHEN len(nums) = 0 THEN 'Attribute ''' || name || ''' value ''' || value || ''' contains no valid numeric value.'
      WHEN NOT ok THEN 'Attribute ''' || name || ''' value ''' || value || ''' contains negative numeric value.'
      ELSE 'Numeric format for ''' || name || ''' is valid.' END AS message
    FROM (SELECT *, len(nums) > 0 AND len(list_filter(nums, lambda q: q < 0)) = 0 AS ok FROM (
      SELECT *, {sv.plain_numbers(sv.strip('value'))} AS nums FROM attributes WHERE value IS NOT NULL AND {sv.any_of('lower(name)', vocab.NUMERIC_ATTRIBUTES)}))"""
_kind = "CASE " + " ".join(f"WHEN contains(lower(name), {sv.lit(k)}) THEN {sv.lit(k)}" for k in vocab.ALLOWED_UNITS) + " END"
_fine = "given IS NULL OR CASE kind " + " ".join(f"WHEN {sv.lit(k)} THEN given IN {sv.in_list(u)}" for k, u in vocab.ALLOWED_UNITS.items()) + " END"
_want = "CASE kind " + " ".join(f"WHEN {sv.lit(k)} THEN {sv.lit(', '.join(sorted(u)))}" for k, u in vocab.ALLOWED_UNITS.items()) + " END"
sv.VIEWS["v_unit"] = f"""SELECT product_id, name AS attribute, 'UnitConsistencyCheck' AS rule, ok AS passed, CASE WHEN ok THEN 'PASSED' ELSE 'FAILED' END AS status,
    CASE WHEN ok THEN 'LOW' ELSE 'CRITICAL' END AS severity,
    CASE WHEN ok THEN 'Unit ''' || coalesce(given, 'default') || ''' is consistent for ''' || name || '''.'
      ELSE 'Unit mismatch for ''' || name || ''': ''' || given || ''' is not a valid unit for ' || kind || ' (expected one of: ' || {_want} || ').' END AS message
    FROM (SELECT *, {_fine} AS ok FROM (SELECT *, {_kind} AS kind,
      coalesce(nullif(lower({sv.strip('unit')}), ''), lower({sv.hit(sv.strip('value'), r'[0-9]\s*([a-zA-Z]+(?:\s*[a-zA-Z]+)?)$')})) AS given
      FROM attributes WHERE value IS NOT NULL) WHERE kind IS NOT NULL)"""
_bk = "CASE " + " ".join(f"WHEN contains(lower(name), {sv.lit(k)}) THEN {sv.lit(k)}" for k in vocab.VALUE_BOUNDS) + " END"


def _bound(i: int, text: bool = False) -> str:
    return "CASE kind " + " ".join(f"WHEN {sv.lit(k)} THEN {sv.lit(str(b[i])) if text or i == 2 else b[i]}" for k, b in vocab.VALUE_BOUNDS.items()) + " END"


sv.VIEWS["v_bounds"] = f"""SELECT product_id, name AS attribute, 'ImpossibleValueCheck' AS rule, ok AS passed, CASE WHEN ok THEN 'PASSED' ELSE 'FAILED' END AS status,
    CASE WHEN ok THEN 'LOW' ELSE 'CRITICAL' END AS severity,
    CASE WHEN ok THEN 'Value ' || CAST(x AS VARCHAR) || ' ' || {_bound(2)} || ' is within physical bounds for ''' || name || '''.'
      ELSE 'Impossible value detected: ' || CAST(x AS VARCHAR) || ' ' || {_bound(2)} || ' is outside physical bounds (' || {_bound(0, True)} || ' - ' || {_bound(1, True)} || ' ' || {_bound(2)} || ') for ''' || name || '''.' END AS message
    FROM (SELECT *, x >= {_bound(0)} AND x <= {_bound(1)} AS ok FROM (SELECT *, {_bk} AS kind,
      {sv.plain_numbers("coalesce(nullif(normalized_value, ''), value)")}[1] AS x FROM attributes WHERE value IS NOT NULL) WHERE kind IS NOT NULL AND x IS NOT NULL)"""
sv.VIEWS["v_rows"] = "SELECT * FROM v_numeric UNION ALL SELECT * FROM v_unit UNION ALL SELECT * FROM v_bounds"
sv.VIEWS["v_required"] = """SELECT p.product_id, r.attribute, 'RequiredAttributesCheck' AS rule, a.value IS NOT NULL AS passed,
    CASE WHEN a.value IS NULL THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN a.value IS NULL THEN 'HIGH' ELSE 'LOW' END AS severity,
    CASE WHEN a.value IS NULL THEN 'Required attribute ''' || r.attribute || ''' is missing or marked UNKNOWN.'
      ELSE 'Required attribute ''' || r.attribute || ''' is present (' || a.value || ').' END AS message
    FROM (SELECT product_id FROM products) p CROSS JOIN (VALUES ('voltage'), ('current')) r(attribute)
    LEFT JOIN (SELECT * FROM attributes WHERE value <> '' AND upper(status) <> 'UNKNOWN') a ON a.product_id = p.product_id AND a.name = r.attribute"""
_w = "CASE " + " ".join(f"WHEN contains(lower(coalesce(document_name, source_name, '')), {sv.lit(k)}) THEN {wt}" for k, wt in vocab.SOURCE_WEIGHTS) + f" ELSE {vocab.UNNAMED_SOURCE_WEIGHT} END"
sv.VIEWS["signals"] = f"""SELECT product_id, attribute, CAST(max({_w}) AS DOUBLE) AS rel, round(avg(similarity), 8) AS mean_sim, count(*) AS evidence_count,
    count(DISTINCT coalesce(document_name, source_name)) AS agreeing FROM evidence GROUP BY 1, 2"""
_strength = f"CASE WHEN mean_sim >= 0.8 THEN least(1.0, round_even(mean_sim, 2)) ELSE greatest(0.8, least(1.0, round_even(round(0.8 + mean_sim * 0.25, 8), 2))) END"
sv.VIEWS["factors"] = "SELECT product_id, attribute, CAST(min(CASE WHEN passed THEN 1.0 WHEN severity = 'CRITICAL' THEN 0.1 WHEN severity = 'HIGH' THEN 0.5 ELSE 0.85 END) AS DOUBLE) AS vf FROM v_rows GROUP BY 1, 2"
sv.VIEWS["scores0"] = f"""SELECT a.product_id, a.name AS attribute, a.value, a.status, s.evidence_count, s.agreeing AS agreeing_sources, s.mean_sim,
    s.rel AS source_reliability, CAST({_strength} AS DOUBLE) AS evidence_strength,
    CAST(CASE WHEN agreeing >= 3 THEN 1.15 WHEN agreeing >= 2 THEN 1.05 ELSE 1.0 END AS DOUBLE) AS agreement_score,
    CAST(CASE WHEN a.is_ambiguous THEN 0.8 ELSE 1.0 END AS DOUBLE) AS extraction_quality, coalesce(f.vf, 1.0::DOUBLE) AS validation_factor,
    o.product_id IS NOT NULL AS has_conflict, CASE WHEN o.product_id IS NOT NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS conflict_factor
    FROM attributes a JOIN signals s ON a.product_id = s.product_id AND a.name = s.attribute
    LEFT JOIN factors f ON a.product_id = f.product_id AND a.name = f.attribute
    LEFT JOIN (SELECT DISTINCT product_id, attribute FROM conflicts WHERE status = 'OPEN') o ON a.product_id = o.product_id AND a.name = o.attribute"""
sv.VIEWS["scores"] = f"""SELECT *, CASE WHEN confidence_score >= 90 THEN 'HIGH' WHEN confidence_score >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band,
    has_conflict OR validation_factor <= 0.2 AS is_blocked FROM (SELECT *, {sv.score('least(100.0, greatest(0.0, 100.0 * source_reliability * evidence_strength * agreement_score * extraction_quality * validation_factor * conflict_factor))', 1)} AS confidence_score FROM scores0)"""


@query("snk_twin_csv", """SELECT p.part_number, p.brand, p.description, p.category, t.name AS attribute_name, coalesce(t.value, '') AS raw_value,
    coalesce(nullif(t.normalized_value, ''), t.value, '') AS canonical_value, coalesce(t.unit, '') AS unit, t.confidence_score AS confidence_pct, t.confidence_band, t.status,
    t.sources_count, CASE WHEN t.is_human_reviewed THEN 'YES' ELSE 'NO' END AS is_human_reviewed, CASE WHEN t.has_open_conflict THEN 'YES' ELSE 'NO' END AS has_open_conflict
    FROM products p JOIN twin t USING (product_id)""")
def _(spark, sf):
    return sinks.twin_csv(views.products(spark, sf), scored(spark, sf)[1])


@query("src_twin_read", """SELECT p.product_id, p.part_number, p.status AS product_status, t.name, t.value, t.confidence_score, t.sources_count,
    t.has_open_conflict, t.is_human_reviewed FROM products p LEFT JOIN twin t USING (product_id)""")
def _(spark, sf):
    p = views.products(spark, sf).select("product_id", "part_number", c("status").alias("product_status"))
    return sinks.twin_read(p, scored(spark, sf)[1].drop("status")).select(
        "product_id", "part_number", "product_status", "name", "value", "confidence_score", "sources_count", "has_open_conflict", "is_human_reviewed")


def _wide(spark, sf):
    p, a = views.products(spark, sf), once(views.attributes(spark, sf))
    return delivery.to_delivery(describe.describe(p, a), a)


@query("snk_delivery_csv")
def _(spark, sf):
    folder = scratch(spark)
    sinks.write_delivery_csv(_wide(spark, sf), f"{folder}/delivery")
    return spark.read.option("header", True).option("escape", '"').csv(f"{folder}/delivery").select(
        "PART_NUMBER", "BRAND_NAME", "SHORT_DESC", "`ATTRIBUTE_LABEL 1`", "`ATTRIBUTE_VALUE 1`")


@query("snk_metrics_json", f"""SELECT count(*) AS total_products, count(*) FILTER (status IN ('VERIFIED', 'PUBLISHED', 'REVIEWED')) AS verified_count,
    count(*) FILTER (status = 'REQUIRES_REVIEW') AS needs_review_count, (SELECT count(*) FROM conflicts WHERE status = 'OPEN') AS conflicts_count,
    {sv.score('avg(coalesce(overall_quality_score, 0.0))', 1)} AS average_quality_score, 'weekly' AS label FROM products""")
def _(spark, sf):
    folder = scratch(spark)
    figures = catalog.summary(views.products(spark, sf), views.conflicts(spark, sf))
    sinks.write_metrics(figures, f"{folder}/metrics", "weekly")
    return spark.read.parquet(f"{folder}/metrics").withColumn("label", c("label").cast("string"))


@query("snk_replace_children", """SELECT product_id, name, value, status FROM attributes WHERE product_id NOT IN (SELECT product_id FROM products WHERE status = 'DRAFT')
    UNION ALL SELECT product_id, attribute, first_raw, 'FRESH' FROM cvalues WHERE product_id IN (SELECT product_id FROM products WHERE status = 'DRAFT')""")
def _(spark, sf):
    rerun = views.products(spark, sf).filter(c("status") == "DRAFT")
    values = cl.claim_values(cl.with_canonical(cl.stated(views.claims(spark, sf)), known=views.norms(spark, sf)))
    fresh = values.join(rerun.select("product_id"), "product_id", "left_semi").select(
        "product_id", c("attribute").alias("name"), c("first_raw").alias("value"), F.lit("FRESH").alias("status"))
    return store.replace_children(views.attributes(spark, sf).select("product_id", "name", "value", "status"), fresh, rerun)


@query("snk_upsert", """SELECT coalesce(b.product_id, a.product_id) AS product_id, coalesce(b.part_number, a.part_number) AS part_number,
    coalesce(b.status, a.status) AS status, a.category FROM (SELECT product_id, part_number, status, category FROM products) a
    FULL JOIN (SELECT s_suppkey * 30 AS product_id, 'NEW-' || s_suppkey AS part_number, CASE WHEN s_suppkey % 2 = 0 THEN 'UPDATED' END AS status FROM supplier) b ON a.product_id = b.product_id""")
def _(spark, sf):
    changes = views.table(spark, sf, "supplier").select((c("s_suppkey") * 30).alias("product_id"), F.concat(F.lit("NEW-"), c("s_suppkey").cast("string")).alias("part_number"),
                                                        F.when(c("s_suppkey") % 2 == 0, "UPDATED").alias("status"))
    return store.upsert(views.products(spark, sf).select("product_id", "part_number", "status", "category"), changes, "product_id")


# ---------------------------------------------------------------- cleaning

PH = sv.in_list(vocab.PLACEHOLDERS)


@query("cln_placeholder", f"SELECT product_id, coalesce(lower({sv.strip('brand')}) IN {PH}, false) AS brand_void, coalesce(lower({sv.strip('manufacturer')}) IN {PH}, false) AS maker_void FROM feed")
def _(spark, sf):
    return views.feed(spark, sf).select("product_id", F.coalesce(text.is_placeholder(c("brand")), F.lit(False)).alias("brand_void"),
                                        F.coalesce(text.is_placeholder(c("manufacturer")), F.lit(False)).alias("maker_void"))


def _cleaner(name, column, fn, sql):
    @query(name, f"SELECT product_id, {sql(column)} AS {column} FROM feed")
    def _(spark, sf):
        return views.feed(spark, sf).select("product_id", fn(c(column)).alias(column))


_cleaner("cln_part_number", "part_number", text.clean_part_number, sv.clean)
_cleaner("cln_description", "description", text.clean_description, sv.clean)
_cleaner("cln_category", "category", text.clean_category, sv.clean_category)


@query("cln_brand_mfr", f"SELECT product_id, {sv.clean('brand')} AS brand, {sv.clean('manufacturer')} AS manufacturer FROM feed")
def _(spark, sf):
    return views.feed(spark, sf).select("product_id", text.clean_brand(c("brand")).alias("brand"), text.clean_manufacturer(c("manufacturer")).alias("manufacturer"))


@query("cln_flags", f"""SELECT product_id, part_number AS raw, {sv.clean('part_number')} AS cleaned, coalesce(lower({sv.strip('part_number')}) IN {PH}, false) AS was_placeholder,
    coalesce({sv.strip('part_number')} = '', true) AS was_empty FROM feed""")
def _(spark, sf):
    return views.feed(spark, sf).select("product_id", text.cleaned(c("part_number")).alias("f")).select("product_id", "f.*")


@query("cln_first_brand", "SELECT product_id, brand FROM clean_feed")
def _(spark, sf):
    return views.feed(spark, sf).select("product_id", text.first_real(c("E1_Brand"), c("Unilog_Brand"), c("DIB_Brand")).alias("brand"))


@query("cln_resolved_pred", f"SELECT product_id, {sv.resolved('manufacturer')} AS maker_ok, {sv.resolved('taxonomy_class')} AS class_ok FROM products")
def _(spark, sf):
    return views.products(spark, sf).select("product_id", text.is_resolved_value(c("manufacturer")).alias("maker_ok"), text.is_resolved_value(c("taxonomy_class")).alias("class_ok"))


@query("cln_valid_text", f"SELECT product_id, {sv.valid('description')} AS ok FROM products")
def _(spark, sf):
    return views.products(spark, sf).select("product_id", text.is_valid_text(c("description")).alias("ok"))


@query("cln_export_blank", f"SELECT product_id, {sv.export('manufacturer')} AS manufacturer, {sv.export('category')} AS category FROM products")
def _(spark, sf):
    return views.products(spark, sf).select("product_id", text.export_value(c("manufacturer")).alias("manufacturer"), text.export_value(c("category")).alias("category"))


# ---------------------------------------------------------------- entity resolution


def _brands(spark, sf):
    return resolve.resolve_brand(views.feed(spark, sf), views.brand_master(spark), "brand", "r").select("product_id", "r.*")


def _makers(spark, sf):
    return resolve.resolve_manufacturer(views.feed(spark, sf), views.maker_master(spark), "manufacturer", "r").select("product_id", "r.*")


@query("er_split_code", "SELECT product_id, r_name AS name, r_code AS code FROM brand_parts")
def _(spark, sf):
    name, code = resolve.split_code(c("brand"))
    return views.feed(spark, sf).select("product_id", name.alias("name"), code.alias("code"))


@query("er_norm_key", "SELECT product_id, r_key FROM brand_parts")
def _(spark, sf):
    return resolve.name_parts(views.feed(spark, sf), "brand").select("product_id", "r_key")


@query("er_strip_suffix", "SELECT product_id, r_bare FROM mfr_parts")
def _(spark, sf):
    return resolve.name_parts(views.feed(spark, sf), "manufacturer").select("product_id", "r_bare")


@query("er_master_overlay", """SELECT key, canonical, CASE WHEN src = 'base' THEN ord ELSE 1000000000 + ord END AS ord FROM (
    SELECT coalesce(b.key, n.key) AS key, coalesce(n.canonical, b.canonical) AS canonical, coalesce(b.ord, n.ord) AS ord, CASE WHEN b.key IS NULL THEN 'new' ELSE 'base' END AS src
    FROM brand_master b FULL JOIN (SELECT p_partkey AS ord, lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_partkey END AS key, upper(p_brand) AS canonical
      FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || p_partkey END ORDER BY p_partkey) = 1) n ON b.key = n.key)""")
def _(spark, sf):
    p = views.table(spark, sf, "part")
    custom = p.select(c("p_partkey").alias("ord"), F.concat(F.lower("p_brand"), F.when(c("p_partkey") % 3 == 0, "").otherwise(
        F.concat(F.lit(" "), c("p_partkey").cast("string")))).alias("key"), F.upper("p_brand").alias("canonical"))
    return resolve.overlay(views.brand_master(spark), custom)


def _slice(name, base, view, where, fields="canonical_value, confidence, match_type, status"):
    @query(name, f"SELECT product_id, {fields} FROM {view} WHERE {where}")
    def _(spark, sf):
        return base(spark, sf).filter(where).select("product_id", *fields.split(", "))


_slice("er_brand_exact", _brands, "brand_res", "confidence IN (0.98, 0.95)")
_slice("er_brand_suffix", _brands, "brand_res", "confidence = 0.9")
_slice("er_brand_prefix", _brands, "brand_res", "confidence = 0.75")
_slice("er_mfr_exact", _makers, "mfr_res", "confidence = 0.95", "raw_code, canonical_value, confidence, match_type, status")
_slice("er_mfr_code", _makers, "mfr_res", "confidence = 0.9", "raw_code, canonical_value, confidence, match_type, status")
_slice("er_mfr_prefix", _makers, "mfr_res", "confidence = 0.78", "raw_code, canonical_value, confidence, match_type, status")
_slice("er_title_fallback", _makers, "mfr_res", "confidence = 0.4", "raw_name, canonical_value, match_type, status")
_slice("er_placeholder_null", _makers, "mfr_res", "confidence = 0.0", "raw_value, raw_name, normalized_value, canonical_value, status")


def _both_names(spark, feed):
    masters = {resolve.BRAND: views.brand_master(spark), resolve.MAKER: views.maker_master(spark)}
    return resolve.resolve_columns(feed, {"b": (resolve.BRAND, "brand"), "m": (resolve.MAKER, "manufacturer")}, masters)


@query("er_clean_value", "SELECT b.product_id, b.canonical_value AS brand, m.canonical_value AS manufacturer FROM brand_res b JOIN mfr_res m USING (product_id)")
def _(spark, sf):
    d = _both_names(spark, views.feed(spark, sf))
    return d.select("product_id", c("b.canonical_value").alias("brand"), c("m.canonical_value").alias("manufacturer"))


sv.VIEWS["words"] = r"SELECT product_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS line FROM mined"
sv.VIEWS["candidates"] = """SELECT product_id, arg_max(canonical, length(alias) * 1000 - rnk) AS candidate_brand FROM words JOIN (
    SELECT alias, min(canonical) AS canonical, row_number() OVER (ORDER BY alias) AS rnk, replace(alias, '#', ' ') AS form FROM (
      SELECT key AS alias, canonical FROM brand_master UNION SELECT lower(canonical), canonical FROM brand_master) GROUP BY alias) a
    ON contains(line, ' ' || form || ' ') GROUP BY product_id"""


def _candidates(spark, sf):
    f = fd.clean_feed(views.feed(spark, sf))
    line = extract.mined_text(c("part_number"), c("description"))
    return f, resolve.candidate_brand(f.select("product_id", line.alias("text")), resolve.brand_aliases(views.brand_master(spark)), "product_id", "text")


@query("er_candidate_brand", "SELECT product_id, candidate_brand FROM candidates")
def _(spark, sf):
    return _candidates(spark, sf)[1]


@query("er_brand_fallback", """SELECT r.product_id, CASE WHEN r.status = 'UNRESOLVED' AND k.candidate_brand IS NOT NULL THEN k.candidate_brand ELSE r.canonical_value END AS brand,
    CASE WHEN r.status = 'UNRESOLVED' AND k.candidate_brand IS NOT NULL THEN 'RESOLVED' ELSE r.status END AS status FROM cbrand_res r LEFT JOIN candidates k USING (product_id)""")
def _(spark, sf):
    f, found = _candidates(spark, sf)
    d = resolve.brand_with_fallback(f.join(found, "product_id", "left"), views.brand_master(spark))
    return d.select("product_id", c("brand_res.canonical_value").alias("brand"), "brand_res.status")


# ---------------------------------------------------------------- classification


def _tax_sql() -> str:
    def pts(r):
        kw = [f"CASE WHEN contains(h, {sv.lit(k)}) THEN 3 WHEN contains(d, {sv.lit(k)}) THEN 2 ELSE 0 END" for k in r["keywords"]]
        kw += [f"CASE WHEN contains(h || ' ' || d, {sv.lit(k)}) THEN 1 ELSE 0 END" for k in r["desc_keywords"]]
        return " + ".join(kw)

    rules = " UNION ALL ".join(
        f"SELECT product_id, category, {i} AS i, {pts(r)} AS score, {sv.any_of('h', r['keywords'])} AS hinted, {sv.lit(r['dept'])} AS dept, {sv.lit(r['class_name'])} AS class_name, {sv.lit(r['fine'])} AS fine FROM t"
        for i, r in enumerate(views.TAX_RULES))
    return f"""SELECT product_id, CASE WHEN score > 0 THEN dept ELSE 'Unclassified' END AS dept, CASE WHEN score > 0 THEN class_name ELSE 'Unclassified' END AS class_name,
        CASE WHEN score > 0 THEN fine ELSE 'Unclassified' END AS fine,
        CASE WHEN score > 0 THEN dept || ' > ' || class_name || ' > ' || fine ELSE coalesce(nullif(category, ''), 'Unclassified') END AS classpath,
        CASE WHEN score = 0 THEN 0.0 WHEN score >= 4 THEN 0.90 ELSE 0.75 END::DOUBLE AS confidence,
        CASE WHEN score = 0 THEN 'UNRESOLVED' WHEN score >= 4 OR hinted THEN 'RESOLVED' ELSE 'HEURISTIC' END AS status, score FROM (
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, i) AS rn FROM (
          WITH t AS (SELECT product_id, category, lower(coalesce(category, '')) AS h, lower(coalesce(description, '')) AS d FROM clean_feed) {rules})) WHERE rn = 1"""


sv.VIEWS["tax"] = _tax_sql()


def _taxed(spark, sf):
    return classify.classify(fd.clean_feed(views.feed(spark, sf)), views.TAX_RULES)


@query("tax_classify", "SELECT product_id, dept, class_name, fine, score FROM tax")
def _(spark, sf):
    return _taxed(spark, sf).select("product_id", "tax.dept", "tax.class_name", "tax.fine", "tax.score")


@query("tax_status", "SELECT product_id, classpath, confidence, status FROM tax")
def _(spark, sf):
    return _taxed(spark, sf).select("product_id", "tax.classpath", "tax.confidence", "tax.status")


@query("tax_apply_category", """SELECT product_id, CASE WHEN t.status IN ('RESOLVED', 'HEURISTIC') AND t.classpath <> 'Unclassified' THEN t.classpath ELSE f.category END AS category
    FROM clean_feed f JOIN tax t USING (product_id)""")
def _(spark, sf):
    return classify.apply_category(_taxed(spark, sf)).select("product_id", "category")


_types = ", ".join(f"({i}, {sv.lit(p)}, {sv.lit(n)}, {conf}::DOUBLE)" for i, (p, n, conf) in enumerate(views.TYPE_PATTERNS))
sv.VIEWS["types"] = f"""SELECT m.product_id, h.name AS candidate_type, coalesce(h.conf, 0.0) AS confidence,
    CASE WHEN h.conf IS NULL THEN 'UNRESOLVED' WHEN h.conf >= 0.85 THEN 'CANDIDATE' ELSE 'LOW_CONFIDENCE' END AS status FROM mined m LEFT JOIN (
      SELECT product_id, name, conf, row_number() OVER (PARTITION BY product_id ORDER BY conf DESC, i) AS rn
      FROM mined JOIN (VALUES {_types}) t(i, pat, name, conf) ON regexp_matches(lower(text), pat)) h ON m.product_id = h.product_id AND h.rn = 1"""


def _mined(spark, sf):
    f = fd.clean_feed(views.feed(spark, sf))
    return f.withColumn("text", extract.mined_text(c("part_number"), c("description")))


@query("type_detect", "SELECT product_id, candidate_type, confidence, status FROM types")
def _(spark, sf):
    return _mined(spark, sf).select("product_id", classify.detect_type(c("text"), views.TYPE_PATTERNS).alias("t")).select("product_id", "t.*")


_cat = "CASE " + " ".join(f"WHEN {sv.any_of('x', w)} THEN {sv.lit(n)}" for n, w in vocab.CATEGORY_KEYWORDS) + " ELSE 'other' END"


@query("cat_first_match", f"SELECT product_id, {_cat} AS bucket FROM (SELECT product_id, lower(coalesce(description, '') || ' ' || coalesce(brand, '')) AS x FROM clean_feed)")
def _(spark, sf):
    return fd.clean_feed(views.feed(spark, sf)).select("product_id", classify.input_category(c("description"), c("brand")).alias("bucket"))


_coarse = "CASE " + " ".join(f"WHEN {sv.any_of('lower(text)', w)} THEN {sv.lit(n)}" for w, n in vocab.COARSE_CLASSES) + f" ELSE {sv.lit(vocab.COARSE_DEFAULT)} END"


@query("cls_coarse", f"SELECT doc_id, {_coarse} AS coarse FROM documents")
def _(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", classify.coarse_class(c("text")).alias("coarse"))


_fail = f"""CASE WHEN {sv.strip("coalesce(raw_value, '')")} IN ('', '-', '--') THEN 'missing manufacturer'
    WHEN lower({sv.strip('raw_value')}) IN {sv.in_list(vocab.RESOLVER_PLACEHOLDERS)} THEN 'placeholder manufacturer'
    WHEN regexp_matches(raw_value, '[^\\p{{L}}\\p{{N}}_\\s()\\-.,&'']') THEN 'malformed manufacturer strings'
    WHEN status = 'REVIEW_REQUIRED' THEN 'ambiguous manufacturer' WHEN match_type = 'UNRESOLVED' AND status <> 'RESOLVED' THEN 'unknown manufacturer' ELSE 'parsing failure' END"""


@query("cls_mfr_failure", f"SELECT product_id, {_fail} AS reason FROM mfr_res WHERE status <> 'RESOLVED'")
def _(spark, sf):
    return _makers(spark, sf).filter("status <> 'RESOLVED'").select("product_id", classify.manufacturer_failure(c("raw_value"), c("status"), c("match_type")).alias("reason"))


@query("cls_tax_outcome", """SELECT product_id, CASE WHEN status = 'RESOLVED' AND lower(class_name) <> 'unclassified' THEN 'correct_confident'
    WHEN status = 'HEURISTIC' THEN 'heuristic' ELSE 'unresolved' END AS outcome FROM tax""")
def _(spark, sf):
    return _taxed(spark, sf).select("product_id", classify.taxonomy_outcome(c("tax.status"), c("tax.class_name")).alias("outcome"))


# ---------------------------------------------------------------- extraction


def _facts(spark, sf, build):
    d = _mined(spark, sf)
    return extract.dedupe_facts(extract.explode_facts(d, "product_id", build(c("text")))).select("product_id", "attribute", "value")


def _dedup(parts: list[str]) -> str:
    """First spelling per attribute and lower-cased value over unions of (product_id, ord, attribute, value)."""
    rows = " UNION ALL ".join(parts)
    return (f"SELECT product_id, attribute, arg_min(value, ord) AS value FROM (SELECT product_id, ord, attribute, {sv.strip('value')} AS value FROM ({rows})) "
            "WHERE value <> '' GROUP BY product_id, attribute, lower(value)")


def _all_hits(i: int, name: str, pattern: str, group: int = 0) -> str:
    return (f"SELECT product_id, {i * 1000000} + u.i AS ord, {sv.lit(name)} AS attribute, u.v AS value FROM (SELECT product_id, unnest(list_transform("
            f"regexp_extract_all(text, {sv.lit(pattern)}, {group}), lambda v, i: {{'v': v, 'i': i}})) AS u FROM mined)")


def _flags(i: int, rows) -> str:
    return " UNION ALL ".join(f"SELECT product_id, {i * 1000000 + j} AS ord, {sv.lit(a)} AS attribute, {sv.lit(v)} AS value FROM mined WHERE {sv.has('text', p)}"
                              for j, (p, v, a) in enumerate(rows))


@query("ext_dimension")
def _(spark, sf):
    d = _mined(spark, sf)
    long = extract.explode_facts(d, "product_id", extract.dimension_facts(c("text"), c("part_number")))
    return extract.with_measures(extract.dedupe_facts(long)).select("product_id", "attribute", "value", "measure")


@query("ext_measure_norm", f"SELECT doc_id, word, {sv.measure('word')} AS measure FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9][0-9./-]*[a-z\"]*'))) AS word FROM documents)")
def _(spark, sf):
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r'[0-9][0-9./-]*[a-z"]*'), F.lit(0)))
    d = views.table(spark, sf, "documents").select("doc_id", F.explode(words).alias("word"))
    return d.withColumn("measure", units.normalize_measure(c("word")))


@query("ext_quantity", _dedup([_all_hits(i, "quantity", p) for i, p in enumerate(vocab.QUANTITIES)]))
def _(spark, sf):
    return _facts(spark, sf, extract.quantity_facts)


@query("ext_grit_series_model", _dedup([_all_hits(0, "grit", vocab.GRIT), _all_hits(1, "series", vocab.SERIES, 1), _all_hits(2, "model", vocab.MODEL, 1)]))
def _(spark, sf):
    return _facts(spark, sf, extract.label_facts)


@query("ext_physical", _dedup([_all_hits(i, n, p) for i, (n, p) in enumerate(vocab.PHYSICAL_PATTERNS)]))
def _(spark, sf):
    return _facts(spark, sf, extract.physical_facts)


@query("ext_material", _dedup([_flags(0, [(p, v, "material") for p, v in vocab.MATERIALS])]))
def _(spark, sf):
    return _facts(spark, sf, extract.material_facts)


@query("ext_colour_finish", _dedup([_flags(0, vocab.COLOURS_FINISHES)]))
def _(spark, sf):
    return _facts(spark, sf, extract.colour_finish_facts)


@query("ext_application", _dedup([_flags(0, [(p, v, "application") for p, v in vocab.APPLICATIONS])]))
def _(spark, sf):
    return _facts(spark, sf, extract.application_facts)


@query("ext_connection", _dedup([_flags(0, [(p, v, "connection") for p, v in vocab.CONNECTIONS])]))
def _(spark, sf):
    return _facts(spark, sf, extract.connection_facts)


_mount = sv.hit("text", vocab.MOUNT_PHRASE)


@query("ext_mounting_text", f"SELECT product_id, 'mounting' AS attribute, {sv.title(_mount)} AS value FROM mined WHERE {_mount} IS NOT NULL")
def _(spark, sf):
    return _facts(spark, sf, extract.mounting_facts)


@query("ext_type_fact", "SELECT product_id, 'product_type' AS attribute, candidate_type AS value FROM types WHERE candidate_type IS NOT NULL")
def _(spark, sf):
    return _facts(spark, sf, lambda t: extract.type_facts(t, views.TYPE_PATTERNS))


@query("ext_source_brand", f"SELECT product_id, 'source_brand' AS attribute, {sv.strip('brand')} AS value FROM clean_feed WHERE {sv.strip('brand')} <> ''")
def _(spark, sf):
    return _facts(spark, sf, lambda _: extract.field_facts("source_brand", c("brand")))


@query("ext_brand_fact", "SELECT product_id, unnest(['candidate_brand', 'brand']) AS attribute, candidate_brand AS value FROM candidates")
def _(spark, sf):
    _, found = _candidates(spark, sf)
    return extract.explode_facts(found, "product_id", extract.text_brand_facts(c("candidate_brand"))).select("product_id", "attribute", "value")


@query("ext_model_prefix", "SELECT product_id, 'model' AS attribute, part_number AS value FROM clean_feed WHERE part_number <> '' AND starts_with(upper(description), upper(part_number))")
def _(spark, sf):
    return _facts(spark, sf, lambda _: extract.model_prefix_facts(c("description"), c("part_number")))


_TEXT_MINERS = ([_all_hits(i, "quantity", p) for i, p in enumerate(vocab.QUANTITIES)]
                + [_all_hits(10, "grit", vocab.GRIT), _all_hits(11, "series", vocab.SERIES, 1), _all_hits(12, "model", vocab.MODEL, 1)]
                + [_all_hits(20 + i, n, p) for i, (n, p) in enumerate(vocab.PHYSICAL_PATTERNS)])
sv.VIEWS["facts"] = _dedup(_TEXT_MINERS)


def _plain_facts(spark, sf):
    d = _mined(spark, sf)
    t = c("text")
    long = extract.explode_facts(d, "product_id", F.concat(extract.quantity_facts(t), extract.label_facts(t), extract.physical_facts(t)))
    return extract.dedupe_facts(long)


@query("ext_dedupe", "SELECT product_id, attribute, value FROM facts")
def _(spark, sf):
    return _plain_facts(spark, sf).select("product_id", "attribute", "value")


def _evidence_value_sql(text: str, name: str) -> str:
    tail = name.rsplit("_", 1)[-1]
    tried = list(vocab.EVIDENCE_PATTERNS[name]) + (list(vocab.EVIDENCE_PATTERNS.get(tail, ())) if tail != name else [])
    return "coalesce(" + ", ".join(sv.no_blank(sv.strip(f"regexp_extract({text}, {sv.lit(p)}, 0)")) for p in tried) + ")"


_ASKED = ("voltage", "weight", "poles", "trip_class", "protection", "efficiency", "output_current", "input_voltage")


@query("ext_evidence_value", "SELECT document_id, chunk_index, attribute, value FROM (" + " UNION ALL ".join(
    f"SELECT document_id, chunk_index, {sv.lit(a)} AS attribute, {_evidence_value_sql('text', a)} AS value FROM lines" for a in _ASKED)
    + " UNION ALL SELECT document_id, chunk_index, 'material', CASE " + " ".join(f"WHEN {sv.has('text', p)} THEN {sv.lit(v)}" for p, v in vocab.MATERIALS)
    + " END FROM lines) WHERE value IS NOT NULL")
def _(spark, sf):
    asked = F.explode(F.array(*[F.lit(a) for a in (*_ASKED, "material")]))
    d = docs.line_chunks(views.documents(spark, sf)).withColumn("attribute", asked)
    return d.withColumn("value", extract.evidence_value(c("text"), c("attribute"))).filter("value IS NOT NULL").select(
        "document_id", "chunk_index", "attribute", "value")


@query("ext_keyword_spec", """SELECT product_id, 'voltage' AS attribute, '400 V AC' AS value, '400 V AC' AS normalized_value, 'V' AS unit, 0.98::DOUBLE AS confidence, 'VERIFIED' AS status FROM mined
    WHERE contains(lower(text), '400 v') OR contains(lower(text), '400v')
    UNION ALL SELECT product_id, 'current', CASE WHEN contains(lower(text), '12 a') THEN '12 A' ELSE '10 A' END, CASE WHEN contains(lower(text), '12 a') THEN '12 A' ELSE '10 A' END, 'A',
      CASE WHEN contains(lower(text), '12 a') THEN 0.65 ELSE 0.98 END, CASE WHEN contains(lower(text), '12 a') THEN 'CONFLICT' ELSE 'VERIFIED' END FROM mined
    WHERE contains(lower(text), '12 a') OR contains(lower(text), '10 a')
    UNION ALL SELECT product_id, 'frequency', '50/60 Hz', '50/60 Hz', 'Hz', 0.99, 'VERIFIED' FROM mined WHERE contains(lower(text), '50/60 hz') OR contains(lower(text), '50 - 60 hz') OR contains(lower(text), '50 - 60 hertz')""")
def _(spark, sf):
    d = extract.keyword_specs(_mined(spark, sf), "product_id", "text")
    return d.select("product_id", "attribute", "value", "norm.normalized_value", "norm.unit", "confidence", "status")


def _retrieved(spark, sf):
    """Per product, its claims' evidence in order of similarity."""
    from pyspark.sql import Window

    w = Window.partitionBy("product_id").orderBy(c("similarity").desc(), "claim_ord")
    return views.claims(spark, sf).select("product_id", "evidence_id", "similarity", F.row_number().over(w).alias("rank"))


sv.VIEWS["retrieved"] = "SELECT product_id, evidence_id, similarity, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, claim_ord) AS rank FROM claims"
sv.VIEWS["extracted"] = """SELECT product_id, name AS attribute, value, CASE WHEN attr_ord % 5 = 0 THEN 'UNKNOWN' WHEN attr_ord % 5 = 1 THEN 'UNVERIFIED' ELSE 'EXTRACTED' END AS status, e1, e2 FROM attributes
    LEFT JOIN (SELECT product_id, attribute AS name, min(evidence_id) AS e1, CASE WHEN count(*) > 2 THEN 'ev_missing' ELSE max(evidence_id) END AS e2,
      count(*) AS n FROM claims GROUP BY 1, 2) USING (product_id, name)"""


@query("ext_grounding", f"""SELECT product_id, attribute, CASE WHEN known THEN value END AS value, CASE WHEN known THEN z END AS normalized_value, CASE WHEN known THEN u END AS unit,
    CASE WHEN backed THEN round_even(least(1.0, greatest(0.5, round(avg_sim, 8))), 2) WHEN taken THEN 0.4 WHEN status = 'UNVERIFIED' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
    CASE WHEN backed AND NOT amb THEN 'VERIFIED' WHEN known THEN 'REQUIRES_REVIEW' ELSE 'UNKNOWN' END AS status,
    CASE WHEN known THEN coalesce(n_valid, 0) ELSE 0 END AS n_valid, CASE WHEN taken AND NOT coalesce(backed, false) THEN top_id END AS fallback_evidence_id FROM (
    SELECT x.*, s.avg_sim, s.n_valid, t.top_id, x.status = 'EXTRACTED' AND x.value IS NOT NULL AS taken, x.status = 'EXTRACTED' AND x.value IS NOT NULL AND s.n_valid > 0 AS backed,
      (x.status = 'EXTRACTED' AND x.value IS NOT NULL) OR x.status = 'UNVERIFIED' AS known
    FROM ({sv.norm_ctes('extracted', 'gz')}) x
    LEFT JOIN (SELECT product_id, attribute, avg(similarity) AS avg_sim, count(*) AS n_valid FROM (SELECT DISTINCT product_id, attribute, unnest([e1, e2]) AS evidence_id FROM extracted WHERE e1 NOT LIKE '%1')
      JOIN retrieved USING (product_id, evidence_id) GROUP BY 1, 2) s ON x.product_id = s.product_id AND x.attribute = s.attribute
    LEFT JOIN (SELECT product_id, evidence_id AS top_id FROM retrieved WHERE rank = 1) t ON x.product_id = t.product_id)""")
def _(spark, sf):
    known = views.norms(spark, sf)
    a = views.attributes(spark, sf, known)
    cited = views.claims(spark, sf).groupBy("product_id", c("attribute").alias("name")).agg(
        F.min("evidence_id").alias("e1"), F.when(F.count("*") > 2, "ev_missing").otherwise(F.max("evidence_id")).alias("e2"))
    ids = F.when(~c("e1").endswith("1"), F.array("e1", "e2")).otherwise(F.array().cast("array<string>"))
    state = F.when(c("attr_ord") % 5 == 0, "UNKNOWN").when(c("attr_ord") % 5 == 1, "UNVERIFIED").otherwise("EXTRACTED")
    x = a.join(cited, ["product_id", "name"]).select("product_id", c("name").alias("attribute"), "value", state.alias("status"), ids.alias("evidence_ids"))
    return extract.ground(x, _retrieved(spark, sf), known)


@query("ext_no_evidence", "SELECT product_id, attribute, NULL::VARCHAR AS value, 0.0::DOUBLE AS confidence, 'UNKNOWN' AS status FROM products CROSS JOIN (VALUES "
       + ", ".join(f"({sv.lit(a)})" for a in vocab.REPORTED_ATTRIBUTES) + ") r(attribute) WHERE product_id NOT IN (SELECT product_id FROM docs)")
def _(spark, sf):
    return extract.without_evidence(views.products(spark, sf), views.documents(spark, sf))


def _kept_index(spark, sf) -> ChunkIndex:
    """The lines of all documents in a stored index."""
    index = ChunkIndex(spark, f"{scratch(spark)}/index", DIM)
    index.add(docs.line_chunks(views.documents(spark, sf)))
    return index


def _bucket(t: str, dim: int) -> str:
    return f"CAST(('0x' || right(md5({t}), 8))::BIGINT % {dim} AS INT)"


# Unit vectors of texts, in long form and as lists, of what has a key.
def vector_views(name: str, source: str, key: str, text: str) -> None:
    sv.VIEWS[f"{name}_tokens"] = rf"SELECT {key}, regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+') AS w FROM {source}"
    sv.VIEWS[f"{name}_sparse"] = f"""SELECT {key}, bucket, sum(wt) AS w FROM (
        SELECT {key}, {_bucket('tok', DIM)} AS bucket, wt FROM (SELECT {key}, unnest(w) AS tok, 1.0::DOUBLE AS wt FROM {name}_tokens
          UNION ALL SELECT {key}, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || '_' || z[2])) AS tok, 1.5::DOUBLE FROM {name}_tokens WHERE len(w) > 1)) GROUP BY 1, 2"""
    sv.VIEWS[f"{name}_vec"] = f"SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_sparse"
    sv.VIEWS[f"{name}_dense"] = f"SELECT {key}, list_transform(range({DIM}), lambda b: coalesce(list_extract(map_extract(m, b), 1), 0.0)) AS v FROM (SELECT {key}, map(list(bucket::BIGINT), list(weight)) AS m FROM {name}_vec GROUP BY 1)"


sv.VIEWS["line_ids"] = "SELECT *, 'ev_' || left(sha256(document_id || '|' || page_number || '|' || chunk_index), 24) AS evidence_id FROM lines"
vector_views("line", "line_ids", "evidence_id", "text")
_fields = "concat_ws(' ', nullif(brand, ''), nullif(part_number, ''), nullif(category, ''), nullif(description, ''), " + sv.lit(retrieve.ASKED) + ")"
sv.VIEWS["product_asks"] = f"SELECT product_id AS ask_id, {_fields} AS ask FROM products"
vector_views("product", "product_asks", "ask_id", "ask")


def _reported_value(text: str) -> str:
    known = " ".join(f"WHEN {sv.lit(a)} THEN {_evidence_value_sql(text, a)}" for a in vocab.REPORTED_ATTRIBUTES if a in vocab.EVIDENCE_PATTERNS)
    return f"CASE attribute {known} WHEN 'material' THEN CASE " + " ".join(f"WHEN {sv.has(text, p)} THEN {sv.lit(v)}" for p, v in vocab.MATERIALS) + " END END"


@query("ext_retrieve_extract", f"""SELECT product_id, attribute, arg_min(value, rank) AS value, arg_min(score, rank) AS similarity FROM (
    SELECT product_id, attribute, rank, score, {_reported_value('text')} AS value FROM (
        SELECT ask_id AS product_id, evidence_id, round(raw, 4) AS score, row_number() OVER (PARTITION BY ask_id ORDER BY round(raw, 8) DESC, evidence_id) AS rank FROM (
            SELECT a.ask_id, l.evidence_id, least(1.0, list_dot_product(a.v, l.v)) AS raw FROM product_dense a, (SELECT evidence_id, product_id, v FROM line_ids JOIN line_dense USING (evidence_id)) l
            WHERE l.product_id = a.ask_id OR a.ask_id NOT IN (SELECT doc_id FROM documents)) QUALIFY rank <= 5) h
    JOIN (SELECT evidence_id, text FROM line_ids) USING (evidence_id), (VALUES {", ".join(f"({sv.lit(a)})" for a in vocab.REPORTED_ATTRIBUTES)}) r(attribute) WHERE score >= 0.05)
    WHERE value <> '' GROUP BY 1, 2""")
def _(spark, sf):
    found = retrieve.retrieve_and_extract(_kept_index(spark, sf).read(), views.products(spark, sf), dim=DIM)
    return found.select("product_id", "attribute", "value", "similarity")


_block = """'[Evidence ID: ' || evidence_id || ']' || chr(10) || 'Document: ' || source_name || ' (Page ' || page_number || ', Chunk #' || chunk_index || ')' || chr(10) ||
    'Similarity Score: ' || printf('%.4f', similarity) || chr(10) || 'Content:' || chr(10) || snippet || chr(10)"""


@query("ext_format_evidence", f"SELECT product_id, string_agg({_block}, chr(10) || chr(10) ORDER BY rank) AS evidence_text FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, evidence_id) AS rank, "
       "CAST(page_number AS INT) AS chunk_index FROM claims) WHERE rank <= 5 GROUP BY product_id")
def _(spark, sf):
    d = views.claims(spark, sf).select("product_id", "evidence_id", c("source_name").alias("document_name"), "page_number", c("page_number").alias("chunk_index"),
                                       c("snippet").alias("text"), c("similarity").alias("raw_score"))
    return extract.evidence_text(retrieve.top_k(d, 5, ["product_id"]), "product_id")


@query("ext_taxonomy_attrs", """SELECT product_id, unnest(['Dept', 'Class_name', 'Fine', 'Classpath', 'Confidence', 'Status']) AS attribute,
    unnest([dept, class_name, fine, classpath, CAST(confidence AS VARCHAR), status]) AS value, '' AS unit, 0.9::DOUBLE AS confidence, 'VERIFIED' AS status FROM tax""")
def _(spark, sf):
    return extract.taxonomy_attributes(_taxed(spark, sf))


# ---------------------------------------------------------------- normalisation

sv.VIEWS["claims_n"] = sv.norm_ctes("claims", "cn")


def _normed(spark, sf):
    return units.with_norm(views.claims(spark, sf))


def _norm_query(name, attribute):
    fields = ("normalized_value", "unit", "numeric_value", "is_ambiguous", "message")

    @query(name, f"SELECT claim_ord, product_id, value, z AS normalized_value, u AS unit, n AS numeric_value, amb AS is_ambiguous, msg AS message FROM claims_n WHERE attribute = {sv.lit(attribute)}")
    def _(spark, sf):
        d = units.with_norm(views.claims(spark, sf).filter(c("attribute") == attribute))
        return d.select("claim_ord", "product_id", "value", *[f"norm.{f}" for f in fields])


for _name, _attribute in (("nrm_voltage", "voltage"), ("nrm_current", "current"), ("nrm_frequency", "frequency"), ("nrm_dimensions", "dimensions"),
                          ("nrm_poles", "poles"), ("nrm_power", "power"), ("nrm_generic", "material")):
    _norm_query(_name, _attribute)


@query("nrm_dispatch", "SELECT attribute, z AS normalized_value, u AS unit, count(*) AS n_claims FROM claims_n GROUP BY ALL")
def _(spark, sf):
    return _normed(spark, sf).groupBy("attribute", c("norm.normalized_value").alias("normalized_value"), c("norm.unit").alias("unit")).agg(F.count("*").alias("n_claims"))


@query("nrm_ambiguous", "SELECT attribute, msg AS message, amb AS is_ambiguous, count(*) AS n_claims FROM claims_n GROUP BY ALL")
def _(spark, sf):
    return _normed(spark, sf).groupBy("attribute", c("norm.message").alias("message"), c("norm.is_ambiguous").alias("is_ambiguous")).agg(F.count("*").alias("n_claims"))


sv.VIEWS["odd"] = """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'trip_class' ELSE 'mounting' END AS attribute,
    CASE WHEN l_suppkey % 2 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN concat('Trip Class ', CAST(l_quantity AS INT), 'a') WHEN 1 THEN concat(CAST(l_quantity AS INT)) ELSE l_returnflag END
      ELSE CASE l_partkey % 5 WHEN 0 THEN 'DIN rail 35 mm' WHEN 1 THEN 'din  RAIL' WHEN 2 THEN 'panel mount' WHEN 3 THEN 'screws' ELSE concat('flush ', l_linestatus) END END AS value FROM lineitem"""


def _odd(spark, sf, attribute):
    q = "CAST(CAST(l_quantity AS INT) AS STRING)"
    trip = f"CASE l_partkey % 3 WHEN 0 THEN concat('Trip Class ', {q}, 'a') WHEN 1 THEN {q} ELSE l_returnflag END"
    mount = "CASE l_partkey % 5 WHEN 0 THEN 'DIN rail 35 mm' WHEN 1 THEN 'din  RAIL' WHEN 2 THEN 'panel mount' WHEN 3 THEN 'screws' ELSE concat('flush ', l_linestatus) END"
    d = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(c("l_suppkey") % 2 == 0, "trip_class").otherwise("mounting").alias("attribute"),
        F.expr(f"CASE WHEN l_suppkey % 2 = 0 THEN {trip} ELSE {mount} END").alias("value")).filter(c("attribute") == attribute)
    return units.with_norm(d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "value", "norm.normalized_value")


for _name, _attribute in (("nrm_trip_class", "trip_class"), ("nrm_mounting", "mounting")):
    query(_name, f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, value, z AS normalized_value FROM ({sv.norm_ctes('odd', 'oz')}) WHERE attribute = {sv.lit(_attribute)}")(
        lambda spark, sf, a=_attribute: _odd(spark, sf, a))

_decimals = "concat('size ', CAST(l_extendedprice AS VARCHAR), ' x ', CAST(l_quantity * 0.03125 AS VARCHAR), ' in')"


@query("nrm_fraction", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {sv.fractions('t')} AS fraction FROM (SELECT *, {_decimals} AS t FROM lineitem)")
def _(spark, sf):
    t = F.concat(F.lit("size "), c("l_extendedprice").cast("string"), F.lit(" x "), (c("l_quantity") * 0.03125).cast("string"), F.lit(" in"))
    return views.table(spark, sf, "lineitem").withColumn("t", t).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", units.fractions(c("t")).alias("fraction"))


_spelled = "concat(CAST(l_quantity AS VARCHAR), CASE l_suppkey % 7 WHEN 0 THEN 'lbs' WHEN 1 THEN ' INCHES' WHEN 2 THEN 'vdc' WHEN 3 THEN '\"' WHEN 4 THEN ' furlong' WHEN 5 THEN '' ELSE ' x 3 mm' END)"


@query("nrm_uom", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {sv.spaced_unit('t')} AS spaced FROM (SELECT *, {_spelled} AS t FROM lineitem)")
def _(spark, sf):
    d = views.table(spark, sf, "lineitem").withColumn("t", F.expr(_spelled.replace("AS VARCHAR", "AS STRING")))
    return d.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", units.spaced_unit(c("t")).alias("spaced"))


@query("nrm_refine", f"""SELECT product_id, name, value, {sv.spaced_unit('f')} AS normalized_value, unit, CASE WHEN is_ambiguous THEN 'REQUIRES_REVIEW' ELSE status END AS status FROM (
    SELECT *, {sv.fractions('t')} AS f FROM (SELECT *, coalesce(normalized_value, value) AS t FROM attributes))""")
def _(spark, sf):
    d = units.with_refined(views.attributes(spark, sf).drop("normalized_value", "unit"), "name", "value")
    return d.select("product_id", "name", "value", "norm.normalized_value", "norm.unit",
                    F.when(c("norm.requires_review"), "REQUIRES_REVIEW").otherwise(c("status")).alias("status"))


# ---------------------------------------------------------------- retrieval


def _line_score(phrase: str) -> str:
    q = embedding.query_vector(phrase, DIM)
    cases = " ".join(f"WHEN {b} THEN {w!r}::DOUBLE" for b, w in q.items())
    return (f"SELECT l.*, coalesce(s.raw, 0.0) AS raw FROM line_ids l LEFT JOIN (SELECT evidence_id, least(1.0, sum(weight * CASE bucket {cases} ELSE 0.0 END)) AS raw FROM line_vec GROUP BY 1) s USING (evidence_id)")


@query("ret_embed_hash", "SELECT evidence_id, bucket, round(weight, 6) AS weight FROM line_vec")
def _(spark, sf):
    d = docs.line_chunks(views.documents(spark, sf))
    d = d.withColumn("evidence_id", retrieve.evidence_id(c("document_id"), c("page_number"), c("chunk_index")))
    return embedding.sparse_vectors(d, "evidence_id", "text", DIM).select("evidence_id", "bucket", F.round("weight", 6).alias("weight"))


# every seventh document comes again with other text, and toxic documents go
sv.VIEWS["revised_lines"] = "SELECT * EXCLUDE (text), CASE WHEN document_id % 7 = 0 THEN 'Revised ' || text ELSE text END AS text FROM line_ids WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
vector_views("revised", "revised_lines", "evidence_id", "text")


def _toxic(spark, sf):
    return views.table(spark, sf, "labels").filter("toxic = 1").select(c("doc_id").alias("document_id"))


@query("ret_index", """SELECT evidence_id, document_id, product_id, CAST(length(text) AS INT) AS char_count, CAST(coalesce(n, 0) AS INT) AS n_buckets, round(coalesce(total, 0), 6) AS total
    FROM revised_lines LEFT JOIN (SELECT evidence_id, count(*) AS n, sum(weight) AS total FROM revised_vec GROUP BY 1) USING (evidence_id)""")
def _(spark, sf):
    index = _kept_index(spark, sf)
    again = docs.line_chunks(views.documents(spark, sf).filter("document_id % 7 = 0")).withColumn("text", F.concat(F.lit("Revised "), "text"))
    index.add(again)
    index.delete(_toxic(spark, sf))
    index.compact()
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6)
    return index.read().select("evidence_id", "document_id", "product_id", "char_count", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_buckets"), total.alias("total"))


# a fixed search vector; the table of vectors is what grows
QUERY_VEC = embedding.unit([((i * 37) % 19) - 9.0 for i in range(64)])
_dot = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {w!r}::DOUBLE" for i, w in QUERY_VEC.items())


@query("ret_topk", f"SELECT vec_id, label, round(raw, 4) AS score, row_number() OVER (ORDER BY round(raw, 8) DESC, vec_id) AS rank FROM (SELECT vec_id, label, least(1.0, greatest(0.0, {_dot})) AS raw FROM embeddings) QUALIFY rank <= 20")
def _(spark, sf):
    return retrieve.search(views.table(spark, sf, "embeddings"), QUERY_VEC, 20, tie="vec_id").select("vec_id", "label", "score", "rank")


# A request of every part: by product, by document and name, by product and source; a few by name or source alone, and some that nothing meets.
FILTER_ASKS = {
    "product_id": "CASE WHEN p_partkey % 4 = 0 AND p_partkey % 400 <> 0 OR p_partkey % 4 = 3 AND p_partkey % 400 <> 3 THEN CAST(p_partkey AS {s}) END",
    "document_id": "CASE WHEN p_partkey % 4 = 1 THEN CAST(p_partkey AS {s}) END",
    "document_name": "CASE WHEN p_partkey % 8 = 1 OR p_partkey % 400 = 0 THEN concat('src', CAST(p_partkey % 20 AS {s}), ' manual.pdf') WHEN p_partkey % 4 = 2 THEN concat('src', CAST(p_partkey AS {s}), ' manual.pdf') END",
    "source": "CASE WHEN p_partkey % 4 = 3 THEN concat('src', CAST(p_partkey % 20 AS {s})) END",
    "no_such_field": "CASE WHEN p_partkey % 8 = 0 THEN 'x' END",
}
sv.VIEWS["part_asks"] = "SELECT p_partkey AS ask_id, p_name AS ask, " + ", ".join(f"{x.format(s='VARCHAR')} AS {k}" for k, x in FILTER_ASKS.items()) + " FROM part"
vector_views("part", "part_asks", "ask_id", "ask")
_met = " AND ".join(f"(a.{f} IS NULL OR a.{f} = CAST(l.{f} AS VARCHAR))" for f in ("document_id", "document_name", "source"))
sv.VIEWS["part_pairs"] = (f"SELECT a.ask_id, l.evidence_id FROM part_asks a JOIN line_ids l ON a.product_id = CAST(l.product_id AS VARCHAR) WHERE {_met}"
                          f" UNION ALL SELECT a.ask_id, l.evidence_id FROM part_asks a JOIN line_ids l ON a.document_id = CAST(l.document_id AS VARCHAR) WHERE a.product_id IS NULL AND {_met}"
                          f" UNION ALL SELECT a.ask_id, l.evidence_id FROM part_asks a JOIN line_ids l ON a.document_name = l.document_name WHERE a.product_id IS NULL AND a.document_id IS NULL AND {_met}"
                          f" UNION ALL SELECT a.ask_id, l.evidence_id FROM part_asks a JOIN line_ids l ON a.source = l.source WHERE a.product_id IS NULL AND a.document_id IS NULL AND a.document_name IS NULL")


def _part_requests(spark, sf):
    filters = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k), F.expr(x.format(s="STRING")).alias("v")) for k, x in FILTER_ASKS.items()]), lambda e: e["v"].isNotNull()))
    return views.table(spark, sf, "part").select(c("p_partkey").alias("request_id"), c("p_name").alias("query"), filters.alias("filters"))


@query("ret_filter", """SELECT ask_id AS request_id, evidence_id, round(raw, 4) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY round(raw, 8) DESC, evidence_id) AS rank FROM (
        SELECT p.ask_id, p.evidence_id, least(1.0, coalesce(list_dot_product(a.v, l.v), 0.0)) AS raw FROM part_pairs p LEFT JOIN part_dense a USING (ask_id) LEFT JOIN line_dense l USING (evidence_id))) WHERE rank <= 5""")
def _(spark, sf):
    hits = retrieve.search_requests(_kept_index(spark, sf).read(), _part_requests(spark, sf), 5, ("source",), dim=DIM)
    return hits.select("request_id", "evidence_id", "score", "rank")


@query("ret_get_ids", "SELECT evidence_id, document_id, chunk_index FROM line_ids WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    d = docs.line_chunks(views.documents(spark, sf))
    d = d.withColumn("evidence_id", retrieve.evidence_id(c("document_id"), c("page_number"), c("chunk_index")))
    good = views.table(spark, sf, "labels").filter("quality = 1").select(c("doc_id").alias("document_id"))
    wanted = d.join(good, "document_id", "left_semi").select("evidence_id")
    return retrieve.by_ids(d, wanted).select("evidence_id", "document_id", "chunk_index")


@query("ret_delete_doc", "SELECT document_id, count(*) AS n_chunks FROM lines WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def _(spark, sf):
    index = _kept_index(spark, sf)
    index.delete(_toxic(spark, sf))
    return index.read().groupBy("document_id").agg(F.count("*").alias("n_chunks"))


@query("ret_count_clear", """SELECT 'added' AS step, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM lines
    UNION ALL SELECT 'deleted', count(*), count(DISTINCT document_id) FROM lines WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'cleared', 0, 0 UNION ALL SELECT 'added again', count(*), count(DISTINCT document_id) FROM lines WHERE document_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, sf):
    index = _kept_index(spark, sf)
    told = lambda step: index.counts().select(F.lit(step).alias("step"), "n_chunks", "n_documents")
    out = told("added")
    index.delete(_toxic(spark, sf))
    out = out.unionAll(told("deleted"))
    index.clear()
    out = out.unionAll(told("cleared"))
    index.add(docs.line_chunks(views.documents(spark, sf).join(_toxic(spark, sf), "document_id", "left_semi")))
    return out.unionAll(told("added again"))


REQUESTS = [retrieve.Request(1, "rated voltage of the unit", {"source": "src3"}), retrieve.Request(2, "der die und", {"source": "no such source"}),
            retrieve.Request(3, "les des une", {"source": "src7"}), retrieve.Request(4, "email phone license", {})]


def _request_sql(r: retrieve.Request) -> str:
    cond = " AND ".join(f"{k} = {sv.lit(x)}" for k, x in r.filters.items()) or "true"
    body = f"SELECT *, coalesce({cond}, false) AS hit FROM ({_line_score(r.text)})"
    return f"""SELECT {r.request_id} AS request_id, evidence_id, round(raw, 4) AS score, rank, NOT hit AS is_fallback FROM (
        SELECT *, row_number() OVER (ORDER BY round(raw, 8) DESC, evidence_id) AS rank FROM (SELECT *, max(hit) OVER () AS any_hit FROM ({body})) WHERE hit = any_hit) WHERE rank <= 5"""


@query("ret_fallback", " UNION ALL ".join(_request_sql(r) for r in REQUESTS))
def _(spark, sf):
    return retrieve.search_with_fallback(_kept_index(spark, sf).read(), REQUESTS, 5, DIM).select("request_id", "evidence_id", "score", "rank", "is_fallback")


_asks = [(q, a, [embedding.query_vector(p, DIM).get(b, 0.0) for b in range(DIM)]) for q, a, p in retrieve.spec_requests()]
_spec_value = "CASE attribute " + " ".join(f"WHEN {sv.lit(a)} THEN {_evidence_value_sql('text', a)}" for a in vocab.SPEC_QUERIES if a in vocab.EVIDENCE_PATTERNS) + " WHEN 'material' THEN CASE " + " ".join(
    f"WHEN {sv.has('text', p)} THEN {sv.lit(v)}" for p, v in vocab.MATERIALS) + " END END"


@query("ret_multi_query", f"""SELECT product_id, attribute, value, arg_min(evidence_id, (q, rank)) AS evidence_id, arg_min(score, (q, rank)) AS similarity FROM (
    SELECT *, {_spec_value} AS value FROM (
        SELECT product_id, evidence_id, text, q, attribute, round(raw, 4) AS score, row_number() OVER (PARTITION BY product_id, q ORDER BY round(raw, 8) DESC, evidence_id) AS rank FROM (
            SELECT product_id, evidence_id, text, q, attribute, least(1.0, coalesce(list_dot_product(d.v, s.v), 0.0)) AS raw FROM line_ids LEFT JOIN line_dense d USING (evidence_id),
                (VALUES {", ".join(f"({q}, {sv.lit(a)}, {[*map(float, v)]}::DOUBLE[])" for q, a, v in _asks)}) s(q, attribute, v)) QUALIFY rank <= 4)) WHERE value <> '' GROUP BY 1, 2, 3""")
def _(spark, sf):
    return retrieve.spec_evidence(_kept_index(spark, sf).read(), dim=DIM).select("product_id", "attribute", "value", "evidence_id", "similarity")


# ---------------------------------------------------------------- claims and conflicts

sv.VIEWS["text_claims"] = """SELECT f.product_id, f.attribute, f.value, 'Product Description' AS source_name, 'INPUT_DESCRIPTION' AS source_type, NULL::VARCHAR AS evidence_id,
    d.description AS snippet, 0.85::DOUBLE AS similarity FROM facts f JOIN clean_feed d USING (product_id)"""


@query("clm_union", """SELECT product_id, attribute, value, source_name, source_type, evidence_id, similarity FROM text_claims
    UNION ALL SELECT product_id, attribute, value, source_name, source_type, evidence_id, similarity FROM claims""")
def _(spark, sf):
    both = cl.union_claims(cl.claims_from_facts(_plain_facts(spark, sf), fd.clean_feed(views.feed(spark, sf))), views.claims(spark, sf))
    return both.select("product_id", "attribute", "value", "source_name", "source_type", "evidence_id", "similarity")


@query("clm_best", "SELECT product_id, attribute, value, source_name, similarity, n_claims, attr_ord FROM best")
def _(spark, sf):
    return cl.best_claims(views.claims(spark, sf))


@query("clm_from_evidence", "SELECT e.product_id, e.attribute, a.value, e.source_name, e.evidence_id FROM evidence e JOIN attributes a ON e.product_id = a.product_id AND e.attribute = a.name WHERE a.n_claims > 1")
def _(spark, sf):
    return cl.claims_from_evidence(views.attributes(spark, sf), views.evidence(spark, sf))


@query("cnf_detect", "SELECT product_id, attribute, n_values, n_claims, first_value, status, conflict_id FROM found_conflicts")
def _(spark, sf):
    return cl.conflicts(views.claims(spark, sf), known=views.norms(spark, sf)).drop("severity")


@query("cnf_severity", "SELECT conflict_id, attribute, severity FROM found_conflicts")
def _(spark, sf):
    return cl.conflicts(views.claims(spark, sf), known=views.norms(spark, sf)).select("conflict_id", "attribute", "severity")


@query("cnf_all", f"""SELECT c.product_id, c.attribute, c.conflict_id, v.values, s.sources, e.evidence_ids FROM found_conflicts c
    JOIN (SELECT product_id, attribute, string_agg(first_raw, ' | ' ORDER BY first_ord) AS values FROM cvalues GROUP BY 1, 2) v USING (product_id, attribute)
    JOIN (SELECT product_id, attribute, string_agg(source_name, ' | ' ORDER BY o) AS sources FROM (SELECT product_id, attribute, source_name, min(claim_ord) AS o FROM claims_z
      WHERE {sv.strip('value')} <> '' AND upper(value) <> 'UNKNOWN' GROUP BY 1, 2, 3) GROUP BY 1, 2) s USING (product_id, attribute)
    JOIN (SELECT product_id, attribute, string_agg(evidence_id, ' | ' ORDER BY o) AS evidence_ids FROM (SELECT product_id, attribute, evidence_id, min(claim_ord) AS o FROM claims_z
      WHERE {sv.strip('value')} <> '' AND upper(value) <> 'UNKNOWN' GROUP BY 1, 2, 3) GROUP BY 1, 2) e USING (product_id, attribute)""")
def _(spark, sf):
    said = cl.with_canonical(cl.stated(views.claims(spark, sf)), known=views.norms(spark, sf))
    full = cl.conflict_lists(cl.conflict_headers(cl.claim_values(said)), said)
    return full.select("product_id", "attribute", "conflict_id", *[F.array_join(x, " | ").alias(x) for x in ("values", "sources", "evidence_ids")])


@query("cnf_list", "SELECT product_id, attribute, severity, n_values FROM conflicts WHERE status = 'OPEN'")
def _(spark, sf):
    return cl.listed(views.conflicts(spark, sf), status="open").select("product_id", "attribute", "severity", "n_values")


sv.VIEWS["said"] = """SELECT product_id, attribute, canonical, source_name, count(*) AS n, min(claim_ord) AS o, arg_min(coalesce(value, 'None'), claim_ord) AS raw,
    source_name || CASE WHEN count(*) > 1 THEN ' x' || count(*) ELSE '' END AS shown
    FROM (SELECT product_id, attribute, coalesce(canonical, '') AS canonical, coalesce(source_name, 'Unknown Source') AS source_name, value, claim_ord FROM claims_z) GROUP BY 1, 2, 3, 4"""
sv.VIEWS["xsr"] = """SELECT product_id, attribute, n_values > 1 AS is_conflict, CASE WHEN n_values > 1 THEN 'CONFLICT' ELSE 'PASSED' END AS status,
    CASE WHEN n_values > 1 THEN 'HIGH' ELSE 'LOW' END AS severity, n_claims, n_values,
    CASE WHEN n_claims = 1 THEN 'Single source ''' || who || ''' supports ''' || attribute || ''' with value ''' || raw || '''.'
      WHEN n_values > 1 THEN 'Conflicting values detected for ''' || attribute || ''' across sources: ' || parts || '.'
      ELSE 'Value ''' || matched || ''' consistently verified across ' || n_sources || ' sources (' || who || ').' END AS message, CASE WHEN n_values > 1 THEN listed ELSE '' END AS conflicting_values FROM (
    SELECT product_id, attribute, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_claims, arg_min(canonical, o) AS matched, arg_min(who, o) AS who, arg_min(raw, o) AS raw, arg_min(n_sources, o) AS n_sources,
      string_agg('''' || canonical || ''' (' || who || ')', ' vs ' ORDER BY o, canonical) AS parts, string_agg(canonical, '|' ORDER BY o, canonical) AS listed FROM (
      SELECT product_id, attribute, canonical, sum(n) AS n, min(o) AS o, arg_min(raw, o) AS raw, count(*) AS n_sources, string_agg(shown, ', ' ORDER BY o, source_name) AS who FROM said GROUP BY 1, 2, 3)
    GROUP BY 1, 2)"""
sv.VIEWS["xsr_sources"] = """SELECT product_id, attribute, string_agg(source_name || '=' || raw || '=' || canonical || '=' || n, '|' ORDER BY o, source_name) AS sources FROM said GROUP BY 1, 2"""
sv.VIEWS["xsr_evidence"] = """SELECT product_id, attribute, string_agg(evidence_id, '|' ORDER BY o, evidence_id) AS evidence_ids FROM (
    SELECT product_id, attribute, evidence_id, min(claim_ord) AS o FROM claims WHERE evidence_id <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("xsr_compare", """SELECT product_id, attribute, is_conflict, severity, n_claims, n_values, message, conflicting_values, sources, coalesce(evidence_ids, '') AS evidence_ids
    FROM xsr JOIN xsr_sources USING (product_id, attribute) LEFT JOIN xsr_evidence USING (product_id, attribute)""")
def _(spark, sf):
    claims = views.claims(spark, sf)
    out = cl.with_evidence_ids(cl.compare_sources(claims, known=views.norms(spark, sf)), claims).drop("status")
    shown = F.transform("sources", lambda s: F.concat_ws("=", s["source_name"], F.coalesce(s["raw_value"], F.lit("None")), s["normalized_value"], s["n_claims"].cast("string")))
    return out.withColumns({"sources": F.array_join(shown, "|"), "conflicting_values": F.array_join("conflicting_values", "|"), "evidence_ids": F.array_join("evidence_ids", "|")})


@query("xsr_all", "SELECT product_id, attribute, 'CrossSourceConsistencyCheck' AS rule, NOT is_conflict AS passed, status, severity, message FROM xsr")
def _(spark, sf):
    return validate.cross_source_results(cl.compare_sources(views.claims(spark, sf), known=views.norms(spark, sf)))


# ---------------------------------------------------------------- validation


def _rule(name, rule, view):
    @query(name, f"SELECT product_id, attribute, rule, passed, status, severity, message FROM {view}")
    def _(spark, sf):
        return validate.row_rules(views.attributes(spark, sf)).filter(c("rule") == rule)


_rule("val_numeric", "NumericFormatCheck", "v_numeric")
_rule("val_unit", "UnitConsistencyCheck", "v_unit")
_rule("val_bounds", "ImpossibleValueCheck", "v_bounds")


@query("val_required", "SELECT product_id, attribute, rule, passed, status, severity, message FROM v_required")
def _(spark, sf):
    return validate.required_rule(views.products(spark, sf), views.attributes(spark, sf))


@query("val_duplicate", """SELECT product_id, attribute, 'DuplicateAttributeCheck' AS rule, false AS passed, 'CONFLICT' AS status, 'HIGH' AS severity,
    'Duplicate attribute ''' || attribute || ''' found with ' || count(DISTINCT value) || ' conflicting values' AS message FROM claims GROUP BY product_id, attribute HAVING count(DISTINCT value) > 1""")
def _(spark, sf):
    return validate.duplicate_rule(views.claims(spark, sf).select("product_id", c("attribute").alias("name"), "value"))


sv.VIEWS["spoken"] = "SELECT product_id, chunk_index, text AS evidence_text FROM lines"


@query("val_grounded", """SELECT product_id, 'material' AS attribute, 'SemanticGroundingCheck' AS rule, hit AS passed, CASE WHEN hit THEN 'PASSED' ELSE 'WARNING' END AS status,
    CASE WHEN hit THEN 'LOW' ELSE 'MEDIUM' END AS severity,
    CASE WHEN hit THEN '''material'' specification ''' || value || ''' is grounded in evidence.' ELSE 'No evidence support for ''material'' value ''' || value || '''.' END AS message
    FROM (SELECT a.product_id, a.value, max(contains(lower(s.evidence_text), lower(a.value))) AS hit FROM attributes a JOIN spoken s ON a.product_id = s.product_id
      WHERE a.name = 'material' AND a.value <> '' AND upper(a.value) <> 'UNKNOWN' GROUP BY 1, 2)""")
def _(spark, sf):
    spoken = docs.line_chunks(views.documents(spark, sf)).select("product_id", c("text").alias("evidence_text"))
    return validate.grounded_rule(views.attributes(spark, sf), spoken)


def _maker_rule(name, value, normalized, unit):
    """A caller's own rule: no value may be longer than 12 characters; broken input gives no verdict."""
    return F.when(F.length(value).isNotNull(), validate.verdict("ShortValueCheck", F.length(value) <= 12, "MEDIUM", F.concat(F.lit("length "), F.length(value).cast("string"))))


def _plain_number_rule(name, value, normalized, unit):
    """Breaks on values that are no plain number."""
    small = F.when(value.rlike(r"^[0-9]{1,9}(\.[0-9]{1,6})?$"), F.try_to_number(value, F.lit("999999999.999999")) < 100)
    return F.when(value.isNotNull(), validate.verdict("SmallNumberCheck", small, "MEDIUM", F.concat(F.lit("Number "), value)))


@query("val_rule_error", r"""SELECT product_id, name AS attribute, 'SmallNumberCheck' AS rule, coalesce(small, false) AS passed, CASE WHEN small THEN 'PASSED' ELSE 'FAILED' END AS status,
    CASE WHEN small THEN 'LOW' WHEN small IS NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE WHEN small IS NULL THEN 'Rule SmallNumberCheck could not be evaluated.' ELSE 'Number ' || value END AS message
    FROM (SELECT product_id, name, value, CASE WHEN regexp_matches(value, '^[0-9]{1,9}(\.[0-9]{1,6})?$') THEN CAST(value AS DOUBLE) < 100 END AS small FROM attributes) WHERE value IS NOT NULL""")
def _(spark, sf):
    return validate.row_rules(views.attributes(spark, sf), _maker_rule, _plain_number_rule).filter(c("rule") == "SmallNumberCheck")


sv.VIEWS["v_all"] = """SELECT product_id, attribute, rule, passed, status, severity, message FROM v_rows UNION ALL SELECT product_id, attribute, rule, passed, status, severity, message FROM v_required
    UNION ALL SELECT product_id, attribute, 'CrossSourceConsistencyCheck', NOT is_conflict, status, severity, message FROM xsr"""
sv.VIEWS["v_report"] = """SELECT product_id, total_rules_checked, passed_count, failed_count, conflict_count,
    CASE WHEN conflict_count > 0 OR severe > 0 THEN 'REQUIRES_REVIEW' WHEN failed_count > 0 THEN 'FAILED' ELSE 'VERIFIED' END AS status FROM (
    SELECT product_id, count(*) AS total_rules_checked, count(*) FILTER (passed) AS passed_count, count(*) FILTER (NOT passed AND status <> 'CONFLICT') AS failed_count,
      count(*) FILTER (NOT passed AND rule = 'CrossSourceConsistencyCheck') AS conflict_count, count(*) FILTER (NOT passed AND severity IN ('HIGH', 'CRITICAL')) AS severe FROM v_all GROUP BY 1)"""


def _results(spark, sf, a=None):
    a = once(views.attributes(spark, sf)) if a is None else a
    return validate.all_results(validate.row_rules(a), validate.required_rule(views.products(spark, sf), a),
                                validate.cross_source_results(cl.compare_sources(views.claims(spark, sf), known=views.norms(spark, sf))))


@query("val_report", "SELECT *, status = 'VERIFIED' AS passed FROM v_report")
def _(spark, sf):
    return validate.report(_results(spark, sf))


@query("val_attach", """SELECT r.product_id, r.attribute, r.rule, r.passed, CASE WHEN a.name IS NOT NULL THEN r.attribute ELSE f.first_name END AS linked_attribute,
    CASE WHEN t.status = 'REQUIRES_REVIEW' THEN 'REQUIRES_REVIEW' ELSE p.status END AS product_status FROM v_all r
    LEFT JOIN attributes a ON r.product_id = a.product_id AND r.attribute = a.name LEFT JOIN (SELECT product_id, arg_min(name, attr_ord) AS first_name FROM attributes GROUP BY 1) f ON r.product_id = f.product_id
    JOIN products p ON r.product_id = p.product_id LEFT JOIN v_report t ON r.product_id = t.product_id""")
def _(spark, sf):
    a = once(views.attributes(spark, sf))
    results = once(_results(spark, sf, a))
    linked, moved = validate.attach(results, a, views.products(spark, sf), validate.report(results))
    return linked.join(moved.select("product_id", c("status").alias("product_status")), "product_id").select(
        "product_id", "attribute", "rule", "passed", "linked_attribute", "product_status")


# ---------------------------------------------------------------- scoring


@query("scr_source_rel", "SELECT product_id, attribute, rel AS source_reliability, agreeing AS agreeing_sources FROM signals")
def _(spark, sf):
    return score.evidence_signals(views.evidence(spark, sf)).select("product_id", "attribute", "source_reliability", "agreeing_sources")


def _scores(spark, sf):
    return twin_parts(spark, sf)[3]


def _part(name, field, view="scores"):
    @query(name, f"SELECT product_id, attribute, {field} FROM {view}")
    def _(spark, sf):
        return _scores(spark, sf).select("product_id", "attribute", field)


_part("scr_evidence", "evidence_strength")
_part("scr_agreement", "agreement_score")
_part("scr_extraction", "extraction_quality")
_part("scr_validation", "validation_factor")


@query("scr_attribute", f"""SELECT product_id, attribute, confidence_score, confidence_band, is_blocked,
    printf('Score: %.1f%% (%s) | Source Rel: %.2f, Evidence Str: %.2f, Agreement: %.2f, Extraction: %.2f, Validation: %.2f, Conflict: %.2f%s', confidence_score, confidence_band, source_reliability,
      evidence_strength, agreement_score, extraction_quality, validation_factor, conflict_factor,
      CASE WHEN is_blocked THEN ' [BLOCKED: Open conflict or critical validation failure prevents auto-approval]' ELSE '' END) AS explanation FROM scores""")
def _(spark, sf):
    return _scores(spark, sf).select("product_id", "attribute", "confidence_score", "confidence_band", "is_blocked", "explanation")


sv.VIEWS["product_scores"] = f"""SELECT *, CASE WHEN overall_confidence_score >= 90 AND NOT has_blocking_conflicts THEN 'HIGH' WHEN overall_confidence_score >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS overall_confidence_band FROM (
    SELECT product_id, {sv.score('avg(confidence_score)', 1)} AS overall_confidence_score, count(*) FILTER (confidence_band = 'HIGH') AS high_confidence_attributes,
    count(*) FILTER (confidence_band = 'MEDIUM') AS medium_confidence_attributes, count(*) FILTER (confidence_band = 'LOW') AS low_confidence_attributes, bool_or(is_blocked) AS has_blocking_conflicts FROM scores GROUP BY 1)"""


@query("scr_product", "SELECT * FROM product_scores")
def _(spark, sf):
    return score.product_confidence(_scores(spark, sf))


sv.VIEWS["attr_states"] = "SELECT product_id, attribute, CASE WHEN has_conflict THEN 'CONFLICT' WHEN confidence_band <> 'HIGH' THEN 'REQUIRES_REVIEW' ELSE 'VERIFIED' END AS status FROM scores"


def _states(spark, sf):
    return _scores(spark, sf).select("product_id", "attribute", score.attribute_status(c("has_conflict"), c("confidence_band")).alias("status"))


@query("scr_attr_status", "SELECT * FROM attr_states")
def _(spark, sf):
    return _states(spark, sf)


@query("scr_review_count", "SELECT product_id, count(*) FILTER (status IN ('CONFLICT', 'REQUIRES_REVIEW')) AS review_count FROM attr_states GROUP BY 1")
def _(spark, sf):
    return _states(spark, sf).groupBy("product_id").agg(F.count_if(score.needs_review(c("status"))).alias("review_count"))


sv.VIEWS["quality"] = f"""SELECT product_id, {sv.score('least(100.0, greatest(0.0, CASE WHEN n_attr = 0 AND ms NOT IN (' + "'RESOLVED', 'LOW_CONFIDENCE'" + ') AND bs NOT IN (' + "'RESOLVED', 'LOW_CONFIDENCE'" + ') THEN least(q, 15.0) ELSE q END))', 1)} AS quality FROM (
    SELECT *, (CASE ms WHEN 'RESOLVED' THEN 25.0 WHEN 'LOW_CONFIDENCE' THEN 12.0 ELSE 0.0 END + CASE bs WHEN 'RESOLVED' THEN 25.0 WHEN 'LOW_CONFIDENCE' THEN 12.0 ELSE 0.0 END
      + CASE ts WHEN 'RESOLVED' THEN 15.0 WHEN 'HEURISTIC' THEN 10.0 WHEN 'LOW_CONFIDENCE' THEN 5.0 ELSE 0.0 END + least(25.0, n_attr * 3.0) + least(10.0, n_ev * 1.5))::DOUBLE * CASE WHEN clash THEN 0.7 ELSE 1.0 END::DOUBLE AS q FROM (
      SELECT b.product_id, m.status AS ms, b.status AS bs, t.status AS ts, coalesce(a.n, 0) AS n_attr, coalesce(a.e, 0) AS n_ev, o.product_id IS NOT NULL AS clash FROM brand_res b
      JOIN mfr_res m USING (product_id) JOIN tax t USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS n, sum(n_claims)::BIGINT AS e FROM attributes GROUP BY 1) a USING (product_id)
      LEFT JOIN (SELECT DISTINCT product_id FROM conflicts WHERE status = 'OPEN') o USING (product_id)))"""


def _quality(spark, sf):
    a = views.attributes(spark, sf).groupBy("product_id").agg(F.count("*").alias("n_attr"), F.sum("n_claims").alias("n_ev"))
    clash = views.conflicts(spark, sf).filter("status = 'OPEN'").select("product_id").distinct().withColumn("clash", F.lit(True))
    d = _both_names(spark, views.feed(spark, sf)).select("product_id", c("b.status").alias("bs"), c("m.status").alias("ms"))
    t = _taxed(spark, sf).select("product_id", c("tax.status").alias("ts"))
    d = d.join(t, "product_id").join(a, "product_id", "left").join(clash, "product_id", "left").fillna(0, ["n_attr", "n_ev"]).fillna(False, ["clash"])
    return d.select("product_id", score.quality_score(c("ms"), c("bs"), c("ts"), c("n_attr"), c("n_ev"), c("clash")).alias("quality"))


@query("scr_quality", "SELECT product_id, quality FROM quality")
def _(spark, sf):
    return _quality(spark, sf)


@query("scr_product_status", """SELECT p.product_id, CASE WHEN coalesce(r.n, 0) > 0 OR coalesce(p.overall_quality_score, 0) < 50 THEN 'REQUIRES_REVIEW' ELSE 'REVIEWED' END AS status FROM products p
    LEFT JOIN (SELECT product_id, count(*) FILTER (status IN ('CONFLICT', 'REQUIRES_REVIEW')) AS n FROM attr_states GROUP BY 1) r USING (product_id)""")
def _(spark, sf):
    counts = _states(spark, sf).groupBy("product_id").agg(F.count_if(score.needs_review(c("status"))).alias("n"))
    d = views.products(spark, sf).join(counts, "product_id", "left")
    return d.select("product_id", score.product_status(F.coalesce("n", F.lit(0)), F.coalesce("overall_quality_score", F.lit(0.0))).alias("status"))


sv.VIEWS["ratio"] = f"SELECT product_id, {sv.score('avg(CASE WHEN status = ' + chr(39) + 'VERIFIED' + chr(39) + ' AND value IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100.0', 1)} AS quality_score FROM attributes GROUP BY 1"


@query("scr_verified_ratio", "SELECT * FROM ratio")
def _(spark, sf):
    return score.verified_ratio(views.attributes(spark, sf))


# ---------------------------------------------------------------- review

sv.VIEWS["fold"] = """SELECT product_id, attribute, arg_max(action, (ts, decision_id)) FILTER (action IN ('SELECT_ALTERNATIVE', 'MARK_UNKNOWN')) AS set_action,
    arg_max(coalesce(selected_value, ''), (ts, decision_id)) FILTER (action IN ('SELECT_ALTERNATIVE', 'MARK_UNKNOWN')) AS set_value,
    arg_max(action, (ts, decision_id)) FILTER (action <> 'DISMISS_CONFLICT') AS last_move, arg_min(action, (ts, decision_id)) AS first_action FROM usable_decisions GROUP BY 1, 2"""
sv.VIEWS["fold_n"] = sv.norm_ctes("fold", "fz", value="set_value")
sv.VIEWS["reviewed"] = """SELECT a.product_id, a.name, CASE WHEN f.set_action = 'SELECT_ALTERNATIVE' THEN f.set_value WHEN f.set_action = 'MARK_UNKNOWN' THEN NULL ELSE a.value END AS value,
    CASE WHEN f.set_action = 'SELECT_ALTERNATIVE' THEN f.z WHEN f.set_action = 'MARK_UNKNOWN' THEN NULL ELSE a.normalized_value END AS normalized_value,
    CASE WHEN f.set_action = 'SELECT_ALTERNATIVE' THEN f.u ELSE a.unit END AS unit,
    CASE WHEN f.last_move = 'MARK_UNKNOWN' THEN 0.0 WHEN f.last_move IS NOT NULL THEN 1.0 ELSE a.confidence END AS confidence,
    CASE WHEN f.last_move = 'MARK_UNKNOWN' THEN 'UNKNOWN' WHEN f.last_move IS NOT NULL THEN 'VERIFIED' ELSE a.status END AS status
    FROM attributes a LEFT JOIN fold_n f ON a.product_id = f.product_id AND a.name = f.attribute"""
sv.VIEWS["closed"] = """SELECT c.product_id, c.attribute, c.severity, CASE WHEN c.status = 'OPEN' AND f.first_action = 'DISMISS_CONFLICT' THEN 'DISMISSED' WHEN c.status = 'OPEN' AND f.first_action IS NOT NULL THEN 'RESOLVED' ELSE c.status END AS status
    FROM conflicts c LEFT JOIN fold f ON c.product_id = f.product_id AND c.attribute = f.attribute"""


@query("rev_apply", "SELECT product_id, name, value, normalized_value, unit, confidence, status FROM reviewed")
def _(spark, sf):
    return review.apply_decisions(views.attributes(spark, sf), views.decisions(spark, sf)).select(
        "product_id", "name", "value", "normalized_value", "unit", "confidence", "status")


sv.VIEWS["history"] = """SELECT d.*, CASE WHEN pv = '~void~' THEN NULL WHEN pv IS NOT NULL THEN pv ELSE a.value END AS previous_value FROM (
    SELECT *, last_value(CASE action WHEN 'SELECT_ALTERNATIVE' THEN selected_value WHEN 'MARK_UNKNOWN' THEN '~void~' END IGNORE NULLS) OVER (
      PARTITION BY product_id, attribute ORDER BY ts, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM usable_decisions) d
    LEFT JOIN attributes a ON d.product_id = a.product_id AND d.attribute = a.name"""
_after = "CASE action WHEN 'SELECT_ALTERNATIVE' THEN selected_value WHEN 'MARK_UNKNOWN' THEN NULL ELSE previous_value END"


@query("rev_prev_value", f"SELECT decision_id, product_id, attribute, action, previous_value, {_after} AS selected_value FROM history")
def _(spark, sf):
    return review.previous_values(views.decisions(spark, sf), views.attributes(spark, sf)).select(
        "decision_id", "product_id", "attribute", "action", "previous_value", "selected_value")


@query("rev_audit", f"SELECT product_id, attribute, action AS reviewer_action, previous_value, {_after} AS selected_value, reason, CAST(ts AS VARCHAR)[:19] AS ts, decision_id FROM history")
def _(spark, sf):
    d = review.audit_trail(views.decisions(spark, sf), views.attributes(spark, sf))
    return d.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _resolutions(found):
    """One decision per order line on the conflict of its part; every ninth part dismisses."""
    heads = found.select("conflict_id", "product_id", "attribute", "n_values")
    return heads.filter(c("n_values") < 5).select(
        "conflict_id", F.when(c("product_id") % 9 == 0, "DISMISS").otherwise("ACCEPT").alias("action"),
        F.when(c("product_id") % 2 == 0, F.concat(c("n_values").cast("string"), F.lit(" A"))).alias("selected_value"),
        F.lit("checked").alias("reason"), c("product_id").alias("ts"))


sv.VIEWS["resolutions"] = """SELECT conflict_id, CASE WHEN product_id % 9 = 0 THEN 'DISMISS' ELSE 'ACCEPT' END AS action, CASE WHEN product_id % 2 = 0 THEN n_values || ' A' END AS selected_value FROM found_conflicts WHERE n_values < 5"""
sv.VIEWS["resolved_conflicts"] = "SELECT c.*, r.action, r.selected_value, CASE WHEN r.action IS NULL THEN c.status WHEN r.action = 'DISMISS' THEN 'DISMISSED' ELSE 'RESOLVED' END AS new_status FROM found_conflicts c LEFT JOIN resolutions r USING (conflict_id)"


@query("rev_resolve", """SELECT a.product_id, a.name, coalesce(k.selected_value, a.value) AS value, CASE WHEN k.selected_value IS NOT NULL THEN 'VERIFIED' ELSE a.status END AS status,
    CASE WHEN s.n_open = 0 AND s.n_decided > 0 THEN 'REVIEWED' ELSE p.status END AS product_status FROM attributes a JOIN products p USING (product_id)
    LEFT JOIN (SELECT product_id, attribute AS name, selected_value FROM resolved_conflicts WHERE action <> 'DISMISS') k USING (product_id, name)
    LEFT JOIN (SELECT product_id, count(*) FILTER (new_status = 'OPEN') AS n_open, count(action) AS n_decided FROM resolved_conflicts GROUP BY 1) s USING (product_id)""")
def _(spark, sf):
    found = once(cl.conflicts(views.claims(spark, sf), known=views.norms(spark, sf)))
    _, a, p = review.resolve_conflicts(found, views.attributes(spark, sf), views.products(spark, sf), _resolutions(found))
    return a.select("product_id", "name", "value", "status").join(p.select("product_id", c("status").alias("product_status")), "product_id")


@query("rev_dismiss", "SELECT conflict_id, CASE WHEN n_values < 5 THEN 'DISMISSED' ELSE 'OPEN' END AS status, CASE WHEN n_values < 5 THEN 'checked' END AS dismiss_reason FROM found_conflicts")
def _(spark, sf):
    heads = once(cl.conflicts(views.claims(spark, sf), known=views.norms(spark, sf)))
    return review.dismiss_conflicts(heads, _resolutions(heads)).select("conflict_id", "status", "dismiss_reason")


@query("rev_close_open", "SELECT product_id, attribute, status FROM closed")
def _(spark, sf):
    return review.close_conflicts(views.conflicts(spark, sf), views.decisions(spark, sf)).select("product_id", "attribute", "status")


@query("rev_approve", """SELECT p.product_id, CASE WHEN b.n IS NULL THEN 'PUBLISHED' ELSE p.status END AS status, coalesce(b.n, 0) AS n_blocking FROM products p
    LEFT JOIN (SELECT product_id, count(*) AS n FROM conflicts WHERE status = 'OPEN' AND severity IN ('HIGH', 'CRITICAL') GROUP BY 1) b USING (product_id)""")
def _(spark, sf):
    ok, blocked = review.approve(views.products(spark, sf), views.conflicts(spark, sf))
    return ok.select("product_id", "status", F.lit(0).cast("bigint").alias("n_blocking")).unionByName(blocked.select("product_id", "status", "n_blocking"))


@query("rev_eligible", """SELECT product_id, name, confidence, confidence_band, has_open_conflict, status FROM twin
    WHERE confidence < 0.9 OR confidence_band <> 'HIGH' OR has_open_conflict OR status IN ('CONFLICT', 'REQUIRES_REVIEW')""")
def _(spark, sf):
    return review.eligible(scored(spark, sf)[1]).select("product_id", "name", "confidence", "confidence_band", "has_open_conflict", "status")


# ---------------------------------------------------------------- descriptions

_shown = f"""CASE WHEN {sv.valid(sv.strip('coalesce(normalized_value, value)'))} THEN CASE WHEN unit <> '' AND NOT ends_with({sv.strip('coalesce(normalized_value, value)')}, unit)
    THEN {sv.strip('coalesce(normalized_value, value)')} || ' ' || unit ELSE {sv.strip('coalesce(normalized_value, value)')} END END"""
sv.VIEWS["shown"] = f"SELECT *, lower(name) AS lname, {_shown} AS shown FROM attributes"
_prio = "list_position([" + ", ".join(sv.lit(k) for k in vocab.KEY_SPECS) + "], lname)"
_keys, _skip, _lskip = sv.in_list(vocab.KEY_SPECS), sv.in_list(vocab.SPEC_FALLBACK_SKIP), sv.in_list(vocab.LONG_TEXT_SKIP)
sv.VIEWS["specs"] = f"""SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY prio, spec) AS spec_rank, spec FROM (SELECT product_id, shown AS spec, min(prio) AS prio FROM (
    SELECT product_id, shown, CAST({_prio} AS BIGINT) AS prio FROM shown WHERE shown IS NOT NULL AND lname IN {_keys}
    UNION ALL SELECT product_id, shown, attr_ord FROM shown WHERE shown IS NOT NULL AND lname NOT IN {_keys} AND lname NOT IN {_skip}
      AND product_id NOT IN (SELECT product_id FROM shown WHERE shown IS NOT NULL AND lname IN {_keys})) GROUP BY 1, 2)"""


def _ok(x: str) -> str:
    return f"CASE WHEN {sv.valid(x)} THEN {x} END"


def _join(sep: str, *xs: str) -> str:
    return f"array_to_string(list_filter([{', '.join(_ok(x) for x in xs)}], lambda t: t IS NOT NULL), {sv.lit(sep)})"


sv.VIEWS["dcat"] = f"""SELECT p.product_id, coalesce({_ok('p.brand')}, '') AS b, coalesce({_ok('p.part_number')}, '') AS m, coalesce(description, '') AS raw,
    coalesce(nullif(CASE WHEN lower(taxonomy_fine) <> 'unclassified' AND {sv.valid('taxonomy_fine')} THEN taxonomy_fine END, ''),
      CASE WHEN lower(category) <> 'unclassified' AND {sv.valid('category')} THEN CASE WHEN contains(category, '>') THEN {sv.strip("string_split(category, '>')[-1]")} ELSE category END END, '') AS cat FROM products p"""
sv.VIEWS["dtext"] = f"""SELECT d.*, s1.spec AS spec1, s2.spec AS spec2, l.lines FROM dcat d LEFT JOIN specs s1 ON d.product_id = s1.product_id AND s1.spec_rank = 1
    LEFT JOIN specs s2 ON d.product_id = s2.product_id AND s2.spec_rank = 2
    LEFT JOIN (SELECT product_id, string_agg({sv.title("replace(name, '_', ' ')")} || ': ' || shown, ', ' ORDER BY attr_ord, name) AS lines FROM shown
      WHERE shown IS NOT NULL AND lname NOT IN {_lskip} GROUP BY 1) l ON d.product_id = l.product_id"""
_s1 = f"CASE WHEN spec1 IS NOT NULL AND NOT list_contains(list_transform(p0, lambda t: lower(t)), lower(spec1)) THEN list_append(p0, spec1) ELSE p0 END"
_s2 = f"CASE WHEN spec2 IS NOT NULL AND NOT list_contains(list_transform(p1, lambda t: lower(t)), lower(spec2)) THEN list_append(p1, spec2) ELSE p1 END"
_rawok = sv.valid("raw")
_intro = f"CASE WHEN {sv.valid('cat')} AND base <> '' THEN base || ' is a ' || cat || '.' WHEN {sv.valid('cat')} THEN cat || '.' WHEN base <> '' THEN base || '.' ELSE '' END"
_long = f"concat_ws(' ', nullif({_intro}, ''), CASE WHEN lines <> '' THEN 'Specifications: ' || lines || '.' END)"
_inv = f"upper({sv.strip(_join(' ', 'b', 'm', chr(40) + 'string_split(cat, ' + sv.lit(' ') + ')[1]' + chr(41)))})"
sv.VIEWS["described"] = f"""SELECT product_id, desc_short, desc_long, desc_invoice, left(CASE WHEN mob <> '' THEN mob ELSE desc_short END, 80) AS desc_mobile, desc_retail,
    left({sv.strip(sv.squeeze("CASE WHEN subj <> '' THEN 'The ' || subj || ' delivers reliable performance for ' || CASE WHEN cat <> '' THEN lower(cat) ELSE 'industrial and commercial' END || ' applications. ' ELSE '' END || desc_retail"))}, 800) AS desc_marketing FROM (
    SELECT *, left(CASE WHEN length(raw) > 10 AND {_rawok} THEN {sv.strip(sv.squeeze('raw'))} ELSE desc_long END, 500) AS desc_retail FROM (
      SELECT *, left(CASE WHEN len(p2) > 0 THEN {sv.strip("array_to_string(p2, ' - ')")} WHEN {_rawok} THEN left(raw, 120) ELSE '' END, 120) AS desc_short,
        left(CASE WHEN lng <> '' THEN lng WHEN {_rawok} THEN raw ELSE '' END, 1000) AS desc_long,
        left({sv.squeeze(f"CASE WHEN inv <> '' THEN inv WHEN {_rawok} THEN upper(left(raw, 60)) ELSE '' END")}, 60) AS desc_invoice FROM (
        SELECT *, {_s2} AS p2, {sv.strip(_long)} AS lng, {_inv} AS inv, {sv.strip(_join(' ', 'b', 'm', 'cat'))} AS mob, {sv.strip("b || ' ' || m")} AS subj FROM (
          SELECT *, {_s1} AS p1 FROM (SELECT *, list_filter([{_ok('b')}, {_ok('m')}, {_ok('cat')}], lambda t: t IS NOT NULL) AS p0, {_join(' ', 'b', 'm')} AS base FROM dtext)))))"""


def _described(spark, sf):
    return describe.describe(views.products(spark, sf), once(views.attributes(spark, sf)))


@query("dsc_category", "SELECT product_id, cat AS category_text FROM dcat")
def _(spark, sf):
    return describe.description_inputs(views.products(spark, sf), views.attributes(spark, sf)).select("product_id", c("d_cat").alias("category_text"))


@query("dsc_specs", "SELECT * FROM specs")
def _(spark, sf):
    return describe.key_specs(views.attributes(spark, sf))


def _desc(kind):
    @query(f"dsc_{kind}", f"SELECT product_id, desc_{kind} FROM described")
    def _(spark, sf):
        return _described(spark, sf).select("product_id", f"desc_{kind}")


for _kind_ in ("short", "long", "invoice", "mobile", "retail", "marketing"):
    _desc(_kind_)


def _limit_sql(name: str) -> str:
    return f"length(desc_{name}) <= {vocab.DESCRIPTION_LIMITS[name]} AND {sv.valid('desc_' + name)}"


_checks = ", ".join(f"{_limit_sql(n)} AS ok_{n}" for n in ("short", "long", "mobile", "retail", "marketing"))
sv.VIEWS["checked"] = f"""SELECT *, ok_short AND ok_long AND ok_invoice AND ok_mobile AND ok_retail AND ok_marketing AS all_passed FROM (SELECT product_id, {_checks},
    length(desc_invoice) <= 60 AND ((upper(desc_invoice) = desc_invoice AND upper(desc_invoice) <> lower(desc_invoice)) OR desc_invoice = '') AS ok_invoice FROM described)"""


@query("dsc_validate", "SELECT * FROM checked")
def _(spark, sf):
    return describe.check_descriptions(_described(spark, sf)).select("product_id", *[f"ok_{n}" for n in vocab.DESCRIPTION_LIMITS], "all_passed")


def _issue_sql(t: str, b: str, m: str) -> str:
    low, b, m = f"lower(coalesce({t}, ''))", f"lower(coalesce({b}, ''))", f"lower(coalesce({m}, ''))"
    rep = f"{b} <> '' AND {m} <> '' AND contains({low}, {b}) AND contains({low}, {m}) AND (length({low}) - length(replace({low}, {b}, ''))) / nullif(length({b}), 0) > 2"
    bad = ", ".join(f"CASE WHEN regexp_matches({low}, '\\b{w}\\b') THEN 'contains_{w}' END" for w in ("none", "unclassified", "unknown"))
    return f"array_to_string(list_filter([CASE WHEN {sv.strip(low)} = '' THEN 'empty' END, {bad}, CASE WHEN {rep} THEN 'duplicate_brand' END], lambda t: t IS NOT NULL), ',')"


_tripled = "concat(description, ' ', brand, ' ', brand, ' ', part_number, ' ', CASE WHEN product_id % 2 = 0 THEN brand ELSE '' END)"


@query("dsc_score", f"SELECT product_id, {_issue_sql('t', 'brand', 'part_number')} AS issues FROM (SELECT *, CASE WHEN product_id % 3 = 0 THEN description ELSE {_tripled} END AS t FROM products)")
def _(spark, sf):
    t = F.expr(f"CASE WHEN product_id % 3 = 0 THEN description ELSE {_tripled} END")
    return views.products(spark, sf).select("product_id", F.array_join(describe.description_issues(t, c("brand"), c("part_number")), ",").alias("issues"))


# ---------------------------------------------------------------- delivery


sv.VIEWS["triplets"] = f"""SELECT product_id, slot, {sv.export('name')} AS label, {sv.export("coalesce(nullif(normalized_value, ''), value)")} AS value, {sv.export('unit')} AS uom FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY name) AS slot FROM attributes WHERE lower(name) NOT IN ('dimensions', 'weight')) WHERE slot <= 50"""


@query("dlv_map", f"""SELECT {sv.export('CAST(p.product_id AS VARCHAR)')} AS sku, {sv.export('p.part_number')} AS part_number, {sv.export("coalesce(nullif(p.manufacturer, ''), p.brand)")} AS maker,
    {sv.export('p.taxonomy_dept')} AS dept, {sv.export('p.taxonomy_fine')} AS fine, {sv.export("coalesce(nullif(p.taxonomy_classpath, ''), p.category)")} AS classpath,
    CASE WHEN p.status = 'DISCONTINUED' THEN 'Yes' ELSE 'No' END AS discontinued, {sv.export('d.desc_short')} AS short_desc, {sv.export('d.desc_marketing')} AS marketing,
    coalesce(t.label, '') AS label1, coalesce(t.value, '') AS value1, coalesce(t.uom, '') AS uom1, '' AS upc FROM products p JOIN described d USING (product_id) LEFT JOIN triplets t ON p.product_id = t.product_id AND t.slot = 1""")
def _(spark, sf):
    pick = {"sku": "SKU - MY_PART_NUMBER", "part_number": "PART_NUMBER", "maker": "MANUFACTURER_NAME", "dept": "Dept", "fine": "Fine", "classpath": "Classpath", "discontinued": "Discontinued",
            "short_desc": "SHORT_DESC", "marketing": "MARKETING_DESCRIPTION", "label1": "ATTRIBUTE_LABEL 1", "value1": "ATTRIBUTE_VALUE 1", "uom1": "ATTRIBUTE_UOM 1", "upc": "UPC"}
    return _wide(spark, sf).select(*[c(f"`{v}`").alias(k) for k, v in pick.items()])


@query("dlv_dims", """SELECT product_id, coalesce(string_split(trim(ps[1]), ' ')[1], '') AS HEIGHT, coalesce(u, '') AS HEIGHT_UOM, coalesce(string_split(trim(ps[2]), ' ')[1], '') AS WIDTH,
    coalesce(u, '') AS WIDTH_UOM, coalesce(string_split(trim(ps[3]), ' ')[1], '') AS LENGTH, coalesce(u, '') AS LENGTH_UOM, '' AS WEIGHT, '' AS WEIGHT_UOM FROM (
    SELECT product_id, CASE WHEN contains(lower(normalized_value), 'x') THEN string_split(lower(normalized_value), 'x') END AS ps, CASE WHEN contains(lower(normalized_value), 'x') THEN coalesce(unit, '') END AS u
    FROM attributes WHERE name = 'dimensions')""")
def _(spark, sf):
    return delivery.measures(views.attributes(spark, sf))


@query("dlv_triplets", "SELECT * FROM triplets")
def _(spark, sf):
    return delivery.triplets(views.attributes(spark, sf))


@query("dlv_schema_check")
def _(spark, sf):
    wide = _wide(spark, sf)
    delivery.check_schema(wide.columns)
    return wide.select(F.lit(len(wide.columns)).alias("n_columns"), F.lit(len(set(wide.columns))).alias("n_unique"), "PART_NUMBER")


# ---------------------------------------------------------------- catalog


def _like(p: str) -> str:
    return " OR ".join(f"{x} ILIKE '%{p}%'" for x in catalog.SEARCHED)


@query("cat_search", f"SELECT product_id, part_number, brand, category, status, updated_at FROM products WHERE status = 'PUBLISHED' AND ({_like('rod')})")
def _(spark, sf):
    return catalog.search(views.products(spark, sf), " rod ", "PUBLISHED").select("product_id", "part_number", "brand", "category", "status", "updated_at")


sv.VIEWS["listing"] = """SELECT p.*, coalesce(a.n, 0) AS attributes_count, coalesce(f.n, 0) AS conflicts_count, coalesce(f.n, 0) > 0 AS has_open_conflict FROM products p
    LEFT JOIN (SELECT product_id, count(*) AS n FROM attributes GROUP BY 1) a USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS n FROM conflicts WHERE status = 'OPEN' GROUP BY 1) f USING (product_id)"""


def _listing(spark, sf):
    return catalog.listing(views.products(spark, sf), views.attributes(spark, sf), views.conflicts(spark, sf))


@query("cat_list", "SELECT product_id, status, attributes_count, conflicts_count, has_open_conflict FROM listing")
def _(spark, sf):
    return _listing(spark, sf).select("product_id", "status", "attributes_count", "conflicts_count", "has_open_conflict")


@query("cat_facets", f"""SELECT product_id, status, overall_quality_score, has_open_conflict FROM listing WHERE status IN ('PUBLISHED', 'REVIEWED') AND coalesce(overall_quality_score, 0) < 70
    AND has_open_conflict AND ({_like('brand#1')})""")
def _(spark, sf):
    return catalog.facets(_listing(spark, sf), "Brand#1", "READY", "LOW", "HAS_CONFLICTS").select("product_id", "status", "overall_quality_score", "has_open_conflict")


@query("cat_summary", f"""SELECT count(*) AS total_products, count(*) FILTER (status IN ('VERIFIED', 'PUBLISHED', 'REVIEWED')) AS verified_count, count(*) FILTER (status = 'REQUIRES_REVIEW') AS needs_review_count,
    (SELECT count(*) FROM conflicts WHERE status = 'OPEN') AS conflicts_count, {sv.score('avg(coalesce(overall_quality_score, 0.0))', 1)} AS average_quality_score FROM products""")
def _(spark, sf):
    return catalog.summary(views.products(spark, sf), views.conflicts(spark, sf))


@query("cat_delivery_kpi", f"""SELECT count(*) AS processed, count(*) FILTER (status IN ('PUBLISHED', 'VERIFIED')) AS ready, count(*) - count(*) FILTER (status IN ('PUBLISHED', 'VERIFIED')) AS review_required,
    count(*) FILTER (product_id IN (SELECT product_id FROM conflicts WHERE status = 'OPEN')) AS critical_conflicts, {sv.score('count(*) FILTER (evidence_count > 0) * 100.0::DOUBLE / count(*)', 1)} AS evidence_coverage,
    {sv.score('avg(coalesce(overall_quality_score, 0.0))', 1)} AS overall_quality FROM products""")
def _(spark, sf):
    return catalog.delivery_indicators(views.products(spark, sf), views.conflicts(spark, sf))


@query("cat_latest_job", "SELECT product_id, arg_max(job_id, (started_at, job_id)) AS job_id, arg_max(status, (started_at, job_id)) AS status FROM (SELECT o_custkey AS product_id, o_orderkey AS job_id, o_orderstatus AS status, o_orderdate AS started_at FROM orders) GROUP BY 1")
def _(spark, sf):
    jobs = views.table(spark, sf, "orders").select(c("o_custkey").alias("product_id"), c("o_orderkey").alias("job_id"), c("o_orderstatus").alias("status"), c("o_orderdate").alias("started_at"))
    return catalog.latest_jobs(jobs).select("product_id", "job_id", "status")


@query("cat_conf_summary", """SELECT s.product_id, s.attribute, s.confidence_score, s.confidence_band, p.overall_confidence_score, p.overall_confidence_band, p.has_blocking_conflicts FROM scores s JOIN product_scores p USING (product_id)""")
def _(spark, sf):
    s = _scores(spark, sf)
    p = score.product_confidence(s).select("product_id", "overall_confidence_score", "overall_confidence_band", "has_blocking_conflicts")
    return s.select("product_id", "attribute", "confidence_score", "confidence_band").join(p, "product_id")


# ---------------------------------------------------------------- evaluation

sv.VIEWS["evaluated"] = f"""SELECT p.product_id, coalesce(m.status = 'RESOLVED' OR (m.match_type IN ('EXACT', 'NORMALIZED', 'FUZZY') AND {sv.resolved('m.canonical_value')}), false) AS mfr_ok,
    coalesce(b.status = 'RESOLVED' OR (b.match_type IN ('EXACT', 'NORMALIZED') AND {sv.resolved('b.canonical_value')}), false) OR k.product_id IS NOT NULL AS brand_ok,
    coalesce(t.status IN ('RESOLVED', 'HEURISTIC') AND {sv.resolved('t.class_name')}, false) AS tax_ok, t.status AS taxonomy_status, t.class_name AS taxonomy_class, m.raw_value, m.status, m.match_type,
    coalesce(a.n, 0) AS n_attributes, p.evidence_count, p.overall_quality_score, p.status AS product_status, {_issue_sql('d.desc_short', 'p.brand', 'p.part_number')} = '' AS desc_ok,
    {sv.resolved('d.desc_short')} AS desc_made, coalesce(a.has_type, false) AS has_type, {_cat.replace('x,', 'f.x,')} AS input_category
    FROM products p JOIN brand_res b USING (product_id) JOIN mfr_res m USING (product_id) JOIN tax t USING (product_id) JOIN described d USING (product_id)
    JOIN (SELECT product_id, lower(coalesce(description, '') || ' ' || coalesce(brand, '')) AS x FROM feed) f USING (product_id)
    LEFT JOIN (SELECT DISTINCT product_id FROM attributes WHERE name = 'brand' AND {sv.resolved('coalesce(normalized_value, value)')}) k USING (product_id)
    LEFT JOIN (SELECT product_id, count(*) AS n, max(name IN ('product_type', 'candidate_type')) AS has_type FROM attributes GROUP BY 1) a USING (product_id)"""


def _evaluated(spark, sf):
    """Stored products joined with resolution and taxonomy of their raw feed rows."""
    f = views.feed(spark, sf)
    d = _both_names(spark, f)
    d = d.select("product_id", c("description").alias("feed_description"), c("brand").alias("source_brand"), c("manufacturer").alias("source_manufacturer"),
                 c("b.status").alias("brand_status"), c("b.match_type").alias("brand_match_type"), c("b.canonical_value").alias("brand_name"),
                 c("m.status").alias("manufacturer_status"), c("m.match_type").alias("manufacturer_match_type"), c("m.canonical_value").alias("maker_name"))
    t = _taxed(spark, sf).select("product_id", c("tax.status").alias("taxonomy_status"), c("tax.class_name").alias("t_class"))
    a = once(views.attributes(spark, sf))
    p = describe.describe(views.products(spark, sf), a).drop("description", "manufacturer", "taxonomy_class")
    p = p.join(d, "product_id").join(t, "product_id").withColumnsRenamed({"feed_description": "description", "maker_name": "manufacturer", "t_class": "taxonomy_class"})
    flags = evaluate.evaluation_rows(p.withColumn("stored_brand", c("brand")).withColumn("brand", c("brand_name")), a)
    # description issues are about the stored brand
    issues = describe.description_issues(c("desc_short"), c("stored_brand"), c("part_number"))
    return flags.withColumn("desc_ok", F.size(issues) == 0)


@query("evl_resolved_flags", "SELECT product_id, mfr_ok, brand_ok, mfr_ok AND brand_ok AS identity_ok, tax_ok FROM evaluated")
def _(spark, sf):
    return _evaluated(spark, sf).select("product_id", "mfr_ok", "brand_ok", "identity_ok", "tax_ok")


_figs = f"""count(*) AS processed, count(*) FILTER (mfr_ok) AS manufacturer_resolved, count(*) FILTER (brand_ok) AS brand_resolved, count(*) FILTER (mfr_ok AND brand_ok) AS identity_resolved,
    count(*) FILTER (tax_ok) AS taxonomy_resolved, {sv.share('sum(n_attributes)', 'count(*)')} AS attributes_per_product, {sv.share('sum(evidence_count)', 'count(*)')} AS evidence_per_product,
    coalesce({sv.score('avg(coalesce(overall_quality_score, 0.0))', 2)}, 0.0) AS confidence_average, count(*) FILTER (desc_made) AS descriptions_generated, count(*) FILTER (desc_ok) AS descriptions_valid,
    count(*) FILTER (product_status = 'REQUIRES_REVIEW') AS review_required, count(*) FILTER (product_status = 'UNRESOLVED') AS unresolved, count(*) FILTER (has_type) AS product_type_detected"""


@query("evl_summary", f"SELECT {_figs} FROM evaluated")
def _(spark, sf):
    return evaluate.summary(_evaluated(spark, sf))


@query("evl_category", f"SELECT coalesce(input_category, 'ALL') AS bucket, {_figs} FROM evaluated GROUP BY ROLLUP (input_category)")
def _(spark, sf):
    return evaluate.by_category(_evaluated(spark, sf))


@query("evl_evidence_mix", """SELECT CASE WHEN source_type = 'INPUT_DESCRIPTION' OR contains(lower(source_name), 'description') THEN 'input' WHEN source_type IN ('PDF', 'DOCUMENT') THEN 'document'
    WHEN contains(lower(source_name), 'manufacturer') THEN 'manufacturer' ELSE 'input' END AS origin, count(*) AS n_evidence FROM evidence GROUP BY 1""")
def _(spark, sf):
    return evaluate.evidence_mix(views.evidence(spark, sf))


@query("evl_failures", f"""SELECT 'manufacturer' AS kind, {_fail} AS reason, count(*) AS n_products FROM evaluated WHERE NOT mfr_ok GROUP BY 2
    UNION ALL SELECT 'taxonomy', CASE WHEN taxonomy_status = 'RESOLVED' AND lower(taxonomy_class) <> 'unclassified' THEN 'correct_confident' WHEN taxonomy_status = 'HEURISTIC' THEN 'heuristic' ELSE 'unresolved' END, count(*) FROM evaluated GROUP BY 2""")
def _(spark, sf):
    return evaluate.failures(_evaluated(spark, sf))


@query("evl_type_rate", "SELECT count(DISTINCT product_id) AS product_type_detected FROM types WHERE candidate_type IS NOT NULL")
def _(spark, sf):
    long = extract.explode_facts(_mined(spark, sf), "product_id", extract.type_facts(c("text"), views.TYPE_PATTERNS))
    return evaluate.type_rate(long.withColumnRenamed("attribute", "name"))


@query("evl_samples", """SELECT p.product_id, p.part_number, n.names FROM (SELECT * FROM products ORDER BY product_id LIMIT 25) p
    LEFT JOIN (SELECT product_id, string_agg(name, ',' ORDER BY attr_ord, name) AS names FROM attributes GROUP BY 1) n USING (product_id)""")
def _(spark, sf):
    return evaluate.samples(views.products(spark, sf).select("product_id", "part_number"), views.attributes(spark, sf)).select(
        "product_id", "part_number", F.array_join("attribute_names", ",").alias("names"))


# ---------------------------------------------------------------- jobs


def _run_rules(spark):
    from shelfmark.plans.enrich import Rules

    return Rules(views.brand_master(spark), views.maker_master(spark), views.TAX_RULES, views.TYPE_PATTERNS, dim=DIM)


def _enriched(spark, sf):
    from shelfmark.plans.enrich import enrich

    own = views.documents(spark, sf).select("document_id", "document_name", "product_id", "page_number", "text")
    return enrich(views.feed(spark, sf), _run_rules(spark), own)


@query("job_enrich")
def _(spark, sf):
    return _enriched(spark, sf)["products"].select("product_id", "brand", "manufacturer", "category", "n_attributes", "evidence_count", "conflict_count",
                                                   "overall_quality_score", "status", "desc_short")


@query("job_stage_log")
def _(spark, sf):
    return _enriched(spark, sf)["stage_log"]


@query("job_run_log")
def _(spark, sf):
    from shelfmark.plans.enrich import RunLog, enrich

    own = views.documents(spark, sf).select("document_id", "document_name", "product_id", "page_number", "text")
    log = RunLog()
    enrich(views.feed(spark, sf), _run_rules(spark), own, log=log)
    return log.table(spark)


# every part once, and again where its key divides by 31, in four files by key
sv.VIEWS["delivered"] = """SELECT *, row_number() OVER (PARTITION BY part ORDER BY p_partkey, copy) AS feed_row,
    row_number() OVER (PARTITION BY part ORDER BY p_partkey, copy) - copy AS first_row FROM (SELECT p_partkey, p_partkey % 4 AS part, unnest(CASE WHEN p_partkey % 31 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM part)"""
sv.VIEWS["judged"] = """SELECT *, CASE WHEN p_partkey % 97 = 1 THEN 'Missing part number' WHEN copy = 1 THEN concat('Repeats row ', first_row, ' of part=', part) END AS reason FROM delivered"""


@query("job_chunked_batch", """SELECT part, min(feed_row) AS first_row, max(feed_row) AS last_row, count(*) AS processed, count(*) - count(reason) AS succeeded, count(reason) AS failed, NULL AS message FROM judged GROUP BY part
    UNION ALL SELECT part, feed_row, feed_row, NULL, NULL, NULL, concat('Row ', feed_row, ': ', reason, ', skipped') FROM judged WHERE reason IS NOT NULL""")
def _(spark, sf):
    """A feed of four files, two a batch: a ledger row per file, and each rejected row."""
    from shelfmark.streaming import batches

    folder = scratch(spark)
    p = views.table(spark, sf, "part")
    copies = F.when(c("p_partkey") % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    part = (c("p_partkey") % 4).cast("int")
    (p.withColumn("copy", F.explode(copies)).withColumn("part", part).repartition(4, "part").sortWithinPartitions("part", "p_partkey", "copy")
     .write.partitionBy("part").parquet(f"{folder}/feed"))
    feed = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/feed/part=*")
    batches.run_batches(feed, f"{folder}/out", f"{folder}/checkpoint", _run_rules, views.feed_rows)
    number = F.regexp_extract("feed_file", "part=(\\d+)", 1).cast("int").alias("part")
    # a file is named after its folder here, as the writer's own names hold random ids
    message = F.regexp_replace("message", r" of part-[^,]*,", F.concat(F.lit(" of part="), number.cast("string"), F.lit(",")))
    counts = ["processed", "succeeded", "failed"]
    done = batches.ledger(spark, f"{folder}/out").select(number, "first_row", "last_row", *counts, F.lit(None).cast("string").alias("message"))
    bad = batches.errors(spark, f"{folder}/out").select(number, c("feed_row").alias("first_row"), c("feed_row").alias("last_row"),
                                                        *(F.lit(None).cast("bigint").alias(x) for x in counts), message.alias("message"))
    return done.unionByName(bad)


@query("job_review_stream")
def _(spark, sf):
    from shelfmark.streaming import reviews

    folder = scratch(spark)
    known = views.norms(spark, sf)
    a = store.Staging(spark).keep(views.attributes(spark, sf, known), "attributes")
    f = store.Staging(spark).keep(views.conflicts(spark, sf, known), "conflicts")
    log = views.table(spark, sf, "events")
    log.withColumn("turn", (c("event_id") % 3).cast("int")).repartition("turn").write.partitionBy("turn").parquet(f"{folder}/events")
    events = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events/turn=*")
    # buckets are compacted on the way
    reviews.run_reviews(views.decision_rows(events), f"{folder}/out", f"{folder}/checkpoint", lambda: a, lambda: f, buckets=16, compact_after=1)
    return reviews.current(a, f"{folder}/out", "attributes", 16).select("product_id", "name", "value", "confidence", "status")


ORACLES["job_review_stream"] = "SELECT product_id, name, value, confidence, status FROM reviewed"
