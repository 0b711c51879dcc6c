"""Evaluation and consistency reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators.ordered import between_captions
from ..operators.relational import first_with_prefix, joined_set, last_values, matched_positions, scores, sorensen
from .checklist import UNRESOLVED

MATCHES = ("exact", "fuzzy", "fuzzy_rejected", "higherrank", "none", "synonym")
STATUS = "map<string,string>"


def completeness(records: DataFrame, registry: DataFrame, meta: DataFrame) -> DataFrame:
    """Records, genera, families and orders extracted beside those reported, in order of the sources' first records."""
    counted = records.groupBy("source").agg(
        F.count("*").alias("records_extracted"),
        F.count_distinct(F.when(~F.col("is_higher_taxon"), F.col("genus"))).alias("genus_extracted"),
        F.count_distinct(F.lower("src_family")).alias("family_extracted"),
        F.count_distinct(F.lower("src_order")).alias("order_extracted"),
    )
    said = registry.select(F.col("id").alias("source"), "waterbody", "group", *(F.col("reported")[k].alias(f"{k}_reported") for k in ("species", "genus", "family", "order")))
    return said.join(counted, "source").join(meta.select("source", "glyph_fixes"), "source", "left")


def site_totals(presence: DataFrame, records: DataFrame, registry: DataFrame, meta: DataFrame) -> DataFrame:
    """Records present at each site beside the printed totals."""
    said = registry.select(F.col("id").alias("source"), F.col("reported")["sites"].alias("sites")).where("sites > 0")
    printed = meta.select("source", F.from_json("totals_row", "array<int>").alias("totals")).where("totals is not null")
    present = presence.where("present").groupBy("source", "site").agg(F.count("*").cast("int").alias("n"))
    found = present.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("site", "n"))).alias("found"))
    cells = records.groupBy("source").agg(F.count("*").alias("records"))
    rows = said.join(printed, "source").join(cells, "source").join(found, "source", "left")
    got = F.transform(F.sequence(F.lit(1), F.col("sites")), lambda i: F.coalesce(F.try_element_at("found", F.concat(F.lit("M"), i.cast("string"))), F.lit(0)))
    rows = rows.withColumn("reported", F.slice("totals", F.lit(1), F.col("sites"))).withColumn("recomputed", got)
    return rows.select("source", "sites", (F.col("records") * F.col("sites")).alias("cells"), matched_positions(F.col("reported"), F.col("recomputed")).alias("site_totals_matched"), "reported", "recomputed")


def status_totals(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Statuses and printed symbols beside the totals that the authors give."""
    entries = records.select("source", F.explode(F.from_json("status", STATUS)).alias("column", "value"))
    unsafe = entries.where(F.col("column").startswith("IUCN") & ~F.col("value").isin("LC", "NE", "DD")).withColumn("column", F.concat("column", F.lit("_nonLC")))
    counts = entries.unionByName(unsafe).groupBy("source", "column").agg(F.count("*").alias("extracted"))
    known = registry.withColumnRenamed("id", "source").join(records.select("source").distinct(), "source", "left_semi")
    parts = [known.select("source", F.lit(ref).alias("reference"), F.explode(ref).alias("column", "reported")) for ref in ("status_footer", "status_abstract")]
    by_status = parts[0].unionByName(parts[1]).join(counts, ["source", "column"], "left")
    legend = known.select("source", F.explode("symbol_legend").alias("_symbol", "column"), "symbol_abstract")
    legend = legend.withColumn("reported", F.try_element_at("symbol_abstract", F.col("column"))).where("reported is not null")
    by_symbol = legend.join(records.select("source", "symbols"), "source").groupBy("source", "column", "reported", "_symbol").agg(F.count_if(F.contains("symbols", F.col("_symbol"))).alias("extracted"))
    both = by_status.unionByName(by_symbol.select("source", F.lit("symbol_abstract").alias("reference"), "column", "reported", "extracted"))
    both = both.withColumn("extracted", F.coalesce("extracted", F.lit(0)))
    return both.select("source", "reference", "column", "reported", "extracted", (F.col("reported") == F.col("extracted")).alias("match"))


def resolution(records: DataFrame) -> DataFrame:
    """Records by source and class of match, and those that only the second pass resolved."""
    pivot = records.groupBy("source").pivot("gbif_match", list(MATCHES)).count().na.fill(0)
    second = records.where("gbif_pass = 2").groupBy("source").agg(F.count("*").alias("resolved_2nd_pass"))
    return pivot.join(second, "source", "left").na.fill(0, ["resolved_2nd_pass"])


def name_issues(records: DataFrame) -> DataFrame:
    wanted = F.col("gbif_match").isin("fuzzy", "synonym", "none", "higherrank") | (F.col("gbif_pass") == 2)
    return records.where(wanted).select("source", "raw_name", "canonical", "gbif_match", "gbif_pass", "gbif_name", "gbif_accepted", "gbif_family")


def family_conflicts(records: DataFrame) -> DataFrame:
    """Records whose printed family isn't the authority's, and of what kind the difference is."""
    rows = records.where(~F.col("family_agrees"))
    kind = names.conflict_kind(F.col("src_family"), F.col("gbif_family"), F.col("family_similarity"), F.col("gbif_match"))
    return rows.select("source", "canonical", "src_family", "gbif_family", "family_similarity", "gbif_match", kind.alias("kind"))


def across_sources(records: DataFrame) -> DataFrame:
    """Taxa that several documents record, with their red-list categories; the last record of a source counts, as idx has it."""
    rows = records.where(F.col("gbif_key").isNotNull() & ~F.col("is_morphospecies"))
    shared = rows.groupBy("gbif_key").agg(F.min("source").alias("_a"), F.max("source").alias("_b")).where("_a <> _b").select("gbif_key")
    rows = rows.join(shared, "gbif_key", "left_semi").withColumn("_status", F.from_json("status", STATUS))
    for out, prefixes in (("iucn", ("IUCN",)), ("vn_redlist", ("DLDVN", "SDVN"))):
        rows = rows.withColumn(out, first_with_prefix(F.col("_status"), *prefixes))
    iucn = last_values(rows, ["gbif_key"], "source", "iucn", "idx").select("gbif_key", F.col("entries").alias("iucn"))
    red = last_values(rows, ["gbif_key"], "source", "vn_redlist", "idx").select("gbif_key", F.col("entries").alias("vn_redlist"))
    about = rows.groupBy("gbif_key").agg(
        F.min_by("gbif_name", F.struct("source", "idx")).alias("name"),
        F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"),
        joined_set("canonical", "; ").alias("src_names"),
        joined_set("vn_name", "; ").alias("vn_names"),
        (F.count_distinct(F.lower("src_family")) > 1).alias("src_family_conflict"),
    )
    several = F.size(F.array_distinct(F.filter(F.map_values("iucn"), lambda x: F.coalesce(x, F.lit("")) != ""))) > 1
    return about.join(iucn, "gbif_key").join(red, "gbif_key").withColumn("iucn_conflict", several)


def accepted_name():
    return F.when(F.col("gbif_match").isin(*UNRESOLVED), F.col("canonical")).otherwise(F.coalesce("gbif_accepted", "gbif_name"))


def overlap(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """The species that pairs of waterbodies (group, a, b) share, by printed and by accepted names, and what reconciliation gains."""
    rows = records.where(~F.col("is_morphospecies") & ~F.col("is_higher_taxon")).withColumn("accepted", accepted_name())
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("names"), F.col(k).alias("name")) for k in ("canonical", "accepted")))).alias("k")
    sets = rows.select("group", "waterbody", kinds).select("group", "waterbody", "k.*").where("name is not null").distinct()
    sides = pairs.select("group", "a", "b", F.explode(F.array("a", "b")).alias("waterbody"))
    held = sides.join(sets, ["group", "waterbody"]).groupBy("group", "a", "b", "names", "name").agg(F.max(F.col("waterbody") == F.col("a")).alias("in_a"), F.max(F.col("waterbody") == F.col("b")).alias("in_b"))
    both = F.col("in_a") & F.col("in_b")
    counts = held.groupBy("group", "a", "b", "names").agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(both).alias("shared"), F.collect_set(F.when(both, F.col("name"))).alias("_both"))
    printed = counts.where("names = 'canonical'").select("group", "a", "b", F.col("_both").alias("_printed"))
    out = counts.join(printed, ["group", "a", "b"], "left")
    gained = F.when(F.col("names") == "accepted", F.array_sort(F.array_except("_both", F.coalesce("_printed", F.array().cast("array<string>")))))
    return out.select("group", "a", "b", "names", "n_a", "n_b", "shared", sorensen(F.col("shared"), F.col("n_a"), F.col("n_b")).alias("sorensen"), gained.alias("gained_by_reconciliation"))


def name_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """P, R and F1 of names by source and method: predicted (source, method, name), gold (source, name)."""
    gold = gold.select("source", names.scoring_name(F.col("name")).alias("name")).distinct()
    methods = predicted.select("source", "method").distinct()
    p = predicted.select("source", "method", "name", F.lit(True).alias("_p")).distinct()
    rows = methods.join(gold, "source").withColumn("_g", F.lit(True)).join(p, ["source", "method", "name"], "full")
    return scores(rows.na.fill(False, ["_p", "_g"]), ["source", "method"], "_p", "_g").drop("tp")


def mean_scores(per_source: DataFrame) -> DataFrame:
    return per_source.groupBy("method").agg(*(F.bround(F.avg(c), 3).alias(c) for c in ("P", "R", "F1")))


def rendering_totals(segments: DataFrame, registry: DataFrame) -> DataFrame:
    """How many site totals agree with the printed ones for each rendering: segments with a column render."""
    said = registry.select(F.col("id").alias("source"), F.col("reported")["sites"].alias("n")).where("n > 0")
    present = segments.select("source", "render", F.explode("sites").alias("site", "mark")).where("mark = '+'")
    counts = present.groupBy("source", "render", "site").agg(F.count("*").cast("int").alias("c"))
    found = counts.groupBy("source", "render").agg(F.map_from_entries(F.collect_list(F.struct("site", "c"))).alias("found"))
    rows = segments.groupBy("source", "render").agg(F.count("*").alias("records"), F.first("totals", ignorenulls=True).alias("totals")).join(said, "source").join(found, ["source", "render"], "left")
    got = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.try_element_at("found", F.concat(F.lit("M"), i.cast("string"))), F.lit(0)))
    matched = F.when(F.size("totals") > 0, matched_positions(F.slice("totals", F.lit(1), F.col("n")), got))
    return rows.select("source", "render", "records", matched.alias("site_totals_matched"), F.col("n").alias("sites"))


def verbatim(names_found: DataFrame, texts: DataFrame) -> DataFrame:
    """How many canonical names (source, variant, name) stand in the folded text of their source (source, text)."""
    stem = F.split_part(F.regexp_replace("name", r"sp\.\d+$", "sp"), F.lit(" sp"), F.lit(1))
    rows = names_found.join(texts, "source").withColumn("_in", F.contains("text", stem))
    return rows.groupBy("source", "variant").agg(F.count("*").alias("records"), F.count_if("_in").alias("canonical_found_verbatim"))


def regex_predictions(lines: DataFrame, registry: DataFrame, method: str) -> DataFrame:
    """source, method, name: binomials between a table's caption and the next, or in the whole text where the caption isn't found; lines (source, line_no, line)."""
    rows = lines.join(registry.select(F.col("id").alias("source"), "table"), "source")
    marked = rows.withColumn("_begin", F.rlike("line", F.col("table")))
    found = marked.groupBy("source").agg(F.max("_begin").alias("_found"))
    inside = between_captions(marked, ["source"], "line_no", F.col("_begin"), F.col("line").rlike(r"^\s*(?:Bảng \d+\.|Ghi chú)"))
    whole = marked.join(found.where(~F.col("_found")), "source", "left_semi")
    texts = inside.unionByName(whole).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return texts.select("source", F.lit(method).alias("method"), F.explode(names.binomials(F.array_join(F.col("l.line"), "\n"))).alias("name"))


def merging(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Records of each variant (source, variant, n, raw_name, name), how many lack a binomial, and how many equal the gold name (source, n, name) in their place; null unless the numbers agree."""
    sizes = gold.groupBy("source").agg(F.count("*").alias("_gold"))
    rows = predicted.join(gold.withColumnRenamed("name", "_name"), ["source", "n"], "left")
    counts = rows.groupBy("source", "variant").agg(
        F.count("*").alias("records"), F.count_if(F.col("name") == F.col("_name")).alias("_equal"), F.count_if(~F.col("raw_name").rlike("^[A-Z][a-z]+ ")).alias("records_without_binomial")
    )
    out = counts.join(sizes, "source", "left")
    return out.select("source", "variant", "records", F.when(F.col("records") == F.col("_gold"), F.col("_equal")).alias("names_equal_reference"), "records_without_binomial")
