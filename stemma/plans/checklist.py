"""Records to reconciled tables: names parsed, resolved in two passes, repaired, sites clustered, matrices made long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, numbers
from ..functions.text import squeeze
from ..operators.ordered import numbered
from ..operators.relational import keep_first, look_up_first, repaired_by_lexicon, second_pass
from ..operators.spatial import first_fit_clusters, numbered_clusters
from ..sources.tables import RANK_COLUMNS

UNRESOLVED = ("none", "higherrank", "fuzzy_rejected")


def record_table(segments: DataFrame, registry: DataFrame) -> DataFrame:
    """A row for each record with its parsed name and the headings it stands under."""
    about = registry.select(F.col("id").alias("source"), "waterbody", "group")
    rows = segments.join(about, "source").withColumn("raw_name", squeeze(F.array_join("name_parts", " "))).withColumn("_name", names.parse(F.col("raw_name")))
    parsed = [F.col(f"_name.{c}").alias(c) for c in ("canonical", "genus", "authorship", "year", "is_morphospecies", "is_higher_taxon", "symbols")]
    return rows.select(
        "source", "waterbody", "group", "idx", "raw_name", "vn_name", *parsed, F.array_join("_name.notes", ";").alias("name_notes"),
        *(F.try_element_at("hierarchy", F.lit(r)).alias(f"src_{r}") for r in ("phylum", "class", "order", "family")),
        F.to_json("status").alias("status"), F.array_join("extra", "; ").alias("extra"), "campaigns", F.size("sites").alias("n_sites_marked"),
        F.size(F.map_filter("sites", lambda _, x: x == "+")).alias("n_sites_present"), "line_no",
    )


def presence_table(segments: DataFrame, registry: DataFrame) -> DataFrame:
    """source, idx, site, present. Where blank means absent, the sites M1..Mn that a record doesn't name are absent."""
    about = registry.select(F.col("id").alias("source"), F.coalesce("blank_means_absent", F.lit(False)).alias("_fill"), F.col("reported")["sites"].alias("_n"))
    rows = segments.join(about, "source")
    every = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.concat(F.lit("M"), i.cast("string")))
    filled = F.map_from_arrays(every, F.transform(every, lambda s: F.coalesce(F.try_element_at("sites", s), F.lit("-"))))
    both = F.map_concat(F.map_filter("sites", lambda k, _: ~F.array_contains(every, k)), filled)
    sites = F.when(F.col("_fill") & (F.col("_n") > 0), both).otherwise(F.col("sites"))
    return rows.select("source", "idx", F.explode(sites).alias("site", "_mark")).select("source", "idx", "site", (F.col("_mark") == "+").alias("present"))


def cache_keys(records: DataFrame) -> DataFrame:
    """cache_key: what both passes ask the authority."""
    keyed = _keyed(records)
    return keyed.select(F.explode(F.array("first_key", "second_key")).alias("cache_key")).distinct()


def _keyed(records: DataFrame) -> DataFrame:
    name = F.struct("canonical", "genus", "is_morphospecies", "is_higher_taxon")
    return records.withColumn("first_key", names.query_key(name)).withColumn("second_key", names.hinted_key(name, F.col("src_family"), F.col("src_order"), F.col("group")))


def resolved(records: DataFrame, answers: DataFrame) -> DataFrame:
    """records with the authority's answer: the first pass, or the hinted second where that alone helps."""
    classify = lambda a: names.match_class(a, F.col("is_morphospecies"))
    rows = second_pass(_keyed(records), answers, ("first_key", "second_key"), classify)
    a = F.col("answer")
    return rows.select(
        *records.columns, a["usageKey"].alias("gbif_key"), a["canonicalName"].alias("gbif_name"), a["rank"].alias("gbif_rank"), a["status"].alias("gbif_status"),
        F.when(a["status"].endswith("SYNONYM"), a["species"]).alias("gbif_accepted"), F.col("match").alias("gbif_match"), a["confidence"].alias("gbif_confidence"), F.col("pass").alias("gbif_pass"),
        *(a[r].alias(f"gbif_{r}") for r in RANK_COLUMNS),
    )


def repairs(records: DataFrame) -> DataFrame:
    """source, rank, damaged, repaired: headings broken by lost glyphs, and the one name of the source's taxa that fits."""
    ranks = ("phylum", "class", "order", "family")
    headings = records.select("source", F.explode(F.array(*(F.struct(F.lit(r).alias("rank"), F.col(f"src_{r}").alias("damaged")) for r in ranks))).alias("h")).select("source", "h.*")
    damaged = headings.where(F.contains("damaged", F.lit(" "))).distinct().withColumn("pattern", names.gap_pattern(F.col("damaged")))
    lexicon = records.select("source", F.explode(F.array(*(f"gbif_{r}" for r in ranks))).alias("word")).where("word is not null").distinct()
    fits = repaired_by_lexicon(damaged.where("pattern is not null"), lexicon, "source", "pattern", "word")
    return fits.unionByName(damaged.where("pattern is null").withColumn("repaired", F.lit(None).cast("string"))).drop("pattern")


def repaired_records(records: DataFrame, fixes: DataFrame) -> DataFrame:
    out = records
    for r in ("phylum", "class", "order", "family"):
        own = fixes.where((F.col("rank") == r) & F.col("repaired").isNotNull()).select("source", F.col("damaged").alias(f"src_{r}"), F.col("repaired").alias("_fix"))
        out = out.join(own, ["source", f"src_{r}"], "left").withColumn(f"src_{r}", F.coalesce("_fix", f"src_{r}")).drop("_fix")
    return out.select(*records.columns)


def guarded(records: DataFrame) -> DataFrame:
    """records with family_agrees and family_similarity; fuzzy matches into unlike families are rejected."""
    a, b = F.col("src_family"), F.col("gbif_family")
    out = records.withColumn("family_agrees", names.same_family(a, b)).withColumn("family_similarity", names.similarity(a, b))
    return out.withColumn("gbif_match", names.guarded_match(F.col("gbif_match"), F.col("family_agrees"), F.col("family_similarity")))


def reconcile(segments: DataFrame, registry: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The record table and its repairs."""
    records = resolved(record_table(segments, registry), answers)
    fixes = repairs(records)
    return guarded(repaired_records(records, fixes)), fixes


def matrix_rows(rows: DataFrame, group_of) -> DataFrame:
    """Long rows of captioned tables (doc_id, block, row_no, cells, caption) whose header names sites M1, M2, ...: site, cell, and the row's cells."""
    from ..operators.ordered import running_last

    is_header = F.exists("cells", lambda c: c.rlike(r"^M\d+$"))
    rows = rows.withColumn("_header", F.when(is_header, F.col("cells")))
    rows = running_last(rows, ["doc_id", "caption"], "row_no", "_header", "_sites").where(~is_header & F.col("_sites").isNotNull() & group_of.isNotNull())
    long = rows.select("*", group_of.alias("group"), F.posexplode("_sites").alias("_i", "site")).where(F.col("site").rlike(r"^M\d+$"))
    return long.withColumn("cell", F.get("cells", F.col("_i"))).withColumn("_last", F.array_max(F.transform("_sites", lambda c, i: F.when(c.rlike(r"^M\d+$"), i))))


def abundance_table(rows: DataFrame, source: str, waterbody: str) -> DataFrame:
    """Counts by site and campaign; * and + count as present, empty cells and zeros are left out."""
    group = F.when(F.contains("caption", F.lit("ực vật nổi")), "phytoplankton").when(F.contains("caption", F.lit("ộng vật nổi")), "zooplankton")
    long = matrix_rows(rows, group).where(F.btrim(F.get("cells", F.lit(0))).rlike(r"^\d+$"))
    last = F.element_at("cells", -1)
    trait = F.when((F.size("cells") > F.col("_last") + 1) & ~last.rlike(r"^[\d.,*]*$"), last).otherwise("")
    out = long.select(
        F.lit(source).alias("source"), F.lit(waterbody).alias("waterbody"), "group", numbers.campaign(F.col("caption")).alias("campaign"), "site", F.get("cells", F.lit(1)).alias("raw_name"), numbers.cell_value(F.col("cell")).alias("value"), trait.alias("trait")
    )
    return out.where("value is not null and campaign is not null")


def water_table(rows: DataFrame, source: str, waterbody: str) -> DataFrame:
    """Measured values by site, campaign and parameter."""
    long = matrix_rows(rows, F.lit("water"))
    out = long.select(
        F.lit(source).alias("source"), F.lit(waterbody).alias("waterbody"), numbers.campaign(F.col("caption")).alias("campaign"), "site", F.get("cells", F.lit(1)).alias("parameter"), numbers.decimal_comma(F.col("cell")).alias("value")
    )
    return out.where("value is not null")


def resolved_abundance(abundance: DataFrame, records: DataFrame, answers: DataFrame) -> DataFrame:
    """abundance with names and keys: those of the first accepted record of the same name, else the authority's own answer."""
    parsed = abundance.withColumn("_name", names.parse(F.col("raw_name"))).withColumn("canonical", F.col("_name.canonical")).withColumn("_key", names.query_key(F.col("_name")))
    own = parsed.join(answers.select(F.col("cache_key").alias("_key"), "answer"), "_key", "left")
    own = own.withColumn("gbif_key", F.col("answer.usageKey")).withColumn("gbif_match", names.match_class(F.col("answer"), F.col("_name.is_morphospecies")))
    best = records.where(~F.col("gbif_match").isin(*UNRESOLVED))
    out = look_up_first(own, best, "canonical", ["source", "idx"], ["gbif_key", "gbif_match"])
    return out.select(*abundance.columns, "canonical", "gbif_key", "gbif_match")


def site_table(lines: DataFrame) -> DataFrame:
    """source, waterbody, site, lat, lon of lines (source, waterbody, line_no, line) that begin with a site code; the last line of a site counts."""
    site = F.regexp_extract("line", r"^\s*(M\d{1,2})\b", 1)
    rows = lines.withColumn("site", site).where("site <> ''").withColumn("_at", numbers.position(F.regexp_replace("line", r"^\s*M\d{1,2}\b", "")))
    rows = keep_first(rows.where("_at is not null"), ["source", "site"], [F.desc("line_no")])
    return rows.select("source", "waterbody", "site", F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"), "line_no")


def clustered_sites(sites: DataFrame, order: list[str], metres: float = 150.0) -> DataFrame:
    """sites with site_uid: sites of a waterbody closer than so much to an earlier one share its id."""
    ordered = numbered(sites, order, "_order")
    return numbered_clusters(first_fit_clusters(ordered, "waterbody", "_order", metres)).drop("_order")
