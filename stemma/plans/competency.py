"""The eight competency queries, on property views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import iri_fragment, str_after
from ..operators.relational import conflicting, joined_set, measures_beside, shared_pairs
from .knowledge import Views

ALIEN = ("InvasiveAlienSpecies", "PotentialInvasiveSpecies", "AlienSpecies")
RED_LISTS = ("DLDVN", "SDVN")
WATER = {"chla": "Chl-a (ug/L)", "po4": "Photphat (mgP-PO4/L)", "nh4": "Amoni (mgN-NH4/L)", "transparency": "Độ trong (cm)"}


def reconciled(v: Views) -> DataFrame:
    """u, waterbody (label), group, name: usages of named species with accepted names, where there are any."""
    names = v.taxon_name.join(v.accepted, "taxon", "left").select("taxon", F.coalesce("accepted", "name").alias("name"))
    rows = v.usage.where(~F.col("morpho")).join(names, "taxon").join(v.source_group, "source").join(v.waterbody, "waterbody")
    return rows.select("u", F.col("label").alias("waterbody"), "group", "name")


def richness(v: Views) -> DataFrame:
    """CQ1: usages and different names by waterbody and group."""
    out = reconciled(v).groupBy("waterbody", "group").agg(F.count_distinct("u").alias("records"), F.count_distinct("name").alias("distinct_accepted_names"))
    return out.orderBy("waterbody", "group")


def shared_species(v: Views) -> DataFrame:
    """CQ2: names that two waterbodies share within a group."""
    out = shared_pairs(reconciled(v), "group", "waterbody", "name")
    return out.select("group", F.col("a").alias("wb1"), F.col("b").alias("wb2"), "shared", F.col("names").alias("species")).orderBy("group", "wb1", "wb2")


def threatened(v: Views) -> DataFrame:
    """CQ3: taxa that any scheme calls CR, EN or VU, by waterbody, and who says so."""
    rated = v.assessment.where(F.col("category").isin("CR", "EN", "VU")).select("a", "scheme", "version", "category", "source")
    rows = v.usage_assessment.join(rated, "a").join(v.usage.select("u", "taxon", "waterbody"), "u").join(v.taxon_name, "taxon").join(v.waterbody, "waterbody")
    said = F.concat("scheme", F.lit("-"), "version", F.lit(":"), "category")
    out = rows.groupBy("name", F.col("label").alias("waterbody")).agg(joined_set(said, ", ").alias("assessments"), joined_set(str_after(F.col("source"), "source/"), ",").alias("sources"))
    return out.orderBy("name", "waterbody")


def alien_spread(v: Views) -> DataFrame:
    """CQ4: where taxa flagged as alien by any document are recorded by all documents."""
    flags = v.trait.withColumn("flag", iri_fragment(F.col("trait"))).where(F.col("flag").isin(*ALIEN))
    flagged = flags.join(v.usage.select(F.col("u").alias("subject"), "taxon").distinct(), "subject").select("taxon", "flag").distinct()
    recorded = v.usage.select("taxon", "waterbody", "source").distinct()
    rows = flagged.join(recorded, "taxon").join(v.waterbody, "waterbody").join(v.taxon_name, "taxon")
    out = rows.groupBy("name", "flag").agg(
        joined_set("label", ", ").alias("waterbodies"), joined_set(str_after(F.col("source"), "source/"), ",").alias("recorded_in_sources"), F.count_distinct("source").alias("_n")
    )
    return out.orderBy(F.desc("_n"), "name", "flag").drop("_n")


def toxic_densities(v: Views, trait: str = "ToxicCyanobacterium", most: int = 15) -> DataFrame:
    """CQ5: the highest densities of toxic taxa, with the water's measures at that place and time."""
    toxic = v.trait.where(iri_fragment(F.col("trait")) == trait).select(F.col("subject").alias("taxon")).distinct().join(v.taxon_name, "taxon")
    seen = v.abundance.where("value is not null and site is not null").join(toxic, "taxon").select("name", "time", "site", F.col("code"), F.col("value").alias("density"))
    out = measures_beside(seen, v.water, ["site", "time"], "label", "value", WATER)
    return out.select("name", "time", F.col("code").alias("site"), "density", *WATER).orderBy(F.desc("density"), "name", "time", "site", *WATER).limit(most)


def curation_queue(v: Views) -> DataFrame:
    """CQ6: usages with issues by document and issue."""
    rows = v.issue.join(v.usage.select("u", "source").distinct(), "u")
    out = rows.groupBy("source", "issue").agg(F.count_distinct("u").alias("n"))
    return out.select(str_after(F.col("source"), "source/").alias("source"), str_after(F.col("issue"), "#").alias("issue_type"), "n").orderBy("source", "issue_type")


def assessment_conflicts(v: Views) -> DataFrame:
    """CQ7: taxa with more than one category under a scheme, red lists of one country counting as one scheme."""
    rows = v.assessment.withColumn("family_scheme", F.when(F.col("scheme").isin(*RED_LISTS), "VN_RedList").otherwise(F.col("scheme")))
    several = conflicting(rows, ["taxon", "family_scheme"], "category").join(v.taxon_name, "taxon")
    said = F.concat(str_after(F.col("source"), "source/"), F.lit("="), "scheme", F.lit("-"), "version", F.lit(":"), "category")
    return several.groupBy("name", "family_scheme").agg(joined_set(said, " | ").alias("assessments")).orderBy("name", "family_scheme")


def not_in_matrix(v: Views, source: str, group: str = "phytoplankton") -> DataFrame:
    """CQ8: named species of a checklist that the matrix of its group never counts."""
    listed = v.usage.where(~F.col("morpho") & (F.col("source") == source)).select("u", "taxon").distinct().join(v.taxon_name, "taxon")
    counted = v.abundance.where(F.col("group") == group).select("taxon").distinct()
    return listed.join(counted, "taxon", "left_anti").select("name").orderBy("name")
