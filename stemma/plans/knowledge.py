"""The knowledge graph: tables to triples, and triples to views of their properties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import head_and_rest, slug, without_spaces
from ..operators.graph import RDF_TYPE, as_set, instances, iri, literal, objects
from ..operators.relational import with_aliases

BASE = "https://example.org/checklists/"
DWC = "http://rs.tdwg.org/dwc/terms/"
SOSA = "http://www.w3.org/ns/sosa/"
PROV = "http://www.w3.org/ns/prov#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
DCT = "http://purl.org/dc/terms/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
GEO = "http://www.w3.org/2003/01/geo/wgs84_pos#"
XSD = "http://www.w3.org/2001/XMLSchema#"
AUTHORITY = "https://www.gbif.org/species/"

# Classes, traits by the key that tables use, and issues with their labels.
CLASSES = ("SourceDocument", "Waterbody", "SamplingSite", "NameUsage", "ConservationAssessment", "SiteOccurrence", "AbundanceObservation", "WaterQualityObservation", "Trait", "CurationIssue")
TRAITS = {
    "economic": "EconomicValue",
    "aquaculture": "AquacultureValue",
    "ornamental": "OrnamentalValue",
    "alien": "AlienSpecies",
    "invasive": "InvasiveAlienSpecies",
    "potential_invasive": "PotentialInvasiveSpecies",
    "widespread_invasive": "WidespreadInvasiveSpecies",
    "Tảo độc": "ToxicCyanobacterium",
    "Tảo gây hại": "HarmfulAlga",
}
ISSUES = {
    "misspelling": "Tên viết sai chính tả (khớp mờ GBIF)",
    "outdated_name": "Tên đồng nghĩa / đã lỗi thời",
    "family_conflict": "Họ trong tài liệu khác họ trong GBIF",
    "unresolved": "Không đối sánh được / chỉ khớp bậc cao",
    "homonym_resolved": "Tên trùng giữa các giới, phân giải nhờ ngữ cảnh",
    "no_site_data": "Không có dữ liệu có/không tại điểm nào",
}
EVIDENCE = ("specimen", "interview")
UNRESOLVED = ("none", "higherrank", "fuzzy_rejected")


@dataclass(frozen=True)
class Vocabulary:
    base: str = BASE

    def term(self, name: str) -> str:
        return f"{self.base}ontology#{name}"

    def resource(self, kind: str, *parts: Column) -> Column:
        return F.concat(F.lit(f"{self.base}resource/{kind}/"), F.concat_ws("/", *(p.cast("string") for p in parts)))


def taxon_of(v: Vocabulary, key: Column, match: Column, canonical: Column) -> Column:
    """The authority's IRI if the name was accepted for it, else a local one by the canonical name."""
    known = key.isNotNull() & ~F.coalesce(match, F.lit("")).isin("none", "fuzzy_rejected")
    return F.when(known, F.concat(F.lit(AUTHORITY), key.cast("long").cast("string"))).otherwise(v.resource("taxon", slug(canonical)))


def to_triples(tables: dict[str, DataFrame], registry: DataFrame, waterbody_types: dict[str, str], province: str = "", v: Vocabulary | None = None, aliases: dict[str, str] | None = None, native_range_of: str | None = None) -> DataFrame:
    """All triples of the tables records, presence, sites, abundance and water_quality (with `row_no` in the last two, for their IRIs).

    aliases: sources that use another source's site codes. native_range_of: the source whose extra column is a native range.
    """
    v = v or Vocabulary()
    t, lit = v.term, F.lit
    spark = registry.sparkSession
    typed = lambda rows, s, cls: iri(rows, s, RDF_TYPE, lit(cls))
    out: list[DataFrame] = []

    # The vocabulary itself.
    def constants(rows: list[tuple]) -> DataFrame:
        return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")

    out.append(constants([(t(c), RDF_TYPE, RDFS + "Class", "iri", None, None) for c in CLASSES]))
    out.append(constants([x for k, text in ISSUES.items() for x in ((t(k), RDF_TYPE, t("CurationIssue"), "iri", None, None), (t(k), SKOS + "prefLabel", text, "literal", None, "vi"))]))
    out.append(constants([(t(x), RDF_TYPE, t("Trait"), "iri", None, None) for x in sorted(set(TRAITS.values()))]))

    source = v.resource("source", F.col("id"))
    out += [
        typed(registry, source, t("SourceDocument")),
        literal(registry, source, DCT + "bibliographicCitation", F.col("cite"), lang="vi"),
        literal(registry, source, DCT + "date", F.col("year"), XSD + "gYear"),
        literal(registry, source, t("taxonGroup"), F.col("group")),
    ]
    reported = registry.select("id", F.explode("reported").alias("k", "n"))
    out.append(
        reported.select(source.alias("s"), F.concat(lit(t("reported_")), "k").alias("p"), F.col("n").cast("string").alias("o"), lit("literal").alias("o_kind"), lit(XSD + "integer").alias("o_datatype"), lit(None).cast("string").alias("o_lang"))
    )

    bodies = spark.createDataFrame(list(waterbody_types.items()), "waterbody string, type string")
    body = v.resource("waterbody", slug(F.col("waterbody")))
    out += [
        typed(bodies, body, t("Waterbody")),
        literal(bodies, body, RDFS + "label", F.col("waterbody"), lang="vi"),
        literal(bodies, body, t("waterbodyType"), F.col("type"), lang="vi"),
        literal(bodies, body, t("province"), lit(province or None), lang="vi"),
    ]

    sites = tables["sites"]
    site = v.resource("site", F.col("site_uid"))
    out += [
        typed(sites, site, t("SamplingSite")),
        literal(sites, site, GEO + "lat", F.col("lat"), XSD + "decimal"),
        literal(sites, site, GEO + "long", F.col("lon"), XSD + "decimal"),
        iri(sites, site, t("inWaterbody"), body),
        literal(sites, site, t("localCode"), F.concat_ws(":", "source", "site")),
    ]
    local = with_aliases(sites.select("source", "site", site.alias("site_iri")), "source", aliases or {})

    # Names.
    records = tables["records"].join(registry.select(F.col("id").alias("source"), "symbol_legend", F.col("reported")["sites"].alias("_sites")), "source")
    records = records.withColumn("_taxon", taxon_of(v, F.col("gbif_key"), F.col("gbif_match"), F.col("canonical"))).withColumn("_usage", v.resource("usage", F.col("source"), F.col("idx")))
    taxon, usage, known = F.col("_taxon"), F.col("_usage"), F.col("gbif_name").isNotNull()
    origin = v.resource("source", F.col("source"))
    out += [
        typed(records, taxon, DWC + "Taxon"),
        literal(records, taxon, DWC + "scientificName", F.coalesce("gbif_name", "canonical")),
        literal(records, taxon, DWC + "taxonRank", F.when(known, F.lower("gbif_rank"))),
        literal(records, taxon, t("gbifTaxonomicStatus"), F.when(known, F.col("gbif_status"))),
        literal(records, taxon, t("acceptedNameGBIF"), F.when(known, F.col("gbif_accepted"))),
        *(literal(records, taxon, DWC + r, F.when(known, F.col(f"gbif_{r}"))) for r in ("kingdom", "phylum", "class", "order", "family", "genus")),
        typed(records, usage, t("NameUsage")),
        literal(records, usage, t("verbatimName"), F.col("raw_name")),
        literal(records, usage, DWC + "scientificName", F.col("canonical")),
        literal(records, usage, DWC + "scientificNameAuthorship", F.col("authorship")),
        literal(records, usage, DWC + "vernacularName", F.when(F.col("vn_name") != "", F.col("vn_name")), lang="vi"),
        literal(records, usage, t("verbatimFamily"), F.col("src_family")),
        iri(records, usage, t("resolvesTo"), taxon),
        literal(records, usage, t("matchType"), F.col("gbif_match")),
        literal(records, usage, t("isMorphospecies"), F.col("is_morphospecies"), XSD + "boolean"),
        iri(records, usage, t("recordedIn"), body),
        iri(records, usage, PROV + "wasDerivedFrom", origin),
        literal(records, usage, t("rowIndex"), F.col("idx"), XSD + "integer"),
    ]
    match = F.col("gbif_match")
    found = F.array_compact(
        F.array(
            F.when(match == "fuzzy", "misspelling"),
            F.when(match == "synonym", "outdated_name"),
            F.when(match.isin(*UNRESOLVED), "unresolved"),
            F.when(F.col("gbif_pass") == 2, "homonym_resolved"),
            F.when(~F.col("family_agrees"), "family_conflict"),
            F.when((F.coalesce("_sites", lit(0)) > 0) & (F.col("n_sites_marked") == 0), "no_site_data"),
        )
    )
    out.append(iri(records.withColumn("_issue", F.explode(found)), usage, t("hasIssue"), F.concat(lit(t("")), F.col("_issue"))))

    # Statuses: evidence, traits, or assessments under a scheme with its version.
    traits = F.create_map(*(lit(x) for k, n in TRAITS.items() for x in (k, t(n))))
    status = records.select("*", F.explode(F.from_json("status", "map<string,string>")).alias("_key", "_value"))
    out.append(literal(status.where(F.col("_key").isin(*EVIDENCE)), usage, t("evidence"), F.col("_key")))
    out.append(iri(status.where(F.col("_key").isin(*TRAITS)), usage, t("hasTrait"), traits[F.col("_key")]))
    rated = status.where(~F.col("_key").isin("codes", *EVIDENCE, *TRAITS))
    assessment = v.resource("assessment", F.col("source"), F.col("idx"), F.col("_key"))
    scheme, version = head_and_rest(F.col("_key"))
    out += [
        typed(rated, assessment, t("ConservationAssessment")),
        literal(rated, assessment, t("scheme"), scheme),
        literal(rated, assessment, t("schemeVersion"), version),
        literal(rated, assessment, t("category"), without_spaces(F.col("_value"))),
        iri(rated, assessment, t("assessedTaxon"), taxon),
        iri(rated, assessment, PROV + "wasDerivedFrom", origin),
        iri(rated, usage, t("hasAssessment"), assessment),
    ]
    marked = records.select("*", F.explode("symbol_legend").alias("_symbol", "_trait")).where(F.contains("symbols", F.col("_symbol")))
    out.append(iri(marked, usage, t("hasTrait"), traits[F.col("_trait")]))
    if native_range_of is not None:
        out.append(literal(records.where(F.col("source") == native_range_of), usage, t("nativeRange"), F.col("extra"), lang="vi"))

    # Occurrences at sites with coordinates; others are left out.
    presence = tables["presence"].join(local, ["source", "site"])
    occurrence = v.resource("siteocc", F.col("source"), F.col("idx"), F.col("site"))
    out += [
        typed(presence, occurrence, t("SiteOccurrence")),
        iri(presence, occurrence, t("ofUsage"), v.resource("usage", F.col("source"), F.col("idx"))),
        iri(presence, occurrence, t("atSite"), F.col("site_iri")),
        literal(presence, occurrence, DWC + "occurrenceStatus", F.when(F.col("present"), "present").otherwise("absent")),
    ]

    # Observations keep their rows where a site has no coordinates.
    counts = tables["abundance"].join(local, ["source", "site"], "left")
    seen = v.resource("obs/abundance", F.col("row_no"))
    what = F.when(F.col("gbif_key").isNotNull(), F.concat(lit(AUTHORITY), F.col("gbif_key").cast("long").cast("string"))).otherwise(v.resource("taxon", slug(F.col("canonical"))))
    counts = counts.withColumn("_what", what)
    what, number = F.col("_what"), F.when(F.col("value") >= 0, F.col("value"))
    out += [
        typed(counts, seen, t("AbundanceObservation")),
        typed(counts, seen, SOSA + "Observation"),
        iri(counts, seen, t("observedTaxon"), what),
        typed(counts, what, DWC + "Taxon"),
        iri(counts, seen, SOSA + "hasFeatureOfInterest", F.col("site_iri")),
        literal(counts, seen, t("localSiteCode"), F.col("site")),
        literal(counts, seen, SOSA + "resultTime", F.col("campaign"), XSD + "gYearMonth"),
        literal(counts, seen, t("taxonGroup"), F.col("group")),
        literal(counts, seen, SOSA + "hasSimpleResult", number, XSD + "decimal"),
        literal(counts, seen, t("unit"), F.when(number.isNotNull(), F.when(F.col("group") == "phytoplankton", "cells/L").otherwise("individuals/m3"))),
        literal(counts, seen, DWC + "occurrenceStatus", F.when(number.isNull(), "present")),
        iri(counts, what, t("hasTrait"), traits[F.col("trait")]),
        iri(counts, seen, PROV + "wasDerivedFrom", origin),
    ]
    water = tables["water_quality"].join(local, ["source", "site"], "left")
    seen, prop = v.resource("obs/wq", F.col("row_no")), v.resource("property", slug(F.col("parameter")))
    out += [
        literal(water, prop, RDFS + "label", F.col("parameter"), lang="vi"),
        typed(water, seen, t("WaterQualityObservation")),
        typed(water, seen, SOSA + "Observation"),
        iri(water, seen, SOSA + "observedProperty", prop),
        iri(water, seen, SOSA + "hasFeatureOfInterest", F.col("site_iri")),
        literal(water, seen, t("localSiteCode"), F.col("site")),
        literal(water, seen, SOSA + "resultTime", F.col("campaign"), XSD + "gYearMonth"),
        literal(water, seen, SOSA + "hasSimpleResult", F.col("value"), XSD + "decimal"),
        iri(water, seen, PROV + "wasDerivedFrom", origin),
    ]
    return as_set(*out)


@dataclass
class Views:
    """Property tables; every value is a row, so several values of a property stay several."""

    usage: DataFrame  # u, taxon, waterbody, source, morpho
    taxon_name: DataFrame  # taxon, name
    accepted: DataFrame  # taxon, accepted
    waterbody: DataFrame  # waterbody, label
    source_group: DataFrame  # source, group
    assessment: DataFrame  # a, taxon, scheme, version, category, source
    usage_assessment: DataFrame  # u, a
    trait: DataFrame  # subject, trait
    issue: DataFrame  # u, issue
    abundance: DataFrame  # o, taxon, site, code, time, value, group
    water: DataFrame  # site, time, label, value


def views(triples: DataFrame, v: Vocabulary | None = None) -> Views:
    """Views of a triple table; stored by predicate, each reads its own partitions only."""
    v = v or Vocabulary()
    t = v.term

    def view(cls: str, key: str, properties: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
        out = instances(triples, t(cls), key)
        for column, p in properties.items():
            out = out.join(objects(triples, p, key, column), key, "left" if column in optional else "inner")
        return out

    usage = view("NameUsage", "u", {"taxon": t("resolvesTo"), "waterbody": t("recordedIn"), "source": PROV + "wasDerivedFrom", "morpho": t("isMorphospecies")})
    abundance = view(
        "AbundanceObservation",
        "o",
        {"taxon": t("observedTaxon"), "site": SOSA + "hasFeatureOfInterest", "code": t("localSiteCode"), "time": SOSA + "resultTime", "value": SOSA + "hasSimpleResult", "group": t("taxonGroup")},
        ("site", "value"),
    )
    water = view("WaterQualityObservation", "q", {"site": SOSA + "hasFeatureOfInterest", "time": SOSA + "resultTime", "property": SOSA + "observedProperty", "value": SOSA + "hasSimpleResult"})
    labels = triples.where((F.col("p") == RDFS + "label") & (F.col("o_lang") == "vi")).select(F.col("s").alias("property"), F.col("o").alias("label"))
    return Views(
        usage=usage.withColumn("morpho", F.col("morpho") == "true"),
        taxon_name=objects(triples, DWC + "scientificName", "taxon", "name"),
        accepted=objects(triples, t("acceptedNameGBIF"), "taxon", "accepted"),
        waterbody=objects(triples, RDFS + "label", "waterbody", "label"),
        source_group=objects(triples, t("taxonGroup"), "source", "group"),
        assessment=view("ConservationAssessment", "a", {"taxon": t("assessedTaxon"), "scheme": t("scheme"), "version": t("schemeVersion"), "category": t("category"), "source": PROV + "wasDerivedFrom"}),
        usage_assessment=objects(triples, t("hasAssessment"), "u", "a"),
        trait=objects(triples, t("hasTrait"), "subject", "trait"),
        issue=objects(triples, t("hasIssue"), "u", "issue"),
        abundance=abundance.withColumn("value", F.col("value").cast("double")),
        water=water.join(labels, "property").select("site", "time", "label", F.col("value").cast("double").alias("value")),
    )
