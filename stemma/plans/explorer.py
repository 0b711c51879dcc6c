"""What a graph explorer shows: nodes, edges, counts, and a page with them inside."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import embeddable_json, iri_fragment, iri_tail
from ..operators.graph import class_counts, described, instances, objects, without_dangling
from ..operators.relational import top_per_group
from .knowledge import CLASSES, DCT, DWC, GEO, PROV, RDFS, SOSA, Vocabulary

TYPES = ("NameUsage", "Taxon", "SourceDocument", "Waterbody", "SamplingSite", "ConservationAssessment")


def _class(v: Vocabulary, name: str) -> str:
    return DWC + "Taxon" if name == "Taxon" else v.term(name)


def _properties(rows: DataFrame, triples: DataFrame, firsts: dict[str, str], lists: dict[str, str] | None = None, fragment: bool = True) -> DataFrame:
    """Columns of each predicate's least object, and of all objects as a list, by one aggregation."""
    lists = lists or {}
    is_p = lambda p: F.col("p") == p
    wanted = triples.where(F.col("p").isin(*firsts.values(), *lists.values()))
    of = iri_fragment if fragment else lambda o: o
    some = wanted.groupBy(F.col("s").alias("id")).agg(
        *(F.min(F.when(is_p(p), F.col("o"))).alias(c) for c, p in firsts.items()), *(F.sort_array(F.collect_set(F.when(is_p(p), of(F.col("o"))))).alias(c) for c, p in lists.items())
    )
    out = rows.join(some, "id", "left")
    for c in lists:
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def _kinds(triples: DataFrame, v: Vocabulary) -> dict[str, DataFrame]:
    t = v.term
    of = lambda name: instances(triples, _class(v, name), "id").distinct()
    out: dict[str, DataFrame] = {}
    taxon = _properties(of("Taxon"), triples, dict(label=DWC + "scientificName", rank=DWC + "taxonRank", family=DWC + "family"), dict(traits=t("hasTrait")))
    out["Taxon"] = taxon.withColumn("label", F.coalesce("label", iri_tail(F.col("id"))))
    named = dict(label=DWC + "scientificName", verbatim=t("verbatimName"), vn=DWC + "vernacularName", source=PROV + "wasDerivedFrom", match=t("matchType"), waterbody=t("recordedIn"))
    usage = _properties(of("NameUsage"), triples, named, dict(issues=t("hasIssue"), traits=t("hasTrait")))
    out["NameUsage"] = usage.withColumn("source", iri_tail(F.col("source")))
    out["SourceDocument"] = _properties(of("SourceDocument"), triples, dict(cite=DCT + "bibliographicCitation", group=t("taxonGroup"))).withColumn("label", iri_tail(F.col("id")))
    out["Waterbody"] = _properties(of("Waterbody"), triples, dict(label=RDFS + "label", kind=t("waterbodyType")))
    site = _properties(of("SamplingSite"), triples, dict(lat=GEO + "lat", lon=GEO + "long"), dict(codes=t("localCode")), fragment=False)
    code = F.coalesce(F.split_part(F.get("codes", F.lit(0)), F.lit(":"), F.lit(2)), F.lit(""))
    out["SamplingSite"] = site.withColumn("label", F.concat(iri_tail(F.col("id")), F.lit(" ("), code, F.lit(")")))
    rated = _properties(of("ConservationAssessment"), triples, dict(scheme=t("scheme"), version=t("schemeVersion"), category=t("category")))
    out["ConservationAssessment"] = rated.withColumn("label", F.concat("scheme", F.lit(" "), "version", F.lit(": "), "category")).select("id", "label")
    return out


def occurrences(triples: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """usage, site, status of each occurrence."""
    v = v or Vocabulary()
    rows = instances(triples, v.term("SiteOccurrence"), "id").distinct()
    rows = _properties(rows, triples, dict(usage=v.term("ofUsage"), site=v.term("atSite"), status=DWC + "occurrenceStatus")).where("usage is not null and site is not null")
    return rows.select("usage", "site", "status")


def observation_counts(triples: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """id, n_abundance, n_wq: observations at each site."""
    v = v or Vocabulary()
    place = objects(triples, SOSA + "hasFeatureOfInterest", "o", "id")
    count = lambda cls, out: instances(triples, v.term(cls), "o").join(place, "o").groupBy("id").agg(F.count("*").alias(out))
    return count("AbundanceObservation", "n_abundance").join(count("WaterQualityObservation", "n_wq"), "id", "full")


def top_abundance(triples: DataFrame, v: Vocabulary | None = None, most: int = 8) -> DataFrame:
    """id, n, top: each taxon's counted observations and the highest of them."""
    v = v or Vocabulary()
    seen = instances(triples, v.term("AbundanceObservation"), "id").distinct()
    seen = _properties(seen, triples, dict(taxon=v.term("observedTaxon"), time=SOSA + "resultTime", code=v.term("localSiteCode"), value=SOSA + "hasSimpleResult", unit=v.term("unit")))
    rows = seen.where("value is not null").withColumnRenamed("id", "o").withColumnRenamed("taxon", "id")
    rows = rows.withColumn("value", F.col("value").cast("double"))
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    top = top_per_group(rows, ["id"], [F.desc("value"), "time", "code", "o"], most)
    return top.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "time", "code", "value", "unit"))).alias("top")).join(counts, "id")


def nodes(triples: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """id, type, label, what else its type has, and its triples as text."""
    v = v or Vocabulary()
    out = None
    for name, rows in _kinds(triples, v).items():
        rows = rows.withColumn("type", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    sites = occurrences(triples, v).groupBy(F.col("usage").alias("id")).agg(F.sort_array(F.collect_list(F.struct(iri_tail(F.col("site")).alias("site"), "status"))).alias("sites"))
    abundance = top_abundance(triples, v).select("id", F.struct("n", "top").alias("abundance"))
    out = out.join(sites, "id", "left").join(abundance, "id", "left").join(observation_counts(triples, v), "id", "left")
    return out.join(described(triples).select(F.col("s").alias("id"), F.col("text").alias("ttl")), "id", "left")


def edges(triples: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """src, dst, rel between nodes, with presentAt from usages to sites."""
    v = v or Vocabulary()
    t = v.term

    def of(cls: str, p: str, rel: str) -> DataFrame:
        return instances(triples, _class(v, cls), "src").join(objects(triples, p, "src", "dst"), "src").select("src", "dst", F.lit(rel).alias("rel"))

    parts = [
        of("NameUsage", t("resolvesTo"), "resolvesTo"),
        of("NameUsage", PROV + "wasDerivedFrom", "wasDerivedFrom"),
        of("NameUsage", t("recordedIn"), "recordedIn"),
        of("NameUsage", t("hasAssessment"), "hasAssessment"),
        of("SamplingSite", t("inWaterbody"), "inWaterbody"),
        of("ConservationAssessment", t("assessedTaxon"), "assessedTaxon"),
        occurrences(triples, v).where("status = 'present'").select(F.col("usage").alias("src"), F.col("site").alias("dst"), F.lit("presentAt").alias("rel")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ids = instances(triples, _class(v, TYPES[0]), "id")
    for name in TYPES[1:]:
        ids = ids.unionByName(instances(triples, _class(v, name), "id"))
    return without_dangling(out, ids)


def stats(triples: DataFrame, v: Vocabulary | None = None) -> DataFrame:
    """name, n: triples, and subjects of each class."""
    v = v or Vocabulary()
    shown = [*(c for c in CLASSES if c not in ("Trait", "CurationIssue")), "Taxon"]
    name = F.when(F.col("class") == DWC + "Taxon", "Taxon").when(F.startswith(F.col("class"), F.lit(v.term(""))), iri_fragment(F.col("class")))
    counts = class_counts(triples).select(name.alias("name"), "n").where(F.col("name").isin(*shown))
    return triples.agg(F.count("*").alias("n")).select(F.lit("triples").alias("name"), "n").unionByName(counts)


def as_json(row: Column) -> Column:
    return F.to_json(row)


#: Nodes and edges that fit into one page.
PAGE_ROWS = 200_000


def write_files(triples: DataFrame, path: str, v: Vocabulary | None = None) -> None:
    """Nodes, edges and counts as JSON lines, from the executors, whatever the graph's size."""
    for name, rows in (("nodes", nodes(triples, v)), ("edges", edges(triples, v)), ("stats", stats(triples, v))):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def page(template: str, triples: DataFrame, queries: dict[str, tuple[str, DataFrame]], mark: str, v: Vocabulary | None = None, most: int = PAGE_ROWS) -> str:
    """A single-file page: the template with its mark replaced by the graph's JSON. What a browser shows has to fit into a page, so it is gathered here.

    A graph of more nodes and edges than `most` raises before anything is gathered; write_files() takes any.
    """
    from ..sources.tables import as_strings

    size = nodes(triples, v).count() + edges(triples, v).count()
    if size > most:
        raise ValueError(f"{size} nodes and edges don't fit into a page of {most}; write_files() writes them apart")
    shown = lambda df: [r[0] for r in df.select(embeddable_json(as_json(F.struct(*df.columns)))).collect()]
    counts = {r["name"]: r["n"] for r in stats(triples, v).collect()}
    links = edges(triples, v)
    parts = [
        '"stats":' + json.dumps(counts, separators=(",", ":")),
        '"nodes":[' + ",".join(shown(nodes(triples, v))) + "]",
        '"edges":[' + ",".join(r[0] for r in links.select(embeddable_json(as_json(F.array("src", "dst", "rel")))).collect()) + "]",
        '"queries":'
        + json.dumps([dict(name=n, sparql=text, header=df.columns, rows=[list(r) for r in as_strings(df).collect()]) for n, (text, df) in queries.items()], ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/"),
    ]
    return template.replace(mark, "{" + ",".join(parts) + "}")


def translated(template: str, pairs: dict[str, str]) -> str:
    """The template with texts replaced, longer ones first; each must be there."""
    missing = [k for k in pairs if k not in template]
    if missing:
        raise KeyError(f"not in the template: {missing}")
    for k in sorted(pairs, key=len, reverse=True):
        template = template.replace(k, pairs[k])
    return template
