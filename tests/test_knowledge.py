"""The graph of a small hand-built checklist, its views, the competency queries and SPARQL text."""

import pytest
from pyspark.sql import functions as F

from stemma.operators import graph
from stemma.plans import competency, explorer, knowledge, sparql
from stemma.sources.tables import REGISTRY, SCHEMAS

BASE = knowledge.BASE
HEAD = f"""
PREFIX k: <{BASE}ontology#>
PREFIX dwc: <{knowledge.DWC}>
PREFIX sosa: <{knowledge.SOSA}>
PREFIX prov: <{knowledge.PROV}>
PREFIX rdfs: <{knowledge.RDFS}>
"""


def record(source, waterbody, group, idx, canonical, **more):
    row = dict.fromkeys(c.strip().split(" ")[0].strip("`") for c in SCHEMAS["records"].split(","))
    row |= dict(
        source=source, waterbody=waterbody, group=group, idx=idx, raw_name=canonical, canonical=canonical, is_morphospecies=False, is_higher_taxon=False, status="{}", n_sites_marked=1,
        gbif_match="exact", gbif_pass=1, symbols="",
    )
    return row | more


@pytest.fixture(scope="module")
def triples(spark, tmp_path_factory):
    lake, river = "Hồ Đỏ", "Sông Xanh"
    registry = spark.createDataFrame(
        [
            dict(id="A", waterbody=lake, group="fish", year=2020, cite="c", symbol_legend={"*": "alien"}, reported={"sites": 2, "species": 3}),
            dict(id="B", waterbody=river, group="fish", year=2021, cite="d", symbol_legend={}, reported={"species": 3}),
            dict(id="P", waterbody=lake, group="phytoplankton", year=2022, cite="e", symbol_legend={}, reported={}),
        ],
        REGISTRY,
    )
    records = [
        record("A", lake, "fish", 1, "Aa bb", gbif_key=1, gbif_name="Aa bb", gbif_rank="SPECIES", status='{"IUCN_2020": "V U", "economic": "x"}'),
        record("A", lake, "fish", 2, "Cc dd", gbif_key=2, gbif_name="Cc dd", gbif_accepted="Ee ff", gbif_match="synonym", symbols="*", n_sites_marked=0),
        record("A", lake, "fish", 3, "Gg sp.", is_morphospecies=True, gbif_key=9, gbif_name="Gg"),
        record("B", river, "fish", 1, "Aa bb", gbif_key=1, gbif_name="Aa bb", status='{"IUCN_2020": "EN", "SDVN_2007": "VU"}', family_agrees=False),
        record("B", river, "fish", 2, "Ee ff", gbif_key=3, gbif_name="Ee ff", gbif_pass=2, status='{"DLDVN_2024": "CR"}'),
        record("B", river, "fish", 3, "Xx yy", gbif_key=7, gbif_name="Zz ww", gbif_match="fuzzy_rejected"),
        record("P", lake, "phytoplankton", 1, "Mm nn", gbif_key=5, gbif_name="Mm nn"),
        record("P", lake, "phytoplankton", 2, "Oo pp", gbif_key=6, gbif_name="Oo pp"),
    ]
    make = lambda rows, name, more="": spark.createDataFrame(rows, SCHEMAS[name].replace("gbif_key double", "gbif_key long").replace("gbif_confidence double", "gbif_confidence long") + more)
    tables = {
        "records": make(records, "records"),
        "presence": make([("A", 1, "M1", True), ("A", 1, "M2", False), ("A", 2, "M9", True)], "presence"),
        "sites": make([("A", lake, "M1", 13.5, 108.2, "S001"), ("A", lake, "M2", 13.6, 108.3, "S002")], "sites"),
        "abundance": make(
            [
                ("P", lake, "phytoplankton", "2021-05", "M1", "Mm nn", 120.0, "Tảo độc", "Mm nn", 5, "exact", 0),
                ("P", lake, "phytoplankton", "2021-06", "M2", "Mm nn", 30.0, "Tảo độc", "Mm nn", 5, "exact", 1),
                ("P", lake, "phytoplankton", "2021-06", "M7", "Mm nn", 500.0, "", "Mm nn", 5, "exact", 2),
                ("P", lake, "phytoplankton", "2021-06", "M1", "Mm nn", -1.0, "", "Mm nn", 5, "exact", 3),
            ],
            "abundance",
            ", row_no long",
        ),
        "water_quality": make(
            [("P", lake, "2021-05", "M1", "Chl-a (ug/L)", 2.5, 0), ("P", lake, "2021-05", "M1", "Độ trong (cm)", 80.0, 1), ("P", lake, "2021-06", "M2", "Chl-a (ug/L)", 3.5, 2)], "water_quality", ", row_no long"
        ),
    }
    out = knowledge.to_triples(tables, registry, {lake: "Hồ", river: "Sông"}, "X", aliases={"P": "A"})
    return graph.stored(out, f"{tmp_path_factory.mktemp('graph')}/triples")


@pytest.fixture(scope="module")
def views(triples):
    return knowledge.views(triples)


def rows(df):
    return [tuple(r) for r in df.collect()]


def text(df):
    return [tuple("" if x is None else str(x) for x in r) for r in rows(df)]


CASES = {
    "richness": (
        competency.richness,
        HEAD + """SELECT ?waterbody ?group (COUNT(DISTINCT ?u) AS ?records) (COUNT(DISTINCT ?name) AS ?names) {
          ?u k:isMorphospecies false ; a k:NameUsage ; k:resolvesTo ?t ; k:recordedIn ?w ; prov:wasDerivedFrom ?s . ?s k:taxonGroup ?group .
          ?w rdfs:label ?waterbody . ?t dwc:scientificName ?n OPTIONAL { ?t k:acceptedNameGBIF ?a } BIND(COALESCE(?a, ?n) AS ?name)
        } GROUP BY ?waterbody ?group ORDER BY ?waterbody ?group""",
        [("Hồ Đỏ", "fish", 2, 2), ("Hồ Đỏ", "phytoplankton", 2, 2), ("Sông Xanh", "fish", 3, 3)],
    ),
    "shared": (
        competency.shared_species,
        HEAD + """SELECT ?group ?x ?y (COUNT(DISTINCT ?name) AS ?shared) (GROUP_CONCAT(DISTINCT ?name; SEPARATOR="; ") AS ?species) WHERE {
          ?u k:isMorphospecies false ; k:resolvesTo ?t ; k:recordedIn ?w ; prov:wasDerivedFrom/k:taxonGroup ?group . ?w rdfs:label ?x .
          ?u2 k:isMorphospecies false ; k:resolvesTo ?t2 ; k:recordedIn ?w2 ; prov:wasDerivedFrom/k:taxonGroup ?group . ?w2 rdfs:label ?y .
          ?t dwc:scientificName ?n . OPTIONAL { ?t k:acceptedNameGBIF ?a } ?t2 dwc:scientificName ?n2 . OPTIONAL { ?t2 k:acceptedNameGBIF ?a2 }
          BIND(COALESCE(?a, ?n) AS ?name) FILTER(COALESCE(?a2, ?n2) = ?name) FILTER(STR(?x) < STR(?y))
        } GROUP BY ?group ?x ?y ORDER BY ?group ?x ?y""",
        [("fish", "Hồ Đỏ", "Sông Xanh", 2, "Aa bb; Ee ff")],
    ),
    "threatened": (
        competency.threatened,
        HEAD + """SELECT ?name ?wb (GROUP_CONCAT(DISTINCT CONCAT(?s, "-", ?v, ":", ?c); separator=", ") AS ?as) (GROUP_CONCAT(DISTINCT STRAFTER(STR(?src), "source/"); separator=",") AS ?by) {
          ?u k:hasAssessment ?a ; k:resolvesTo/dwc:scientificName ?name ; k:recordedIn/rdfs:label ?wb .
          ?a k:scheme ?s ; k:schemeVersion ?v ; k:category ?c ; prov:wasDerivedFrom ?src FILTER(?c IN ("CR", "EN", "VU"))
        } GROUP BY ?name ?wb ORDER BY ?name ?wb""",
        [("Aa bb", "Hồ Đỏ", "IUCN-2020:VU", "source/A"), ("Aa bb", "Sông Xanh", "IUCN-2020:EN, SDVN-2007:VU", "source/B"), ("Ee ff", "Sông Xanh", "DLDVN-2024:CR", "source/B")],
    ),
    "alien": (
        competency.alien_spread,
        HEAD + """SELECT ?name ?flag (GROUP_CONCAT(DISTINCT ?wb; separator=", ") AS ?where) (GROUP_CONCAT(DISTINCT STRAFTER(STR(?src), "source/"); separator=",") AS ?by) {
          ?u0 k:hasTrait ?trait ; k:resolvesTo ?t FILTER(?trait IN (k:InvasiveAlienSpecies, k:AlienSpecies)) BIND(STRAFTER(STR(?trait), "#") AS ?flag)
          ?u k:resolvesTo ?t ; k:recordedIn/rdfs:label ?wb ; prov:wasDerivedFrom ?src . ?t dwc:scientificName ?name
        } GROUP BY ?name ?flag ORDER BY DESC(COUNT(DISTINCT ?src)) ?name""",
        [("Cc dd", "AlienSpecies", "Hồ Đỏ", "source/A")],
    ),
    "toxic": (
        competency.toxic_densities,
        HEAD + """SELECT ?name ?time ?code ?d ?chl ?po4 ?nh4 ?clear {
          ?t k:hasTrait k:ToxicCyanobacterium ; dwc:scientificName ?name . ?o k:observedTaxon ?t ; a k:AbundanceObservation ; sosa:hasFeatureOfInterest ?s ; k:localSiteCode ?code ; sosa:resultTime ?time ; sosa:hasSimpleResult ?d .
          OPTIONAL { ?q a k:WaterQualityObservation ; sosa:hasFeatureOfInterest ?s ; sosa:resultTime ?time ; sosa:observedProperty/rdfs:label "Chl-a (ug/L)"@vi ; sosa:hasSimpleResult ?chl }
          OPTIONAL { ?q2 a k:WaterQualityObservation ; sosa:hasFeatureOfInterest ?s ; sosa:resultTime ?time ; sosa:observedProperty/rdfs:label "Photphat (mgP-PO4/L)"@vi ; sosa:hasSimpleResult ?po4 }
          OPTIONAL { ?q3 a k:WaterQualityObservation ; sosa:hasFeatureOfInterest ?s ; sosa:resultTime ?time ; sosa:observedProperty/rdfs:label "Amoni (mgN-NH4/L)"@vi ; sosa:hasSimpleResult ?nh4 }
          OPTIONAL { ?q4 a k:WaterQualityObservation ; sosa:hasFeatureOfInterest ?s ; sosa:resultTime ?time ; sosa:observedProperty/rdfs:label "Độ trong (cm)"@vi ; sosa:hasSimpleResult ?clear }
        } ORDER BY DESC(?d) LIMIT 15""",
        [("Mm nn", "2021-05", "M1", 120.0, 2.5, None, None, 80.0), ("Mm nn", "2021-06", "M2", 30.0, 3.5, None, None, None)],
    ),
    "curation": (
        competency.curation_queue,
        HEAD + """SELECT (STRAFTER(STR(?src), "source/") AS ?source) (STRAFTER(STR(?i), "#") AS ?issue) (COUNT(DISTINCT ?u) AS ?n) { ?u a k:NameUsage ; k:hasIssue ?i ; prov:wasDerivedFrom ?src }
        GROUP BY ?src ?i ORDER BY ?source ?issue""",
        [("source/A", "no_site_data", 1), ("source/A", "outdated_name", 1), ("source/B", "family_conflict", 1), ("source/B", "homonym_resolved", 1), ("source/B", "unresolved", 1)],
    ),
    "conflicts": (
        competency.assessment_conflicts,
        HEAD + """SELECT ?name ?f (GROUP_CONCAT(DISTINCT CONCAT(STRAFTER(STR(?src), "source/"), "=", ?s, "-", ?v, ":", ?c); separator=" | ") AS ?all) {
          ?a1 k:assessedTaxon ?t ; k:scheme ?s1 ; k:category ?c1 . ?a2 k:assessedTaxon ?t ; k:scheme ?s2 ; k:category ?c2 . BIND(IF(?s1 IN ("DLDVN", "SDVN"), "VN_RedList", ?s1) AS ?f)
          FILTER(IF(?s2 IN ("DLDVN", "SDVN"), "VN_RedList", ?s2) = ?f && ?c1 != ?c2)
          ?a k:assessedTaxon ?t ; k:scheme ?s ; k:schemeVersion ?v ; k:category ?c ; prov:wasDerivedFrom ?src . FILTER(IF(?s IN ("DLDVN", "SDVN"), "VN_RedList", ?s) = ?f) ?t dwc:scientificName ?name
        } GROUP BY ?name ?f ORDER BY ?name""",
        [("Aa bb", "IUCN", "source/A=IUCN-2020:VU | source/B=IUCN-2020:EN")],
    ),
    "matrix": (
        lambda v: competency.not_in_matrix(v, f"{BASE}resource/source/P"),
        HEAD + f"""SELECT ?name {{ ?u prov:wasDerivedFrom <{BASE}resource/source/P> ; a k:NameUsage ; k:resolvesTo ?t ; k:isMorphospecies false . ?t dwc:scientificName ?name
          FILTER NOT EXISTS {{ ?o k:observedTaxon ?t ; a k:AbundanceObservation ; k:taxonGroup "phytoplankton" }} }} ORDER BY ?name""",
        [("Oo pp",)],
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_competency_query(views, triples, case):
    plan, query, expected = CASES[case]
    assert rows(plan(views)) == expected
    assert text(sparql.run_query(query, triples)) == [tuple("" if x is None else str(x) for x in r) for r in expected]


def test_triples_are_a_set(triples):
    assert triples.count() == triples.distinct().count()
    counts = dict(rows(graph.class_counts(triples)))
    assert counts[f"{BASE}ontology#NameUsage"] == 8 and counts[f"{BASE}ontology#SiteOccurrence"] == 2
    # A rejected name stays local yet carries the authority's name.
    local = triples.where(F.col("s") == f"{BASE}resource/taxon/Xx_yy")
    assert [r["o"] for r in local.where(F.col("p") == knowledge.DWC + "scientificName").collect()] == ["Zz ww"]


def test_more_of_the_language(triples):
    assert text(sparql.run_query(HEAD + 'SELECT DISTINCT ?c { { ?a k:category ?c } UNION { ?a k:scheme ?c } FILTER(STRLEN(?c) > 2) } ORDER BY ?c LIMIT 2', triples)) == [("DLDVN",), ("IUCN",)]
    assert text(sparql.run_query(HEAD + "SELECT (COUNT(*) AS ?n) { ?u a k:NameUsage }", triples)) == [("8",)]
    assert text(sparql.run_query(HEAD + "SELECT ?s (COUNT(?u) AS ?n) { ?u prov:wasDerivedFrom ?s ; a k:NameUsage } GROUP BY ?s HAVING (COUNT(?u) > 2) ORDER BY DESC(?n) ?s", triples)) == [
        (f"{BASE}resource/source/A", "3"),
        (f"{BASE}resource/source/B", "3"),
    ]


@pytest.fixture(scope="module")
def small(spark):
    iri = lambda s, p, o: (s, p, o, "iri", None, None)
    word = lambda s, p, o, lang=None: (s, p, o, "literal", None, lang)
    rows = [iri(f"{s}{i}", p, f"{o}{i}") for i in range(4) for s, p, o in (("a", "p", "b"), ("b", "r", "c"), ("c", "q", "d"))]
    rows += [word("a0", "n", "x", "en"), word("a1", "n", "x", "vi"), word("a2", "m", "x", "en"), iri("a3", "t", "b1"), iri("a0", "t", "b0"), iri("a0", "z", "one")]
    return spark.createDataFrame(rows, graph.TRIPLE)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_join_by_shared_variables(small):
    out = sparql.run_query("SELECT ?a ?d { ?a <p> ?b . ?c <q> ?d . ?b <r> ?c }", small)
    assert text(out.orderBy("a")) == [(f"a{i}", f"d{i}") for i in range(4)]
    assert "Cartesian" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_optional_variables_join_on_equal_keys(small):
    out = sparql.run_query("SELECT ?a ?b ?c { ?a <p> ?x OPTIONAL { ?a <t> ?b } ?b <r> ?c }", small)
    # a1 and a2 leave ?b unbound, so it takes any value.
    want = [("a0", "b0", "c0"), ("a3", "b1", "c1"), *((a, f"b{i}", f"c{i}") for a in ("a1", "a2") for i in range(4))]
    assert sorted(text(out)) == sorted(want)
    joined = sparql.run_query("SELECT ?a ?b { ?a <p> ?x OPTIONAL { ?a <t> ?b } ?a <p> ?b }", small)
    assert sorted(text(joined)) == [("a0", "b0"), ("a1", "b1"), ("a2", "b2")]
    assert "Cartesian" not in plan_of(joined) and "NestedLoop" not in plan_of(joined)


def test_not_exists(small):
    assert len(text(sparql.run_query("SELECT ?a { ?a <p> ?b FILTER NOT EXISTS { <a0> <z> <two> } }", small))) == 4
    assert text(sparql.run_query("SELECT ?a { ?a <p> ?b FILTER NOT EXISTS { ?q <z> <one> } }", small)) == []
    assert len(text(sparql.run_query("SELECT ?a { ?a <p> ?b FILTER EXISTS { ?q <z> <one> } }", small))) == 4
    # Texts of two languages are two values.
    assert text(sparql.run_query("SELECT ?a { ?a <n> ?x FILTER NOT EXISTS { ?b <m> ?x } }", small)) == [("a1",)]


def test_explorer(triples, spark):
    nodes, edges = explorer.nodes(triples), explorer.edges(triples)
    assert {r["type"] for r in nodes.select("type").distinct().collect()} == {"NameUsage", "Taxon", "SourceDocument", "Waterbody", "SamplingSite", "ConservationAssessment"}
    assert edges.where("rel = 'presentAt'").count() == 1
    near = graph.neighbourhood(edges, spark.createDataFrame([(f"{BASE}resource/usage/A/1",)], "id string"), 1)
    assert near.count() == 1 + 5
    page = explorer.page("<script>__DATA__</script>", triples, {"q": ("SELECT", competency.curation_queue(knowledge.views(triples)))}, "__DATA__")
    assert '"SiteOccurrence":2' in page and "</script>" == page[-9:] and page.count("</") == 1
