import pytest
from pyspark.sql import functions as F

from stemma.functions import names, numbers
from stemma.functions import text as tx


def one(spark, *columns, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return tuple(row.select(*columns).first())


@pytest.mark.parametrize(
    "raw, canonical, more",
    [
        ("Anabaena spiroides Klebahn, 1895", "Anabaena spiroides", dict(authorship="Klebahn, 1895", year=1895, is_morphospecies=False)),
        ("Acentrella sp. ", "Acentrella sp.", dict(is_morphospecies=True, epithet=None)),
        ("Baetis sp1", "Baetis sp.1", dict(is_morphospecies=True)),
        ("Copepoda nauplius", "Copepoda", dict(is_higher_taxon=True, notes=["life_stage:nauplius"])),
        ("Bivalvia", "Bivalvia", dict(is_higher_taxon=True)),
        ("Brachionus calyciflorus calyciflorus Pallas, 1766", "Brachionus calyciflorus", dict(infra="calyciflorus", notes=["nominotypical_subspecies"])),
        ("Tetraëdron minimum (A. Braun) Hansgirg, 1888 1,2,3", "Tetraedron minimum", dict(year=1888, notes=["diacritic_in_latin"])),
        ("Cyprinus cf. carpio Linnaeus, 1758●", "Cyprinus carpio", dict(qualifier="cf.", symbols="●")),
        ("Channa micropeltes (Cuvier", "Channa micropeltes", dict(notes=["authorship_without_year", "unbalanced_parenthesis"])),
        ("Poropuntius deauratus de Silva, 1900", "Poropuntius deauratus", dict(authorship="de Silva, 1900")),
        ("Keratella tropica f. aspina (Fric, 1885)", "Keratella tropica aspina", dict(infra="aspina")),
        ("??", "??", dict(is_higher_taxon=True)),
    ],
)
def test_names(raw, canonical, more):
    parsed = names.parse_name(raw)
    assert parsed.canonical == canonical
    for k, v in more.items():
        assert getattr(parsed, k) == v


def test_names_as_column(spark):
    rows = spark.createDataFrame([("Cyprinus carpio Linnaeus, 1758",), ("Cyprinus carpio Linnaeus, 1758",), ("Aa sp. 12",)], "raw string").select(names.parse(F.col("raw")).alias("n"))
    assert [(r["canonical"], r["year"], r["is_morphospecies"]) for r in rows.select("n.*").collect()] == [("Cyprinus carpio", 1758, False)] * 2 + [("Aa sp.12", None, True)]


def test_keys_and_classes(spark):
    name = F.struct(F.lit("Aa sp.").alias("canonical"), F.lit("Aa").alias("genus"), F.lit(True).alias("is_morphospecies"), F.lit(False).alias("is_higher_taxon"))
    assert one(spark, names.query_key(name), names.hinted_key(name, F.lit("BETIDAE"), F.lit("Ephe optera"), F.lit("fish"))) == ("Aa|GENUS", "Aa|GENUS|family=Betidae|kingdom=Animalia")
    answer = lambda m, r, s: F.struct(F.lit(m).alias("matchType"), F.lit(r).alias("rank"), F.lit(s).alias("status"))
    classes = [names.match_class(answer(*a), F.lit(o)) for a, o in ((("EXACT", "SPECIES", "ACCEPTED"), False), (("HIGHERRANK", "GENUS", "ACCEPTED"), False), (("HIGHERRANK", "GENUS", "ACCEPTED"), True), (("EXACT", "FAMILY", "ACCEPTED"), True), (("FUZZY", "SPECIES", "SYNONYM"), False), (("FUZZY", "SPECIES", "ACCEPTED"), False), (("ERROR", None, None), False), ((None, None, None), False))]
    assert one(spark, *classes) == ("exact", "higherrank", "exact", "higherrank", "synonym", "fuzzy", "none", "none")


def test_similarity_and_guard(spark):
    pairs = [("Chlorellaceae", "Sphaerocystidaceae", 0.387), ("Euglenaceae", "Phacidae", 0.421), (None, None, 1.0), ("Cyprinidae", "CYPRINIDAE", 1.0)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in rows.select(names.similarity(F.col("a"), F.col("b"))).collect()] == [x for *_, x in pairs]
    assert one(spark, names.guarded_match(F.lit("fuzzy"), F.lit(False), F.lit(0.5)), names.guarded_match(F.lit("fuzzy"), F.lit(None), F.lit(0.5)), names.guarded_match(F.lit("exact"), F.lit(False), F.lit(0.5))) == ("fuzzy_rejected", "fuzzy", "exact")
    kinds = [names.conflict_kind(F.lit(a), F.lit(b), F.lit(r), F.lit(m)) for a, b, r, m in (("A b", "C", 0.9, "exact"), ("Abcdea", "Abcdef", 0.9, "fuzzy_rejected"), ("Abcdea", "Abcdef", 0.9, "exact"), ("Abcdea", "Xbcdef", 0.9, "exact"))]
    assert one(spark, *kinds) == ("glyph_unrepaired", "rejected_fuzzy", "spelling_variant", "classification")


def test_gap_pattern(spark):
    assert one(spark, *(names.gap_pattern(F.lit(x)) for x in ("Arce inida", "F scu ariaceae", "Whole", "A 1b"))) == ("^arce[a-z]{1,4}inida$", "^f[a-z]{1,4}scu[a-z]{1,4}ariaceae$", None, None)


@pytest.mark.parametrize(
    "line, marker, found",
    [
        ("Ngành Chordata", "", ("phylum", "Chordata")),
        ("Họ Cá chép - Cyprinidae", "", ("family", "Cyprinidae")),
        ("BỘ CYPRINIFORMES", "", ("order", "CYPRINIFORMES")),
        ("Arce   inida", "", ("order", "Arce inida")),
        ("Lớp cá (Actinopterygii)", "", ("class", "Actinopterygii")),
        ("Unknownus", "IV", ("order", "Unknownus")),
        ("Unknownus", "(3)", ("family", "Unknownus")),
        ("Unknownus", "", None),
        ("12 loài", "", None),
    ],
)
def test_ranks(line, marker, found):
    assert names.rank_and_name(line, marker) == found


def test_text(spark):
    damaged = "B{ng x|y [12] {z ~ a{|"
    assert one(spark, tx.repair_glyphs(F.lit(damaged)), tx.glyph_repairs(F.lit(damaged))) == ("Bàng xáy [12] àz ~ aà|", 4)
    assert one(spark, tx.fold(F.lit("Hồ Đỏ é")), tx.slug(F.lit(" Hồ Đỏ--(x) ")), tx.squeeze(F.lit("\xa0a \t b ")), tx.nfc(F.lit("é"))) == ("Ho Đo e", "Ho_Do_x", "a b", "é")
    assert one(spark, tx.str_after(F.lit("a/resource/source/X"), "source/"), tx.str_after(F.lit("a"), "b"), tx.iri_tail(F.lit("a/b/c")), tx.iri_fragment(F.lit("a#b"))) == ("source/X", "", "c", "b")
    assert one(spark, *tx.head_and_rest(F.lit("IUCN_2020_x")), *tx.head_and_rest(F.lit("PL")), tx.symbols_in(F.lit("a●*b")), tx.without_symbols(F.lit("a●*b"))) == ("IUCN", "2020_x", "PL", "", "●*", "ab")
    assert one(spark, tx.unescape(F.lit("a&amp;b")), tx.embeddable_json(F.lit("</x>"))) == ("a&b", "<\\/x>")
    assert tx.runs_of_fields("  ab cd   e  ") == [(2, 7, "ab cd"), (10, 11, "e")]


def test_numbers(spark):
    cells = ["1.234", "0,5", "*", "+", "", "0", "abc", " 7 "]
    assert one(spark, *(numbers.cell_value(F.lit(c)) for c in cells)) == (1234.0, 0.5, -1.0, -1.0, None, None, None, 7.0)
    assert one(spark, numbers.decimal_comma(F.lit("2,5")), numbers.decimal_comma(F.lit("<2")), numbers.campaign(F.lit("Bảng 1: tháng 5 năm 2021")), numbers.campaign(F.lit("x")), numbers.year(F.lit("a 1699 1758"))) == (2.5, None, "2021-05", None, 1758)
    lat, lon = one(spark, numbers.position(F.lit("108°15'20,1  13° 35'40.6"))).__iter__().__next__()
    assert (lat, lon) == (13.594611, 108.255583)
    assert one(spark, numbers.position(F.lit("13°35'40.6"))) == (None,)
    metres = one(spark, numbers.haversine_m(F.lit(13.594611), F.lit(108.255583), F.lit(13.610333), F.lit(108.259556)))[0]
    assert abs(metres - 1800.1) < 1
    assert one(spark, numbers.half_even(F.lit(0.8125)), names.scoring_name(F.lit("Aa sp.12"))) == (0.812, "Aa sp.")
    assert sorted(one(spark, names.binomials(F.lit("Tên loài Cyprinus carpio và Baetis sp. 2, Cyprinus carpio; Xy ab")))[0]) == ["Baetis sp.", "Cyprinus carpio"]
