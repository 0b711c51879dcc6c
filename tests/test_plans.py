"""From printed lines to reconciled tables and reports, on a small invented checklist."""

import io
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from stemma import checklist_queries, queries
from stemma.plans import checklist, reports, segmentation
from stemma.sources import documents, tables, triples

LINES = """BÁO CÁO
Bảng 2. Danh sách loài
STT  Tên khoa học            M1   M2   M3
     Ngành Chordata
     Bộ Cá chép - Cypriniformes
     Họ Cá chép - Cyprinidae
1    Cyprinus carpio Linnaeus, 1758      +    -    +
     Barbodes binotatus
2                                 +    +    -
     Họ Cobi idae
3    Cobitis taenia L.        +
     x wrapped
4    Misgurnus sp.        -    -    +
     Tổng số      3    1    2   9   9
5    Not Read
""".splitlines()


@pytest.fixture(scope="module")
def registry(spark):
    rows = [dict(id="A", file="a.txt", kind="pdf", waterbody="Hồ", group="fish", year=2020, cite="c", table="Bảng 2", status_cols={}, symbol_legend={"*": "alien"}, symbol_abstract={"alien": 0}, status_footer={}, blank_means_absent=True, reported={"sites": 3, "species": 4, "family": 2})]
    return spark.createDataFrame(rows, tables.REGISTRY)


@pytest.fixture(scope="module")
def segments(spark, registry):
    lines = spark.createDataFrame([("a.txt", i, x) for i, x in enumerate(LINES)], "doc_id string, line_no int, line string")
    return segmentation.segmented_lines(lines, registry).cache()


def test_segmentation(segments):
    rows = {r["idx"]: r for r in segments.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert rows[1]["hierarchy"] == {"phylum": "Chordata", "order": "Cypriniformes", "family": "Cyprinidae"}
    assert rows[1]["sites"] == {"M1": "+", "M2": "-", "M3": "+"} and " ".join(rows[2]["name_parts"]) == "Barbodes binotatus"
    assert rows[3]["hierarchy"]["family"] == "Cobi idae" and rows[3]["sites"] == {"M1": "+"} and rows[3]["name_parts"][-1] == "x wrapped"
    assert rows[1]["totals"] == [3, 1, 2, 9, 9]


def test_statuses_and_names_in_cells():
    rows = [["STT", "Tên", "M1", "M2"], ["", "Họ Cyprinidae", "", ""], ["1", "Cyprinus carpio", "+", "-"], ["2", "Carassius auratus", "x", ""]]
    records = segmentation.read_cells(rows)
    assert [(r["idx"], r["sites"], r["hierarchy"]) for r in records] == [(1, {"M1": "+", "M2": "-"}, {"family": "Cyprinidae"}), (2, {"M1": "+"}, {"family": "Cyprinidae"})]
    assert segmentation.read_cells([]) == [] and segmentation.read_cells([["STT", "M1"]]) == []
    lines = ["Bảng 1", "          (1)     (2)     (3)", "1    Cyprinus carpio  VU     x", "2    Danio rerio  Cá ngựa     EN"]
    records, totals = segmentation.read_table(lines, "Bảng 1", {"(1)": "IUCN_2020", "(2)": "B", "(3)": "C"})
    assert records[1]["vn_name"] == "Cá ngựa" and "EN" in records[1]["status"].values() and totals is None
    assert segmentation.read_table(lines, "Bảng 9") == ([], None) == segmentation.read_table([], "Bảng")


def test_lines_have_kinds():
    prose = "đây là một dòng văn bản rất dài để kết thúc bảng này"
    lines = ["Bảng 1", " " * 40 + "M1  M2  M3", "BÁO CÁO KHOA HỌC", "     Họ Cá chép - Cyprinidae", "12", "1  Cyprinus carpio  +", "   wrapped", "     Barbodes binotatus", " 2 ", prose, "3  Danio rerio", prose, prose, "4  Not Read"]
    t, totals = segmentation.line_table(lines, "Bảng 1", {})
    assert t["kind"].tolist() == ["header", "noise", "heading", "noise", "row", "piece", "lead", "row", "prose", "row", "prose"] and totals is None
    assert t["record"].tolist() == [0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    assert t["hierarchy"].iloc[-1] == {"family": "Cyprinidae"}


def test_indices_of_over_three_digits():
    rows = [f"{i:<8}Danio rerio  Cá {i}" for i in range(1, 1003)]
    lines = ["Bảng 1", *rows, "     1822 Bloch", " 17 ", "     Barbodes binotatus", "1003", "1003", "1004    Cyprinus carpio", "     1790 Bloch", "     Tổng số", "1005  Not Read"]
    records, _ = segmentation.read_table(lines, "Bảng 1")
    assert [r["idx"] for r in records] == list(range(1, 1005)) and records[998]["name_parts"] == ["Danio rerio"]
    assert [r["name_parts"] for r in records[1001:]] == [["Danio rerio", "1822 Bloch"], ["Barbodes binotatus"], ["Cyprinus carpio", "1790 Bloch"]]


def test_segmented_query_beyond_three_digits(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS p_partkey, 'old bolt' AS p_name, 'B' AS p_brand, 'LARGE' AS p_type, (i % 50)::INT AS p_size FROM range(10005) r(i)) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = queries.QUERIES["segment_lines"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['segment_lines']})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) == 999
    every = segmentation.segmented_lines(checklist_queries._printed(spark, str(tmp_path)), checklist_queries._documents(spark, str(tmp_path)))
    assert sorted(r["idx"] for r in every.collect()) == list(range(1, 10006))


def answers(spark):
    a = lambda key, name, rank="SPECIES", status="ACCEPTED", match="EXACT", family=None, n=1, species=None: (key, (n, name, rank, status, match, 90, species, "Animalia", "Chordata", None, "Cypriniformes", family, None))
    rows = [
        a("Cyprinus carpio|SPECIES", "Cyprinus carpio", family="Cyprinidae"),
        a("Barbodes binotatus|SPECIES", "Puntius binotatus", status="SYNONYM", family="Cyprinidae", n=2, species="Barbodes x"),
        a("Cobitis taenia|SPECIES", "Animalia", rank="KINGDOM", match="HIGHERRANK", n=3),
        a("Cobitis taenia|SPECIES|order=Cypriniformes|kingdom=Animalia", "Cobitis taenia", family="Cobitidae", n=4),
        a("Misgurnus|GENUS", "Misgurnus", rank="GENUS", family="Cobitidae", n=5),
    ]
    return spark.createDataFrame(rows, f"cache_key string, answer {tables.ANSWER}")


@pytest.fixture(scope="module")
def records(spark, segments, registry):
    out, fixes = checklist.reconcile(segments, registry, answers(spark))
    assert [tuple(r) for r in fixes.select("rank", "damaged", "repaired").collect()] == [("family", "Cobi idae", "Cobitidae")]
    return out.cache()


def test_reconciliation(records):
    rows = {r["idx"]: r for r in records.collect()}
    assert [rows[i]["gbif_match"] for i in (1, 2, 3, 4)] == ["exact", "synonym", "exact", "exact"]
    assert rows[3]["gbif_pass"] == 2 and rows[3]["src_family"] == "Cobitidae" and rows[3]["family_agrees"] and rows[2]["gbif_accepted"] == "Barbodes x"
    assert rows[4]["is_morphospecies"] and rows[1]["year"] == 1758


def test_reports(spark, records, segments, registry):
    meta = spark.createDataFrame([("A", 2, "[3, 1, 2, 9, 9]")], tables.SCHEMAS["meta"])
    counts = reports.completeness(records, registry, meta).first()
    assert (counts["records_extracted"], counts["family_extracted"], counts["genus_extracted"], counts["species_reported"]) == (4, 2, 4, 4)
    presence = checklist.presence_table(segments, registry)
    assert presence.count() == 12
    totals = reports.site_totals(presence, records, registry, meta).first()
    assert totals["recomputed"] == [3, 1, 2] and totals["site_totals_matched"] == 3 and totals["cells"] == 12
    e4 = reports.resolution(records).first()
    assert (e4["exact"], e4["synonym"], e4["resolved_2nd_pass"]) == (3, 1, 1)
    assert {r["canonical"] for r in reports.name_issues(records).collect()} == {"Barbodes binotatus", "Cobitis taenia"}
    assert reports.family_conflicts(records).count() == 0
    other = records.withColumn("source", F.lit("B")).withColumn("waterbody", F.lit("Sông")).withColumn("canonical", F.when(F.col("idx") == 2, "Barbodes x").otherwise(F.col("canonical"))).withColumn("status", F.lit('{"IUCN_1": "VU"}'))
    both = records.unionByName(other)
    across = reports.across_sources(both)
    assert across.count() == 3 and not any(r["iucn_conflict"] for r in across.collect())
    pairs = spark.createDataFrame([("fish", "Hồ", "Sông")], "group string, a string, b string")
    e7 = {r["names"]: (r["shared"], r["sorensen"], r["gained_by_reconciliation"]) for r in reports.overlap(both, pairs).collect()}
    assert e7["canonical"] == (2, 0.667, None) and e7["accepted"] == (3, 1.0, ["Barbodes x"])
    assert reports.status_totals(records, registry).first()["match"]
    rendered = segments.withColumn("render", F.lit("layout"))
    assert reports.rendering_totals(rendered, registry).first()["site_totals_matched"] == 3
    found = records.select("source", F.lit("full").alias("variant"), F.col("canonical").alias("name"))
    assert reports.verbatim(found, spark.createDataFrame([("A", " ".join(LINES))], "source string, text string")).first()["canonical_found_verbatim"] == 4


def test_abundance_and_water(spark, records):
    rows = [
        ("p", 1, 0, ["TT", "Tên", "M1", "M2", "Ghi chú"], "Bảng 1: thực vật nổi tháng 5 năm 2021"),
        ("p", 1, 1, ["1", "Cyprinus carpio L", "1.200", "*", "Tảo độc"], "Bảng 1: thực vật nổi tháng 5 năm 2021"),
        ("p", 1, 2, ["2", "Other name", "0", "2,5", ""], "Bảng 1: thực vật nổi tháng 5 năm 2021"),
        ("p", 2, 0, ["TT", "P", "M1"], "tháng 6 năm 2021"),
        ("p", 2, 1, ["1", "pH", "7,5"], "tháng 6 năm 2021"),
    ]
    cells = spark.createDataFrame(rows, "doc_id string, block int, row_no int, cells array<string>, caption string")
    out = checklist.abundance_table(cells, "P", "Hồ")
    assert sorted((r["raw_name"], r["site"], r["value"], r["trait"], r["campaign"]) for r in out.collect()) == [("Cyprinus carpio L", "M1", 1200.0, "Tảo độc", "2021-05"), ("Cyprinus carpio L", "M2", -1.0, "Tảo độc", "2021-05"), ("Other name", "M2", 2.5, "", "2021-05")]
    keyed = {r["raw_name"]: (r["gbif_key"], r["gbif_match"]) for r in checklist.resolved_abundance(out, records, answers(spark)).collect()}
    assert keyed == {"Cyprinus carpio L": (1, "exact"), "Other name": (None, "none")}
    water = checklist.water_table(cells.where("block = 2"), "P", "Hồ")
    assert [(r["parameter"], r["value"], r["campaign"]) for r in water.collect()] == [("pH", 7.5, "2021-06")]


def test_sites(spark):
    lines = [("A", "Hồ", i, x) for i, x in enumerate(["M1  108°15'20,1  13°35'40,6", "M2  108°15'20,2  13°35'40,7", "M3  108°20'0  13°40'0", "text M4"])]
    sites = checklist.site_table(spark.createDataFrame(lines, "source string, waterbody string, line_no int, line string"))
    out = checklist.clustered_sites(sites, ["source", "line_no"])
    assert sorted((r["site"], r["site_uid"]) for r in out.collect()) == [("M1", "S001"), ("M2", "S001"), ("M3", "S002")]


def test_scores(spark):
    predicted = spark.createDataFrame([("A", "m", "Aa bb"), ("A", "m", "Xx yy"), ("A", "n", "Zz zz")], "source string, method string, name string")
    gold = spark.createDataFrame([("A", "Aa bb"), ("A", "Cc sp.1"), ("A", "Cc sp.2")], "source string, name string")
    out = {r["method"]: (r["n_pred"], r["n_gold"], r["P"], r["R"], r["F1"]) for r in reports.name_scores(predicted, gold).collect()}
    assert out == {"m": (2, 2, 0.5, 0.5, 0.5), "n": (1, 2, 0.0, 0.0, 0.0)}
    assert {r["method"]: r["P"] for r in reports.mean_scores(reports.name_scores(predicted, gold)).collect()} == {"m": 0.5, "n": 0.0}


def test_word_boxes(spark):
    xml = '<page width="1"><word xMin="24.0" yMin="10.0" xMax="40.0" yMax="1">A&amp;b</word><word xMin="43.0" yMin="11.0" xMax="60.0" yMax="1">c</word><word xMin="120.0" yMin="12.0" xMax="130.0" yMax="1">+</word><word xMin="2.4" yMin="30.0" xMax="3" yMax="1">z</word></page>'
    boxes = documents.word_boxes(spark.createDataFrame([("d", xml)], "doc_id string, xml string"))
    lines = [r["line"] for r in documents.on_grid(boxes).orderBy("page", "line_no").collect()]
    assert lines == [" " * 10 + "A&b c" + " " * 35 + "+", " z"]


def test_grid_equals_a_plain_version(spark):
    rng = random.Random(4)
    boxes = [("d", page, rng.randint(0, 300) / 2, 10.0 * rng.randint(1, 6) + rng.choice([0, 0, 1.5, 2.5, 3]), w) for page in (1, 2) for w in (f"w{k}" * rng.randint(1, 5) for k in range(60))]
    rows = [(d, p, x, y, x + 3.0 * len(w), w) for d, p, x, y, w in boxes]
    out = documents.on_grid(spark.createDataFrame(rows, "doc_id string, page int, x double, y double, x2 double, word string"))
    want = []
    for page in (1, 2):
        tops, held = [], []
        for y, x, x2, w in sorted((y, x, x2, w) for _, p, x, y, x2, w in rows if p == page):
            if not tops or y - tops[-1] >= 2.5:
                tops.append(y)
                held.append([])
            held[-1].append((x, x2, w))
        for n, words in enumerate(held):
            text, end = "", None
            for x, x2, w in sorted(words):
                text += f" {w}" if end is not None and x - end < 4.5 else " " * (max(round(x / 2.4), len(text) + 2 if text else 0) - len(text)) + w
                end = x2
            want.append(("d", page, n, text))
    assert sorted(tuple(r) for r in out.collect()) == want


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = f"<w:document {w}><w:body>{p('Bảng 1. x')}<w:tbl>{row('STT', 'M1')}{row('1', 'Aa bb')}</w:tbl>{p('text')}<w:tbl>{row('Bảng 2. y', '')}{row('2', 'c')}</w:tbl></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    blocks = documents.read_docx(spark, str(tmp_path / "d.docx"))
    rows = [(r["table_no"], r["cells"], r["caption"]) for r in documents.with_captions(blocks).orderBy("block", "row_no").collect()]
    assert rows == [(0, ["STT", "M1"], "Bảng 1. x"), (0, ["1", "Aa bb"], "Bảng 1. x"), (1, ["2", "c"], "Bảng 2. y")]


def test_triple_files(spark, tmp_path):
    text = '@prefix k: <http://k/> .\n# note\nk:a a k:C ; k:p "x\\ty"@vi , 5 , 2.5, true ; k:q "d"^^k:t .\nk:b k:p """long "text\n""" .'
    (tmp_path / "t.ttl").write_text(text)
    rows = triples.read_turtle(spark, str(tmp_path / "t.ttl"))
    assert rows.count() == 7
    triples.write_ntriples(rows, str(tmp_path / "nt"))
    again = triples.read_ntriples(spark, str(tmp_path / "nt"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.collect()}


def test_csv_nulls(spark, tmp_path):
    (tmp_path / "meta.csv").write_text('source,glyph_fixes,totals_row\nA,0,"[1, 2]"\nB,3,null\nC,,\n')
    rows = {r["source"]: (r["glyph_fixes"], r["totals_row"]) for r in tables.read_csv(spark, str(tmp_path / "meta.csv"), "meta", "null").collect()}
    assert rows == {"A": (0, "[1, 2]"), "B": (3, None), "C": (None, None)}
    known = answers(spark)
    keys = spark.createDataFrame([("Misgurnus|GENUS",), ("new|SPECIES",)], "cache_key string")
    missing = tables.unanswered(keys, known)
    assert [r[0] for r in missing.collect()] == ["new|SPECIES"]

    def ask(key):
        if key.startswith("new"):
            return '{"matchType": "EXACT", "usageKey": 7}'
        raise OSError

    got = {r["cache_key"]: r["answer"]["matchType"] for r in tables.fetched(keys, ask, attempts=2, pause=0.0).collect()}
    assert got == {"Misgurnus|GENUS": "ERROR", "new|SPECIES": "EXACT"}


def test_regex_baseline_and_merging(spark, registry, records, segments):
    lines = spark.createDataFrame([("A", i, x) for i, x in enumerate(["Xxx yyy outside", *LINES, "Bảng 3. next", "Zzz zzz"])], "source string, line_no int, line string")
    predicted = reports.regex_predictions(lines, registry, "m")
    assert {r["name"] for r in predicted.collect()} >= {"Cyprinus carpio", "Barbodes binotatus", "Cobitis taenia", "Misgurnus sp."}
    assert not {"Zzz zzz", "Xxx yyy"} & {r["name"] for r in predicted.collect()}
    bare = reports.regex_predictions(lines.where("line_no <> 2"), registry, "m")
    assert {"Zzz zzz", "Xxx yyy"} <= {r["name"] for r in bare.collect()}
    rows = records.select("source", F.lit("full").alias("variant"), F.col("idx").alias("n"), "raw_name", F.col("canonical").alias("name"))
    out = reports.merging(rows.unionByName(rows.where("n > 1").withColumn("variant", F.lit("part"))), rows.select("source", "n", "name"))
    assert sorted((r["variant"], r["records"], r["names_equal_reference"], r["records_without_binomial"]) for r in out.collect()) == [("full", 4, 4, 0), ("part", 3, None, 0)]


def test_template_translation():
    from stemma.plans import explorer

    assert explorer.translated("ab abc", {"ab": "x", "abc": "y"}) == "x y"
    with pytest.raises(KeyError):
        explorer.translated("ab", {"z": "y"})



def compound_file(streams):
    """A compound binary file: streams of 4096 bytes and more in sectors, smaller ones in the mini stream."""
    import struct

    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    sectors, fat = [b"", b"", b""], [0xFFFFFFFD, end, end]  # the table itself, the directory, the mini table
    mini, mini_fat, entries = b"", [], []

    def put(data):
        start = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        sectors.extend(parts)
        fat.extend([*range(start + 1, start + len(parts)), end])
        return start

    for name, data in streams.items():
        if len(data) >= 4096:
            entries.append((name, 2, put(data), len(data)))
        else:
            n = -(-len(data) // 64)
            entries.append((name, 2, len(mini_fat), len(data)))
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), end]
            mini += data.ljust(64 * n, b"\0")
    entries.insert(0, ("Root Entry", 5, put(mini) if mini else end, len(mini)))
    directory = b"".join(n.encode("utf-16le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(n) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", start, size) for n, kind, start, size in entries)
    sectors[0] = struct.pack("<128I", *fat, *[free] * (128 - len(fat)))
    sectors[1] = directory.ljust(512, b"\0")
    sectors[2] = struct.pack("<128I", *mini_fat, *[free] * (128 - len(mini_fat)))
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<6I", 1, 1, 0, 4096, 2, 1) + struct.pack("<2I", end, 0)
    return header + struct.pack("<109I", 0, *[free] * 108) + b"".join(sectors)


def test_word97(spark, tmp_path):
    import struct

    texts = "plain caf\xe9\r", "Hồ\x07"
    main = bytearray(5000)
    struct.pack_into("<H", main, 10, 0x200)
    struct.pack_into("<H", main, 32, 14)
    struct.pack_into("<H", main, 62, 22)
    struct.pack_into("<H", main, 152, 93)
    pieces = struct.pack("<3I", 0, len(texts[0]), len(texts[0]) + len(texts[1]))
    pieces += b"\0\0" + struct.pack("<I", 0x40000000 | 2 * 2000) + b"\0\0" + b"\0\0" + struct.pack("<I", 3000) + b"\0\0"
    table = b"\1" + struct.pack("<H", 3) + b"abc" + b"\2" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 154 + 33 * 8, 0, len(table))
    main[2000 : 2000 + len(texts[0])] = texts[0].encode("cp1252")
    main[3000 : 3000 + 2 * len(texts[1])] = texts[1].encode("utf-16le")
    (tmp_path / "a.doc").write_bytes(compound_file({"WordDocument": bytes(main), "1Table": table}))
    assert [r["text"] for r in documents.read_word97(spark, str(tmp_path / "a.doc")).collect()] == ["plain café\nHồ\t|"]
    with pytest.raises(ValueError):
        documents.CompoundFile(b"x" * 600)
