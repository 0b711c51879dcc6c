"""The pipeline against its stages in plain Python, and the queries against their SQL."""

import random

import brute
import corpus_pipeline
import duckdb
import pytest

from stemma.llm import packing, quality, queries

ROWS = 240


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, prose(20)) for k in range(5)]
    texts = []
    for i in range(ROWS):
        lines = [prose(rng.randint(20, 50)) for _ in range(4)]
        if i % 6 == 0:
            lines = [" ".join(w + "$$$" for w in x.split(" ")) for x in lines]
        if i % 7 == 1:
            lines[1] = items[i % 5][1]
        if i % 9 == 2:
            lines[2] += f" mail a{i}@b.org or +1 743 555 {1000 + i}"
        texts.append("\n".join(lines))
    for i in range(0, ROWS, 8):
        texts[i + 3] = texts[1 + i % 5]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s", None), (901, "", None, None, 0), (902, texts[2] + " tail", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(ROWS)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, items


def test_stages(spark, tables):
    d, rows, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    field = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r["doc_id"] for r in quality.quality(docs, field).where("kept").collect()}
    now = [(i, t) for i, t, *_ in rows if i in good]
    assert 100 < len(now) < ROWS
    classes = brute.near_duplicates(now)
    now = [(i, t) for i, t in now if classes[i][0] == i]
    leaks = {x[0] for x in brute.contained(now, items)}
    now = [(i, t) for i, t in now if i not in leaks]
    assert leaks and len(now) < len(classes)

    def masked(t):
        out, at = "", 0
        for a, b, kind in brute.personal_data(t):
            out, at = f"{out}{t[at:a]}<{kind.upper()}>", b
        return out + t[at:]

    now = [(i, masked(t)) for i, t in now]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, d)
        assert seen.columns == docs.columns, name
    assert sorted((r["doc_id"], r["text"], r["n_chars"] == len(r["text"])) for r in seen.collect()) == sorted((i, t, True) for i, t in now if i != 902) + sorted((i, t, "<" in t) for i, t in now if i == 902)
    encoder = packing.WordEncoder(packing.default_tokenizer())
    out = corpus_pipeline.run(spark, d).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == sorted((i, len(encoder.encode(t)) // 4 + 1) for i, t in now)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, root int, node string, `a.b` string, left int"


@pytest.fixture(scope="module")
def odd_tables(spark, tables, tmp_path_factory):
    """The tables with clashing columns and odd rows."""
    _, rows, items = tables
    d = tmp_path_factory.mktemp("odd")
    rng = random.Random(2)
    long = "\n".join(" ".join(f"v{rng.randint(0, 3000)}" for _ in range(40)) for _ in range(700))
    more = [(950, long, "en", "s", len(long)), (951, long, "en", "s", len(long)), *[(952, rows[3][1] + " again", "en", "s", 1)] * 3, (None, rows[4][1] + f" no id {long[:3000]}", None, None, None), (953, "few words", "en", "s", 9), (953, None, None, None, None)]
    every = [(*r, "d", 1, None, "x", 2) for r in [*rows[:60], *more]]
    spark.createDataFrame(every, EXTRA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 6 != 0), 0) for r in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), every


def test_stages_on_odd_rows(spark, odd_tables):
    d, every = odd_tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r[5:] for r in rows} == {("d", 1, None, "x", 2)}, name
        seen[name] = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in rows)
    ids = lambda name: [i for i, _ in seen[name]]
    # Each stage is given all rows here: null and few words stay but for the first, repeated rows stay but for the second.
    assert 953 not in ids("quality_rules") and ids("quality_rules").count(952) == 3 and {950, 951, -1} <= set(ids("quality_rules"))
    assert ids("jaccard_join").count(952) <= 1 and 950 in ids("jaccard_join") and 951 not in ids("jaccard_join") and ids("jaccard_join").count(953) == 2
    assert ids("decontamination").count(952) in (0, 3) and ids("decontamination").count(953) == 2
    assert len(seen["personal_data"]) == len(every)
    packed = corpus_pipeline.run(spark, d).collect()
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        ends = [0, *(a + b for a, b in sorted(held))]
        assert [a for a, _ in sorted(held)] == ends[:-1] and ends[-1] <= packing.MAX_TOKENS
    assert {r["piece"] for r in packed if r["doc_id"] == 950} == set(range(max(r["piece"] for r in packed if r["doc_id"] == 950) + 1)) and not [r for r in packed if r["doc_id"] in (951, 953)]


def test_stages_on_empty_tables(spark, odd_tables, tmp_path):
    d, _ = odd_tables
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = queries.QUERIES[name](spark, d)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want)
