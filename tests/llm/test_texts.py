"""Operators on documents against plain versions, with the odd cases of their docstrings."""

import gc
import random
import re
import weakref
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import decontamination, extraction, licences, neardup, packing, pii, quality, substrings
from stemma.llm.common import shingle_hashes, text_buffers, word_hashes

CLASHING = "doc_id long, text string, kept string, node string, _salt int, _base int, _text_key int, n_chars long"
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split(" "))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "n", 1, 2, 3, None if t is None else len(t)) for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(30)]
    texts = base + [changed(rng, rng.choice(base), s) for s in (0, 0, 0.005, 0.01, 0.02, 0.05) for _ in range(8)]
    texts += [changed(rng, base[0], 0.004) for _ in range(40)] + [base[1]] * 20 + ["", None, " \n\t", "one", "one", "two words", "two words", "\xa0nbsp kept\xa0", prose(rng, 30_000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_words_are_split_as_defined():
    texts = ["a b\tc\x0bd\x0ce\rf\ng", "\x1cx\x1f \x85y\xa0z", "", None, " ", "é€🙂 a"]
    hashes, offsets = word_hashes(*text_buffers(pa.array(texts)))
    assert np.diff(offsets).tolist() == [len(brute.WORD.findall(t or "")) for t in texts]
    _, at = shingle_hashes(hashes, offsets)
    assert np.diff(at).tolist() == [3, 1, 0, 0, 0, 1]
    sliced = pa.array(["skip", *texts]).slice(1)
    assert (word_hashes(*text_buffers(sliced))[0] == hashes).all()


def test_jaccard_join(spark, corpus):
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in neardup.near_duplicates(frame(spark, corpus)).collect()}
    assert got == brute.near_duplicates(corpus)


def test_jaccard_join_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in neardup.near_duplicates(frame(spark, corpus)).collect()}
    assert got == brute.near_duplicates(corpus)


def test_jaccard_join_of_loose_groups(spark, monkeypatch):
    """A chain of documents, each like its neighbours only, is one candidate group; its buckets are compared, not all its pairs."""
    rng = random.Random(3)
    words = [rng.choice(VOCABULARY) + str(k) for k in range(2500)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 120])) for k in range(150)] + [(200, " ".join(words[:120])), (201, " ".join(words[1:120]))]
    monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    seen = {}
    monkeypatch.setattr(neardup, "verified", lambda jobs, similarity, f=neardup.verified: seen.setdefault("links", f(seen.setdefault("jobs", jobs), similarity)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)
    jobs = seen["jobs"]
    assert jobs.where("band >= 0").count() > 0 and jobs.where("band >= 0").groupBy("node").count().agg({"count": "max"}).first()[0] <= 4 * neardup.bands_for(0.8, neardup.RECALL, neardup.ROWS)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, ""), (2, ""), (3, None), (4, "x y"), (4, "x y"), (4, "z w q"), (None, "n1 n2"), (None, "n1 n2")]
    out = neardup.one_of_each(frame(spark, rows))
    assert out.columns == [c.split(" ")[0] for c in CLASHING.split(", ")]
    left = sorted(((r["doc_id"] or 0, r["text"] or "", r["_text_key"]) for r in out.collect()))
    assert left == [(0, "n1 n2", 3), (1, "a b c d e f g", 3), (2, "", 3), (2, "", 3), (3, "", 3), (4, "x y", 3), (4, "z w q", 3)]
    assert neardup.one_of_each(frame(spark, [])).count() == 0 == neardup.near_duplicates(frame(spark, [])).count()


def test_repeated_ids_in_groups(spark):
    words = [f"u{i}" for i in range(100)]
    text = " ".join(words)
    near = " ".join([*words[:-1], "other"])
    revised = " ".join("new" if i in (20, 50, 80) else w for i, w in enumerate(words))
    # A repeated row beside a near copy: each of the three has the other two.
    out = neardup.near_duplicates(frame(spark, [(1, text), (1, text), (2, near)])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in out) == [(1, 1, 2, 1), (1, 1, 2, 1), (2, 1, 2, 0)]
    # Two texts of one doc_id that meet in a group, but aren't similar enough.
    rows = frame(spark, [(1, text), (1, revised)])
    assert [r["n_links"] for r in neardup.near_duplicates(rows).collect()] == [0, 0]
    assert sorted(r["text"] for r in neardup.one_of_each(rows).collect()) == sorted([text, revised])


def test_components_of_chains_and_stars(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(120)] + [("a0", f"a{i}") for i in range(1, 60)] + [("z", "z")]
    out = neardup.components(spark.createDataFrame(edges, "a string, b string"))
    roots = {r["node"]: r["root"] for r in out.collect()}
    assert {roots[f"{i:04d}"] for i in range(121)} == {"0000"} and {roots[f"a{i}"] for i in range(60)} == {"a0"}
    assert out.count() == 181 and neardup.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 7, 9, 12, 15, 20, 33, 40, 60, 100, 3])] + [(50, ""), (51, None), (1, prose(rng, 11)), (0, None)]
    items.append(items[3])
    real = [x for x in items if x[1]]
    documents = [(i, f"{prose(rng, rng.randint(0, 300))} {rng.choice(real)[1] if i % 3 else ''} {prose(rng, rng.randint(0, 300))}") for i in range(60)]
    documents += [(100 + i, f"{prose(rng, 100)} {changed(rng, rng.choice(real[5:10])[1], 0.03)} {prose(rng, 9)}") for i in range(30)]
    documents += [(200, None), (201, ""), (202, items[10][1]), (203, prose(rng, 20_000) + " " + items[8][1]), (0, items[9][1])]
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in decontamination.contaminated(frame(spark, documents), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.contained(documents, items)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.drop_contaminated(frame(spark, documents), benchmark)
    bad = {(i, t) for i, t in documents if brute.contained([(i, t)], items)}
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect())) == sorted((i, t or "") for i, t in documents if (i, t) not in bad)
    assert decontamination.contaminated(frame(spark, []), benchmark).count() == 0
    assert decontamination.contaminated(frame(spark, documents), benchmark.limit(0)).count() == 0
    assert decontamination.drop_contaminated(frame(spark, documents), benchmark.limit(0)).count() == len(documents)


def test_item_blocks_cover_all(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 3)
    rng = random.Random(6)
    items = [(k, prose(rng, 12)) for k in range(20)]
    documents = [(k, f"{prose(rng, 50)} {x} {prose(rng, 50)}") for k, x in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(spark, documents), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(20)}


def test_blocks_are_given_back(spark, monkeypatch):
    """However many blocks there are, one index is held at a time."""
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(decontamination, "REMEMBERED", 1)
    alive, most = set(), []

    def counted(self, *a, made=decontamination.Index.__init__):
        made(self, *a)
        alive.add(id(self))
        weakref.finalize(self, alive.discard, id(self))
        gc.collect()
        most.append(len(alive))

    monkeypatch.setattr(decontamination.Index, "__init__", counted)
    rng = random.Random(7)
    items = [(k, prose(rng, 12)) for k in range(16)]
    documents = [(k % 14, f"{prose(rng, 50)} {x} {prose(rng, 50)}") for k, x in items] + [(50, prose(rng, 30)), (51, None), (50, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.drop_contaminated(frame(spark, documents), benchmark)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(50, documents[16][1]), (51, None)] and kept.columns == frame(spark, documents).columns
    assert len(most) >= 8 and max(most) <= 2


def junk(rng, n, kind):
    if kind == 0:
        return " ".join(w + "%%%" for w in prose(rng, n).split(" "))
    if kind == 1:
        return " | ".join(prose(rng, n).split(" "))
    return "\n".join([f"menu home {rng.choice('abc')}"] * (n // 3))


def test_quality(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(2, 6)))) for i in range(80)] + [(100 + i, "\n".join(junk(rng, 40, i % 2) for _ in range(3))) for i in range(80)]
    odd = [(300, None), (301, ""), (302, "a"), (303, "x " * 60_000), (304, "\n\n \n"), (305, "l i n e\r\nl i n e\nl i n e"), (306, "\xa0é ß\x85"), (307, prose(rng, 50)), (307, prose(rng, 49))]
    documents = frame(spark, rows + odd)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i % 100 < 60], "doc_id long, quality int, toxic int")
    field = quality.fit(documents, labels)
    out = quality.quality(documents, field).collect()
    measured = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out)
    assert measured == sorted((i, *brute.quality_base(t)) for i, t in rows + odd)
    verdict = {r["doc_id"]: r["kept"] for r in out if not r["base_failed"]}
    held_out = [i for i, _ in rows if i % 100 >= 60 and i in verdict]
    assert sum(verdict[i] == (i < 100) for i in held_out) >= 0.95 * len(held_out)
    kept = quality.keep_good(documents, field)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in verdict.items() if k}
    assert quality.fit(documents, labels.limit(3)) is None
    assert quality.quality(documents.limit(0), None).count() == 0
    plain = quality.quality(documents, None).collect()
    assert all(r["kept"] != r["base_failed"] for r in plain)


def test_quality_of_few_labels(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join(prose(rng, rng.randint(20, 60)) for _ in range(4))) for i in range(60)] + [(100 + i, "\n".join(junk(rng, 40, i % 2) for _ in range(3))) for i in range(30)]
    documents = frame(spark, rows + [(1000 + i, "long " * 2000) for i in range(40)])
    # Labels of documents that are missing or too long don't use up the sample.
    known = [(i, int(i < 100), 0) for i, _ in rows if i % 100 < 8] + [(i, i % 2, 0) for i in [*range(1000, 1040), *range(5000, 5400)]]
    field = quality.fit(documents, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), sample=8, sample_chars=5000)
    out = {r["doc_id"]: r for r in quality.quality(documents, field).collect()}
    tried = [i for i, _ in rows if i % 100 >= 8 and not out[i]["base_failed"]]
    assert len({i < 100 for i in tried}) == 2
    assert sum(out[i]["kept"] == (i < 100) for i in tried) >= 0.95 * len(tried)
    assert quality.fit(documents, spark.createDataFrame([(0, 1, 0), (1039, 0, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int"), sample_chars=5000) is None


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    for n in range(1, 9):
        x = rng.normal(size=(n, 3))
        e = x @ field.weights
        score = lambda path: sum(e[i, s] for i, s in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=score)
        assert field.viterbi(x).tolist() == best


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(3)
    path = packing.default_tokenizer()
    plain = tokenizers.Tokenizer.from_file(path)
    letters = "\x01\x7faé ßÀĞİıſ'sS'tT're!?.,#12²½ª\t\n\x0b\x1c\x85\xa0Σσςжñ́á​ 你好🙂-_\"'LL'D"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|> a<|startoftext|>"), (1003, "word " * 9000), (1004, "x" * 3000), (7, "again"), (7, "again"), (None, "none")] + [(2000 + i, prose(rng, rng.randint(1, 2500))) for i in range(40)]
    out = packing.packed_documents(frame(spark, rows), path).collect()
    want = []
    for i, t in rows:
        ids = np.asarray([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i or -1, at // 4096, at, len(p := ids[at : at + 4096]), zlib.crc32(p.tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    bins = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert packing.packed_documents(frame(spark, []), path).count() == 0


def test_packing_plan():
    rng = random.Random(4)
    for size in (10, 50, 300):
        for _ in range(30):
            counts = {k: rng.randint(1, 40) for k in rng.sample(range(1, size + 1), rng.randint(1, min(size, 20)))}
            used = {}
            for times, lengths in packing.plan(counts, size):
                assert sum(lengths) <= size and times > 0
                for x in lengths:
                    used[x] = used.get(x, 0) + times
            assert used == counts
    # The two that fill the gap replace the smallest.
    assert sorted(map(sorted, (x for _, x in packing.plan({6: 1, 3: 1, 2: 2}, 10)))) == [[2, 2, 6], [3]]


def test_personal_data(spark):
    rng = random.Random(2)
    parts = ["1", "2", "55", "256", ".", "..", "@", "a", "b-c", "%", "+", "+1", " ", "  ", "-", "(", ")", "4111111111111111", "4390698575873170", "é", "🙂", "\n", ".c", "x@y.z", "1.2.3.4", "00", "(743) 555-3824", "+1 743 555 3824", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(600)]
    rows += [(9001, "a@" + "b." * 20_000 + "c"), (9002, "x" * 100_000 + " @ a@b.c"), (9004, None), (9005, ""), (9006, "a@b.c " * 2000), (9007, "1." * 20_000), (9008, "+1" + " " * 50_000 + "2"), (9009, "+1 " * 10_000), (9010, "x a@b.c"), (9010, "x a@b.c")]
    out = pii.personal_data(frame(spark, rows)).collect()
    import hashlib

    def row(i, t):
        found = brute.personal_data(t)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
        return (i, *(sum(k == x for _, _, k in found) for x in pii.KINDS), hashlib.sha256(text.encode()).hexdigest())

    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in out) == sorted(row(i, t) for i, t in rows)
    assert pii.personal_data(frame(spark, [])).count() == 0 == pii.mask(frame(spark, [])).count()


def test_bootstrap_finds_unseen_identifiers(spark):
    rows = [(k, f"report {k} call hotline: +1 743 555 {3000 + k} now") for k in range(12)]
    rows += [(100 + k, f"the hotline: 743-555-{2000 + k} works, invoice 99{k} paid") for k in range(3)] + [(200, "nothing"), (201, "invoice 12345 was"), (202, None)]
    frame_ = frame(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame_).collect()}
    assert spans[0] == "phone:23:38" and spans[101] == "phone:13:25" and spans[200] == spans[201] == ""
    masked = {r["doc_id"]: r for r in pii.mask(frame_).collect()}
    assert masked[100]["text"] == "the hotline: <PHONE> works, invoice 990 paid" and masked[100]["n_chars"] == 44
    assert masked[202]["text"] is None and masked[201]["text"] == "invoice 12345 was" and masked[100]["_base"] == 2


def test_bootstrap_finds_whole_identifiers(spark):
    rows = [(k, f"report {k} call hotline: +1 743 555 {3000 + k} now") for k in range(12)]
    # "desk" and "line" stand beside many other words, "desk line" beside phones only.
    rows += [(50 + k, f"ask desk line +1 743 555 {4000 + k} today") for k in range(12)] + [(70 + k, "the desk is here, a line is there") for k in range(20)]
    rows += [(100, "the hotline: 743 555 2000 works"), (101, "the hotline: (743) 555 - 2000, 12 times"), (102, "via desk  line 743 555 2000 or"), (103, "a line 12 34 is")]
    rows += [(104, "the hotline: 743 555 a@b.c 2000 x")]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(frame(spark, rows)).collect()}
    assert masked[100] == "the hotline: <PHONE> works" and masked[101] == "the hotline: (<PHONE>, 12 times"
    assert masked[102] == "via desk  line <PHONE> or" and masked[103] == "a line 12 34 is"
    assert masked[104] == "the hotline: <PHONE> <EMAIL> 2000 x"


def added(rows):
    """Spans beyond the base ones, of (text, written spans)."""
    out = []
    for text, spans in rows:
        own = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)}
        out.append(own - {(k, a, b) for a, b, k in brute.personal_data(text)})
    return out


def test_bootstrap_equals_plain_version(spark):
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    number = lambda: f"{rng.randint(200, 999)} 555 {rng.randint(1000, 9999)}"
    long = "k" * 2000
    forms = [
        lambda: f'token = "{hexes(40)}"', lambda: f'token = "{hexes(9)}"', lambda: f"key={hexes(32)}", lambda: f"key={hexes(6)};", lambda: f"call +1 {number()} today", lambda: f"call {number()} today",
        lambda: f"call {number()}", lambda: f"{number()} today", lambda: f"{long}: +1 {number()}", lambda: f"{long}: {number()}", lambda: f"host <10.0.{rng.randint(0, 255)}.7> up", lambda: f"host <srv{rng.randint(0, 99)}> up",
        lambda: f"mail:a{rng.randint(0, 99)}@b.org", lambda: f"mail:a{rng.randint(0, 99)}@intranet", lambda: "call today", lambda: f"item {rng.randint(0, 99)} of 7", lambda: f"STRASSE {rng.randint(1, 9)}{rng.choice('abc')}",
    ]
    forms += 5 * [forms[i] for i in (0, 2, 4, 8, 10, 12)]
    texts = [" ".join(rng.choice(forms)() if rng.random() < 0.3 else rng.choice(VOCABULARY[:40]).strip("0123456789") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "\U0001f642 1\U0001f642"]
    texts += texts[:7]
    rows = list(enumerate(texts))
    out = sorted((r["doc_id"], r["spans"], r["n_added"]) for r in pii.personal_data(frame(spark, rows)).collect())
    want = brute.bootstrapped(texts)
    assert added([(t, o[1]) for t, o in zip(texts, out, strict=True)]) == want
    assert [o[2] for o in out] == [len(w) for w in want]
    kinds = {k for w in want for k, _, _ in w}
    assert {"secret", "phone", "ip", "email"} <= kinds and any(f"{long}: {t[a:b]}" in t for t, w in zip(texts, want, strict=True) for _, a, b in w)


def test_bootstrap_finds_the_keys_of_the_tables(spark):
    """All generated keys of sf0.01 stand in one context and nothing else does: precision and recall 1."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = {r["doc_id"]: r["spans"] for r in pii.personal_data(documents).collect()}
    ids = sorted(texts)
    found = added([(texts[i], rows[i]) for i in ids])
    assert found == [{("secret", *m.span(1)) for m in re.finditer('token = "([0-9a-f]{40})"', texts[i])} for i in ids] and sum(map(len, found)) > 10
    assert found == brute.bootstrapped([texts[i] for i in ids])


def test_patterns_without_broadcast(spark, monkeypatch):
    rows = [(k, f"report {k} call hotline: +1 743 555 {3000 + k} now") for k in range(12)] + [(20, "the hotline: 743-555-2000 works")]
    want = sorted(pii.personal_data(frame(spark, rows)).collect())
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    monkeypatch.setattr(pii, "TOKENS_CHUNK", 4)
    assert sorted(pii.personal_data(frame(spark, rows)).collect()) == want and want[-1]["n_added"] == 1


def test_licences(spark):
    rng = random.Random(8)
    names = list(licences.TEMPLATES)
    rows = [(i, f"{prose(rng, rng.randint(0, 80))}\n{licences.TEMPLATES[names[i % len(names)]].upper() if i % 2 else licences.TEMPLATES[names[i % len(names)]]}\n{prose(rng, rng.randint(0, 80))}") for i in range(56)]
    rows += [(100, "license under software"), (101, None), (102, ""), (103, licences.TEMPLATES["gpl-3.0-header"].replace("option", "choice")), (104, "all rights-reserved"), (105, "under " * 30_000), (105, "x under")]

    def plain(text):
        words = " " + " ".join(licences.words_of(text or "")) + " "
        out = set()
        for name, t in licences.TEMPLATES.items():
            s = licences.template_shingles(t)
            n = sum(f" {x} " in words for x in s)
            if n >= 0.8 * len(s):
                out.add((name, n, len(s)))
        return out

    got = sorted((r["doc_id"], r["license"], r["n_shared"], r["n_shingles"]) for r in licences.scan(frame(spark, rows)).collect())
    assert got == sorted((i, *x) for i, t in rows for x in plain(t))
    assert licences.scan(frame(spark, [])).count() == 0


def test_anchors_bound_every_template():
    marks = licences.anchors(licences.TEMPLATES)
    for text in licences.TEMPLATES.values():
        s = licences.template_shingles(text)
        without = sum(not set(x.split()) & set(marks) for x in s)
        assert without < licences.CONTAINMENT * len(s)


def test_removal(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(5)]
    rows = [(k, "".join(rng.choice(base)[rng.randint(0, 200) : rng.randint(450, 700)] + rng.choice(["", "x", "yz" * 30]) for _ in range(rng.randint(0, 3)))) for k in range(60)]
    rows += [(100, "a" * 1500), (101, "ab" * 600), (102, None), (103, ""), (104, "q" * 399), (105, "é" * 260), (106, "é" * 260), (107, "same text" * 50), (107, "same text" * 50), (None, "same text" * 50)]

    def check(rows, length, gram):
        out = substrings.remove_repeats(frame(spark, rows), length, gram, keep_text=True).collect()
        want = brute.removed([(t or "").encode() for _, t in rows], length)
        key = lambda r: tuple(map(str, r))
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=key) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)

    check(rows, 400, 128)
    check([(i, (t or "")[:60]) for i, t in rows], 12, 5)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2000)
    monkeypatch.setattr(substrings, "CHUNK", 301)
    check(rows, 400, 128)
    # Many near copies, whose groups are cut again, and groups of which even the cuts are large.
    text = "".join(rng.choice("abcdefgh ") for _ in range(900))
    near = [(k, "".join(rng.choice("xyz") if rng.random() < 0.004 else c for c in text)) for k in range(50)]
    check(near, 400, 128)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 500)
    check(near, 400, 128)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_removal_returns_what_stays(spark, tmp_path):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    rows = [(0, f"before {passage} after"), (1, f"{passage}é tail"), (2, f"{passage}è other"), (3, None), (4, "short é"), (5, passage), (5, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = substrings.op9_repeats(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(0, "before  after"), (1, "\ufffd tail"), (2, "\ufffd other"), (3, ""), (4, "short é"), (5, ""), (5, "")]
    want = brute.removed([(t or "").encode() for _, t in rows], 400)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_interval_expansion():
    rng = random.Random(2)
    for _ in range(150):
        length, alphabet = rng.choice([3, 5, 8, 12]), rng.choice([b"a", b"ab", b"abcd\x00\xff"])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        counts = {}
        for t in texts:
            for i in range(len(t) - length + 1):
                counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
        want = [[i for i in range(len(t) - length + 1) if counts[t[i : i + length]] > 1] for t in texts]
        assert [x.tolist() for x in substrings.repeated_starts(texts, length)] == want


PAGE = """<html><body class="page"><div id="cookie-notice">Accept cookies</div><header><h1>Site</h1><p>tag</p></header><div class="wrap"><div class="sidebar">S1 long long long</div>
<div class="content"><header><h1>Title &amp; more</h1><span>by me</span></header><p>First  para <a href=x>link</a> a&lt;b.<p>Second<br>line<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><form><input><label>L</label></form>
<div class="comments"><p>Great post!</p></div><script>if(a<b){x("</p>")}</script><pre>code  a
 b</pre></div></div><footer>F</footer>"""


def test_extraction(spark):
    assert extraction.main_text(PAGE, None) == "Title & more\nFirst para link a<b.\nSecond\nline\nx\ny\nc1\nc2\ncode a b"
    assert extraction.main_text("<div>" * 20_000 + "deep" + "</div>" * 3, None) == "deep"
    assert extraction.main_text("no markup &eacute; at <all", None) == "no markup é at <all"
    assert extraction.main_text('<div class="page has-sidebar no-comments"><p>kept text</p><div class="post-comments">lost</div></div>', None) == "kept text"
    # The host's path wins where a page's own best container is another.
    article = lambda n, extra="": f'<body><div class="post-{n}"><p>{"word " * 60}</p></div><div class="promo-box-x">{extra}</div></body>'
    rows = [(i, "http://h/a", article(i), 0) for i in range(20)] + [(50, "http://h/b", f'<body><div class="post-9"><p>{"own " * 50}</p></div><div class="quotes"><p>{"loud " * 60}</p></div></body>', 0)]
    rows += [(60, None, None, 0), (61, None, "", 0), (62, "x", "<p>a</p>", 0), (62, "x", "<p>a</p>", 0), (63, "http://h/c", "<!-- only -->", 0)]
    out = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, winner int")).collect()
    texts = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and texts[50] == " ".join(["own"] * 50) and texts[3] == " ".join(["word"] * 60)
    assert texts[60] == texts[61] == texts[63] == "" and texts[62] == "a" and all(r["n_chars"] == len(r["text"]) for r in out)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_extraction_equals_plain_version(spark, sf):
    """On all pages of the tables."""
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    out = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    assert out == {i: brute.main_text(h) for i, h in html.items()} and len(out) >= 50


def test_extraction_from_layout_names():
    story = " ".join(["story"] * 40)
    for name in ("container sidebar-right", "elementor-widget-container", "text-navy content", "page widget", "notice", "comments-open"):
        for inner in (f"<article><p>{story}</p></article>", f"<main><p>{story}</p></main>", f"<p>{story}</p>"):
            assert extraction.main_text(f'<body><p>Top</p><div class="{name}">{inner}</div>', None).endswith(story), (name, inner)
        # What the page is about counts, not only its length.
        page = f'<body><p>{"other " * 60}</p><div class="{name}"><article><h1>Title</h1><p>{story}</p></article></div>'
        assert extraction.main_text(page, None).endswith(f"Title\n{story}"), name
    # Parts beside an article stay out, also where they hold articles of their own or more text.
    beside = '<div class="related"><article><p>teaser</p></article></div><div class="sidebar"><h1>About</h1></div><div id="comments"><article class="comment-body"><p>first</p></article></div>'
    assert extraction.main_text(f'<body><main><h1>Title</h1><article><p>{story}</p></article>{beside}</main>', None) == story
    assert extraction.main_text(f'<body><div class="post"><h1>Title</h1><p>{story}</p><div class="comments"><p>{"reply " * 100}</p></div></div>', None) == f"Title\n{story}"
    assert extraction.main_text(f'<body><div class="post"><p>{story}</p><div class="promo-box">{"<a href=x>link link link</a>" * 50}</div></div>', None) == story


def test_extraction_by_long_paths(spark):
    utilities = " ".join(f"utility-class-{c}" for c in "abcdefgh")
    for outer in (f'<div class="{utilities}">' * 4, "<div>" * 120):
        page = f'<body>{outer}<div class="story"><p>{"word " * 60}</p></div><div class="other"><p>beside it</p></div>'
        assert extraction.main_text(page, None) == " ".join(["word"] * 60)
        out = extraction.extract(spark.createDataFrame([(i, "http://h/a", page) for i in range(3)], "page_id long, url string, html string")).collect()
        assert [r["text"] for r in out] == [" ".join(["word"] * 60)] * 3


def test_extraction_by_plain_join(spark, monkeypatch):
    monkeypatch.setattr(extraction, "BROADCAST_HOSTS", 0)
    rows = [(i, f"http://h{i % 3}/a", PAGE) for i in range(30)]
    out = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {extraction.main_text(PAGE, None)} and len(out) == 30


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out[:n]


@pytest.mark.parametrize("size", [1024, 2048, 8192])
def test_strings_that_polynomial_hashes_confuse(spark, size):
    """Thue and Morse's word and its complement are equal to any polynomial hash modulo 2**64."""
    x, y = "".join(thue_morse(size, "a", "b")), "".join(thue_morse(size, "b", "a"))
    texts = [x, y, f"{x} {y}", f"{y}\n{x}\n{x}", " ".join([x, "one", "two", y, "one", "two", x]), x]
    rows = list(enumerate(texts))
    measures = {r["doc_id"]: r for r in quality.quality(frame(spark, rows), None).collect()}
    for i, t in rows:
        assert tuple(measures[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality_base(t)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows) and got[0] == (0, 1, 1) and got[1] == (1, 0, 0)
    if size == 1024:
        removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
        assert [removed[i] for i, _ in rows] == brute.removed([t.encode() for t in texts], 400)
