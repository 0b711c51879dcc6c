"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and phone numbers. They seed the bootstrap, as do words that
look like generated keys (SECRET), which are evidence for a fifth kind and no spans by themselves. Instances are words
with a digit or an @, without the marks and the key ("token=") around their value; neighbouring words with digits that only spaces, hyphens
and brackets part are one. The one, two or three tokens (words and single marks, lower case) before and after an instance are lexical patterns; brackets and hyphens next to it don't count.
Over at most ROUNDS rounds Spark scores the graph of patterns and instances:

* a pattern's confidence for a kind is the share of all its occurrences in the whole corpus that stand beside an instance of that kind,
  SUPPORT different ones at least; below LEAST it counts as none;
* an instance that is no base span has for a kind 1 - (1 - l)(1 - r) of the best patterns before and after it; with CONFIDENCE or more it is
  found, as of its best kind, and supports patterns in the next round.

Rounds end when nothing changes. Found instances are spans of their kind. Built-in SQL functions only.

Patterns are counted and joined as rows, with partial aggregation; a join takes a table of patterns as a broadcast only if it has at most BROADCAST_PATTERNS
rows, else both sides are stored tables, whose large partitions Spark splits.

Defined results: a null text counts as empty. Repeated rows each get a row, each counts as evidence. Spans of different kinds may overlap; sorted by
start, kind, end. Tokens and texts of any length are whole. A pattern doesn't reach over the next match of the same base pattern, or over the next word with a
digit or an @. An empty table gives no rows. Only doc_id and text are read; mask() keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bundled, unbundled, written

KINDS = ("email", "ip", "card", "phone")
#: The kind without a base pattern.
FOUND_KINDS = (*KINDS, "secret")
ROUNDS, SUPPORT, LEAST, CONFIDENCE = 5, 5, 0.5, 0.8
#: Patterns are broadcast if they are no more than so many.
BROADCAST_PATTERNS = 100_000
#: Tokens of the longest pattern.
REACH = 3
#: Matches, and tokens, that are taken at once.
CHUNK, TOKENS_CHUNK = 256, 4096

_SPACE = r"\x20\x09-\x0D"
# The contract's patterns, rewritten so that each run of characters is entered once: possessive where nothing can be given
# back, and begun only at the start of a run or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_INSTANCE = rf"(?<![^{_SPACE}])[^{_SPACE}]*[0-9@][^{_SPACE}]*+"
_TOKEN = rf"[\p{{L}}\p{{N}}]++|[^\p{{L}}\p{{N}}{_SPACE}]"
_NEAR = rf"^[{_SPACE}()\[\]-]*+((?:[{_SPACE}]*+(?:{_TOKEN})){{1,{REACH}}}+)"
# Marks before an instance's value, and a key that an = or : parts from it.
_LEAD = r"^[^\p{L}\p{N}]*+(?:[\p{L}_.-]++[=:]++[^\p{L}\p{N}]*+)?+"
#: Twenty letters and digits at least that change from letters to digits four times.
SECRET = r"^(?=(?:[0-9]*+[A-Za-z]++[0-9]++){4})[A-Za-z0-9]{20,}+$"
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: an expression named inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(text: Column, pattern: str, matches: Column, entry, kind: str) -> Column:
    """Array of entry(match, start, gap before, gap after) of those matches that hold, by the lengths of what lies between.

    Appending to an array copies it, so matches are taken CHUNK at a time: the work stays near linear in their number.
    """
    empty = F.filter(F.array(entry(F.lit(""), F.lit(0), F.lit(""), F.lit(""))), lambda x: F.lit(False))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        found = F.when(_holds(kind, p["m"]), F.concat(acc["out"], F.array(entry(p["m"], start, p["g"], p["h"])))).otherwise(acc["out"])
        return F.struct((start + F.length(p["m"])).alias("at"), found.alias("out"))

    def length(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0), lambda a, x: a + F.length(x["g"]) + F.length(x["m"]))

    def pairs_of(m: Column, gaps: Column) -> Column:
        return F.arrays_zip(m.alias("m"), F.slice(gaps, F.lit(1), F.size(m)).alias("g"), F.slice(gaps, F.lit(2), F.size(m)).alias("h"))

    def chunks_of(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(CHUNK)), lambda i: F.slice(pairs, i, F.lit(CHUNK)))

    def starts_of(chunks: Column) -> Column:
        return F.aggregate(F.transform(chunks, length), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def placed(chunks: Column, starts: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda c, i: F.aggregate(c, F.struct(F.get(starts, i).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])))

    all_pairs = _let(matches, lambda m: _let(F.split(text, pattern, -1), lambda gaps: pairs_of(m, gaps)))
    return _let(_let(all_pairs, chunks_of), lambda chunks: _let(starts_of(chunks), lambda starts: placed(chunks, starts)))


def _context(before: Column, after: Column) -> list[Column]:
    """The last REACH tokens of one string and the first of another, in lower case and in order, without brackets and hyphens next to the instance."""
    tokens = lambda near: F.regexp_extract_all(F.lower(near), F.lit(_TOKEN), F.lit(0))
    last = F.reverse(F.regexp_extract(F.reverse(before), _NEAR, 1))
    return [tokens(last).alias("left"), tokens(F.regexp_extract(after, _NEAR, 1)).alias("right")]


def _span(kind: str, context: bool):
    def entry(m: Column, start: Column, before: Column, after: Column) -> Column:
        more = [m.alias("value"), *_context(before, after)] if context else []
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), *more)

    return entry


def base_spans(rows: DataFrame, text: str, context: bool = False) -> DataFrame:
    """rows with a column _base: the base spans of the text column; context adds their value and the words beside them."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    kind_of = _SPANS.replace("end:int", "end:int,value:string,left:array<string>,right:array<string>") if context else _SPANS
    for kind, pattern in PATTERNS.items():
        possible = F.contains(t, F.lit(_NEEDS[kind])) if kind in _NEEDS else t.rlike("[0-9][ -]?[0-9]")
        rows = rows.withColumn(f"_m_{kind}", F.when(possible, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    for kind, pattern in PATTERNS.items():
        m = F.col(f"_m_{kind}")
        rows = rows.withColumn(f"_s_{kind}", F.when(F.size(m) > 0, _placed(t, pattern, m, _span(kind, context), kind)).otherwise(F.array().cast(kind_of)))
    return rows.withColumn("_base", F.concat(*(F.col(f"_s_{k}") for k in KINDS))).drop(*(f"_{x}_{k}" for k in KINDS for x in "ms"))


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, FOUND_KINDS)), k)
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), _bare)


def _bare(s: Column) -> Column:
    return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _instances(text: Column) -> Column:
    """Words with a digit or an @: value, its start and end, the whole word's start and end, how it joins its neighbours, and the tokens beside it.

    gap is the length of what parts it from the word with a digit before if both may be one instance, else -1; open tells whether the next one may join.
    """

    def entry(m: Column, start: Column, before: Column, after: Column) -> Column:
        lead = F.regexp_extract(m, _LEAD, 0)
        rest = F.substring(m, F.length(lead) + 1, F.length(m))
        value = F.regexp_replace(rest, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        first = start + F.length(lead)
        digits = m.rlike("[0-9]") & ~F.contains(m, F.lit("@"))
        joins = digits & F.concat(before, lead).rlike(r"^ [ ()\[\]-]*$")
        opens = digits & m.rlike(r"[\p{L}\p{N}][()\[\]-]*$")
        joints = [F.when(joins, F.length(before)).otherwise(-1).alias("gap"), opens.alias("open")]
        ends = [first.alias("start"), (first + F.length(value)).alias("end"), start.alias("from"), (start + F.length(m)).alias("to")]
        beside = _context(F.concat(before, lead), F.concat(F.substring(rest, F.length(value) + 1, F.length(rest)), after))
        return F.struct(value.alias("value"), *ends, *joints, *beside)

    matches = F.regexp_extract_all(text, F.lit(_INSTANCE), F.lit(0))
    none = F.array().cast("array<struct<value:string,start:int,end:int,from:int,to:int,gap:int,open:boolean,left:array<string>,right:array<string>>>")
    return F.when(text.rlike(_INSTANCE), _placed(text, _INSTANCE, matches, entry, "instance")).otherwise(none)


def _measured(documents: DataFrame, whole: bool = False) -> DataFrame:
    """_row, doc_id (or whole rows as _doc), _base and _instances of each row; written to the shared folder, so that _row stays."""
    rows = bundled(documents, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").alias("_id"))
    rows = base_spans(rows, "text", context=True)
    kept = F.col("_doc") if whole else F.col("_id").alias("doc_id")
    return written(rows.select(F.monotonically_increasing_id().alias("_row"), kept, "_base", _instances(F.col("text")).alias("_instances")), "measured")


def _graph_rows(measured: DataFrame) -> DataFrame:
    """_row, start, end, value, kind, left and right: base spans, and instances that overlap none, with a null kind."""
    some = measured.where(F.size("_instances") > 0)
    seeds = some.select("_row", F.explode("_base").alias("s")).select("_row", F.col("s.start").alias("from"), F.col("s.end").alias("to"), F.lit(-1).alias("gap"), F.lit(False).alias("open"), "s.*")
    words = some.select("_row", F.explode("_instances").alias("i")).where("i.value <> ''").select("_row", "i.*", F.lit(None).cast("string").alias("kind"))
    both = seeds.unionByName(words)
    # Within a document: the furthest end of seeds begun so far, and the first start of those to come.
    order = Window.partitionBy("_row").orderBy("from", F.col("kind").isNull())
    begun = F.max(F.when(F.col("kind").isNotNull(), F.col("to"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.min(F.when(F.col("kind").isNotNull(), F.col("from"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_over", (F.coalesce(begun, F.lit(0)) > F.col("from")) | (F.coalesce(coming, F.col("to")) < F.col("to")))
    both = both.where(F.col("kind").isNotNull() | ~F.col("_over"))
    # Neighbouring words with digits are one instance; a seed or a word without digits between them parts them.
    order = Window.partitionBy("_row").orderBy("from")
    free = both.where("kind is null").withColumn("_joined", F.lag("open").over(order) & (F.lag("to").over(order) == F.col("from") - F.col("gap")) & (F.col("gap") > 0))
    free = free.withColumn("_run", F.sum(F.when(F.col("_joined"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("from", "value")))
    runs = free.groupBy("_row", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(parts, lambda x: x["value"]), " ").alias("value"), F.first("kind").alias("kind"),
        F.min_by("left", "from").alias("left"), F.max_by("right", "from").alias("right"),
    )
    columns = ["_row", "start", "end", "value", "kind", "left", "right"]
    return both.where("kind is not null").select(*columns).unionByName(runs.select(*columns))


def _edges(held: DataFrame) -> DataFrame:
    """A row for each instance and pattern beside it: _row, start, end, value, kind, seed (the kind it is evidence for at first), side, pattern."""
    left = [F.when(F.size("left") >= n, F.array_join(F.slice("left", -n, n), " ")) for n in range(1, REACH + 1)]
    right = [F.when(F.size("right") >= n, F.array_join(F.slice("right", 1, n), " ")) for n in range(1, REACH + 1)]
    sides = [F.struct(F.lit(side).alias("side"), p.alias("pattern")) for side, ps in (("left", left), ("right", right)) for p in ps]
    seed = F.coalesce("kind", F.when(F.col("value").rlike(SECRET), "secret"))
    edges = held.select("_row", "start", "end", "value", "kind", seed.alias("seed"), F.explode(F.array(*sides)).alias("p"))
    return edges.where("p.pattern is not null").select("_row", "start", "end", "value", "kind", "seed", "p.side", "p.pattern")


def _few(patterns: DataFrame) -> DataFrame:
    """A stored table of patterns, to be broadcast if it is small enough."""
    return F.broadcast(patterns) if patterns.count() <= BROADCAST_PATTERNS else patterns


def _pattern_counts(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often each of the patterns occurs in all texts. Texts are cut into chunks of tokens that overlap by what a pattern needs."""
    tokens = F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_TOKEN), F.lit(0))
    chunk = lambda t: F.transform(F.sequence(F.lit(1), F.size(t), F.lit(TOKENS_CHUNK)), lambda at: F.slice(t, at, F.lit(TOKENS_CHUNK + REACH - 1)))
    chunks = documents.where(F.col("text").cast("string").rlike(rf"[^{_SPACE}]")).select(F.explode(_let(tokens, chunk)).alias("c"))
    # Each token with those after it; null beyond the text's end.
    places = F.arrays_zip(*(F.slice("c", n, TOKENS_CHUNK).alias(f"t{n}") for n in range(1, REACH + 1)))
    every = chunks.select(F.explode(places).alias("z")).select("z.*").where("t1 is not null")
    grams = lambda least: [F.when(F.col(f"t{n}").isNotNull(), F.concat_ws(" ", *(f"t{k}" for k in range(1, n + 1)))) for n in range(least, REACH + 1)]
    few = _few(patterns)
    if few is patterns:
        every = every.select(F.explode(F.array(*grams(1))).alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("total"))
        return written(every, "every_pattern").join(patterns, "pattern", "left_semi")
    # Most tokens begin no pattern; no string is made for them.
    is_long = F.contains("pattern", F.lit(" "))
    first = patterns.groupBy(F.substring_index("pattern", " ", 1).alias("t1")).agg(F.max(~is_long).alias("alone"), F.max(is_long).alias("more"))
    every = every.join(F.broadcast(first), "t1")
    found = [F.when(F.col("alone"), F.col("t1")), *(F.when(F.col("more"), g) for g in grams(2))]
    every = every.select(F.explode(F.array(*found)).alias("pattern")).where("pattern is not null").join(few, "pattern", "left_semi")
    return every.groupBy("pattern").agg(F.count("*").alias("total"))


def discovered(documents: DataFrame, measured: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least: float = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """_row, _found: spans that the bootstrap adds to the base ones."""
    edges = written(_edges(_graph_rows(measured)), "pattern_edges")
    # A pattern must be able to reach the support with all its instances; only such patterns are counted in the texts.
    able = edges.groupBy("side", "pattern").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= support).select("pattern").distinct()
    totals = written(_pattern_counts(documents, written(able, "able_patterns")), "pattern_totals")
    place = ["_row", "start", "end"]
    found, mark = None, None
    for _ in range(rounds):
        known = edges.withColumn("as", F.col("seed"))
        if found is not None:
            known = edges.join(found.withColumnRenamed("kind", "new"), place, "left").withColumn("as", F.coalesce("kind", "new", "seed"))
        scores = known.where("`as` is not null").groupBy("side", "pattern", "as").agg(F.count_distinct("value").alias("values"), F.count("*").alias("n"))
        scores = scores.where(F.col("values") >= support).join(totals, "pattern").withColumn("confidence", F.col("n") / F.greatest("total", "n"))
        strong = written(scores.where(F.col("confidence") >= least).select("side", "pattern", "as", "confidence"), "strong_patterns")
        hits = edges.where("kind is null").join(_few(strong), ["side", "pattern"])
        best = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("confidence"))), F.lit(0.0))
        hits = hits.groupBy(*place, "as").agg((1 - (1 - best("left")) * (1 - best("right"))).alias("score")).where(F.col("score") >= confidence)
        found = hits.groupBy(*place).agg(F.max(F.struct("score", "as")).alias("b")).select(*place, F.col("b.as").alias("kind"))
        found = written(found, "found")
        now = found.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*place, "kind").cast("decimal(38,0)")).alias("h")).first()
        if mark == (now["n"], now["h"]) or not now["n"]:
            break
        mark = (now["n"], now["h"])
    return found.groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("_found"))


def _with_spans(documents: DataFrame, whole: bool) -> DataFrame:
    """Each row with _spans, the base ones and those found, in order, and _base."""
    measured = _measured(documents, whole)
    rows = measured.drop("_instances").join(discovered(documents, measured), "_row", "left")
    base = F.transform("_base", _bare)
    return rows.select("*", ordered(F.concat(base, F.coalesce("_found", F.array().cast(_SPANS)))).alias("_spans"))


def personal_data(documents: DataFrame) -> DataFrame:
    """A row for each document: counts by kind, the digest of base spans, all spans as text, and how many of them the bootstrap adds."""
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(written_spans(ordered(F.transform("_base", _bare))), 256)
    added = (F.size("_spans") - F.size("_base")).cast("long")
    return _with_spans(documents, whole=False).select(
        F.col("doc_id").cast("long").alias("doc_id"), *map(count, KINDS), digest.alias("base_sha256"), written_spans(F.col("_spans")).alias("spans"), added.alias("n_added")
    )


def _masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; overlapping spans are one, of the first one's kind."""

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(spans, F.array().cast(_SPANS), merge)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))

    return F.aggregate(merged, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask(documents: DataFrame) -> DataFrame:
    """documents with personal data in text replaced, n_chars to match if there is one, all other columns as they are."""
    text = F.col("_doc.text").cast("string")
    rows = _with_spans(documents, whole=True).withColumn("_masked", F.when(F.size("_spans") > 0, _masked(text, F.col("_spans"))))
    replaced = {"text": F.coalesce("_masked", text)}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(F.size("_spans") > 0, F.length("_masked").cast(kind)).otherwise(F.col("_doc.n_chars"))
    return unbundled(rows, documents, **replaced)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
