"""Graph operators on triples (s, p, o, o_kind, o_datatype, o_lang) and on edges (src, dst, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"


def iri(rows: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    """Triples with IRIs as objects, without those that have a null part."""
    return _triples(rows, s, p, o, "iri", F.lit(None), F.lit(None))


def literal(rows: DataFrame, s: Column, p: str, o: Column, datatype: str | None = None, lang: str | None = None) -> DataFrame:
    return _triples(rows, s, p, o.cast("string"), "literal", F.lit(datatype), F.lit(lang))


def _triples(rows: DataFrame, s: Column, p: str, o: Column, kind: str, datatype: Column, lang: Column) -> DataFrame:
    out = rows.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.cast("string").alias("o_datatype"), lang.cast("string").alias("o_lang"))
    return out.where("s is not null and o is not null")


def as_set(*parts: DataFrame) -> DataFrame:
    """Triples as a set."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


#: Triples of one predicate that a task writes.
FILE_ROWS = 5_000_000


def stored(triples: DataFrame, path: str, rows: int = FILE_ROWS) -> DataFrame:
    """triples written by predicate, so that a pattern with a constant predicate reads its own files only; a predicate is dealt to as many tasks as its number of triples asks for."""
    # A vocabulary has few predicates; beyond that the join isn't broadcast.
    parts = triples.groupBy("p").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    dealt = triples.join(parts, "p").withColumn("_part", F.pmod(F.xxhash64("s", "o"), F.col("_parts")))
    dealt.repartition("p", "_part").select("s", "p", "o", "o_kind", "o_datatype", "o_lang").write.mode("overwrite").partitionBy("p").parquet(path)
    return triples.sparkSession.read.schema(TRIPLE).parquet(path).select("s", "p", "o", "o_kind", "o_datatype", "o_lang")


def objects(triples: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """Subjects and objects of one predicate, each value a row."""
    return triples.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def first_object(triples: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """The least object of each subject."""
    return objects(triples, p, s, o).groupBy(s).agg(F.min(o).alias(o))


def instances(triples: DataFrame, cls: str, s: str = "s") -> DataFrame:
    return triples.where((F.col("p") == RDF_TYPE) & (F.col("o") == cls)).select(F.col("s").alias(s))


RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def class_counts(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == RDF_TYPE).groupBy(F.col("o").alias("class")).agg(F.count_distinct("s").alias("n"))


def term(o: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """A term in N-Triples syntax."""
    escaped = F.replace(F.replace(o, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.replace(F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    tagged = F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(quoted, F.lit("^^<"), datatype, F.lit(">"))).otherwise(quoted)
    return F.when(kind == "iri", F.concat(F.lit("<"), o, F.lit(">"))).otherwise(tagged)


def ntriples(triples: DataFrame) -> DataFrame:
    """value: a line for each triple."""
    return triples.select(F.format_string("<%s> <%s> %s .", "s", "p", term(*map(F.col, ("o", "o_kind", "o_datatype", "o_lang")))).alias("value"))


def described(triples: DataFrame) -> DataFrame:
    """s, text: all triples of a subject in Turtle, its types first."""
    pair = F.struct((F.col("p") != RDF_TYPE).alias("last"), F.col("p"), term(*map(F.col, ("o", "o_kind", "o_datatype", "o_lang"))).alias("o"))
    lists = triples.groupBy("s").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    body = F.array_join(F.transform("pairs", lambda x: F.concat(F.lit("    <"), x["p"], F.lit("> "), x["o"])), " ;\n")
    return lists.select("s", F.concat(F.lit("<"), F.col("s"), F.lit(">\n"), body, F.lit(" .")).alias("text"))


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both are nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int, most: int | None = None) -> DataFrame:
    """id, hop: nodes within so many hops of the start nodes (id), edges taken either way; at most `most` of the nearest, by id.

    Each hop joins the newest nodes only.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("id").distinct().withColumn("hop", F.lit(0))
    newest = seen
    for k in range(1, hops + 1):
        reached = both.join(newest.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        newest = reached.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(newest)
    return seen.orderBy("hop", "id").limit(most) if most is not None else seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes (id)."""
    return without_dangling(edges, nodes).distinct()


def link_lists(edges: DataFrame, shown: int = 40) -> DataFrame:
    """id, rel, direction, n, links: each node's links by relation and direction, the first `shown` by id."""
    out = edges.select(F.col("src").alias("id"), "rel", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("id"), "rel", F.lit("in").alias("direction"), F.col("src").alias("other"))
    ends = out.unionByName(into).distinct()
    w = Window.partitionBy("id", "rel", "direction")
    # Limited before they are collected, so that a hub's list stays short.
    ranked = ends.withColumn("n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("other"))).where(F.col("_k") <= shown)
    return ranked.groupBy("id", "rel", "direction").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("other")).alias("links"))


def search(nodes: DataFrame, text: str, columns: list[str], types: list[str] | None = None, waterbody: str | None = None, issue: str | None = None, most: int = 300) -> DataFrame:
    """Nodes with a text in any of the columns, whatever the case, by type and label."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle)
    out = nodes.where(hit)
    if types is not None:
        out = out.where(F.col("type").isin(*types))
    if waterbody is not None:
        out = out.where(F.col("waterbody") == waterbody)
    if issue is not None:
        out = out.where(F.array_contains("issues", issue))
    return out.orderBy("type", "label", "id").limit(most)
