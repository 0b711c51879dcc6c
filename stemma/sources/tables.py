"""Tables as CSV with explicit schemas, JSON lookups, text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANK_COLUMNS = ("kingdom", "phylum", "class", "order", "family", "genus")
SCHEMAS = {
    "records": "source string, waterbody string, `group` string, idx int, raw_name string, vn_name string, canonical string, genus string, authorship string, "
    "year int, is_morphospecies boolean, is_higher_taxon boolean, symbols string, name_notes string, src_phylum string, src_class string, src_order string, "
    "src_family string, status string, extra string, campaigns string, n_sites_marked int, n_sites_present int, gbif_key double, gbif_name string, gbif_rank string, "
    "gbif_status string, gbif_accepted string, gbif_match string, gbif_confidence double, gbif_pass int, "
    + ", ".join(f"gbif_{r} string" for r in RANK_COLUMNS)
    + ", family_agrees boolean, family_similarity double",
    "presence": "source string, idx int, site string, present boolean",
    "sites": "source string, waterbody string, site string, lat double, lon double, site_uid string",
    "abundance": "source string, waterbody string, `group` string, campaign string, site string, raw_name string, value double, trait string, canonical string, gbif_key double, gbif_match string",
    "water_quality": "source string, waterbody string, campaign string, site string, parameter string, value double",
    "meta": "source string, glyph_fixes int, totals_row string",
    "repairs": "source string, rank string, damaged string, repaired string",
}
ANSWER = "struct<usageKey:bigint,canonicalName:string,rank:string,status:string,matchType:string,confidence:int,species:string," + ",".join(f"`{r}`:string" for r in RANK_COLUMNS) + ">"
REGISTRY = (
    "id string, file string, kind string, waterbody string, `group` string, year int, cite string, `table` string, table_index int, render string, blank_means_absent boolean, "
    "no_merge boolean, status_cols map<string,string>, symbol_legend map<string,string>, symbol_abstract map<string,int>, status_footer map<string,int>, "
    "status_abstract map<string,int>, reported map<string,int>"
)


def read_csv(spark: SparkSession, path: str, name: str, null_text: str = "") -> DataFrame:
    """A table by the name of its schema. Empty cells are null; so is null_text, as 'null' in the totals of meta. Keys written as 1.0 are read as whole numbers."""
    df = spark.read.schema(SCHEMAS[name]).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", null_text).option("emptyValue", "").csv(path)
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string":
            df = df.withColumn(f.name, F.when(F.col(f.name) != "", F.col(f.name)))
    for key in ("gbif_key", "gbif_confidence"):
        if key in df.columns:
            df = df.withColumn(key, F.col(key).cast("long"))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls as empty cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def as_strings(df: DataFrame) -> DataFrame:
    """All columns as text, unbound values as ''."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The list of source documents, a JSON object per line."""
    return spark.read.schema(REGISTRY).json(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, answer from JSON lines of an authority's answers."""
    return spark.read.schema(f"cache_key string, answer {ANSWER}").json(path)


def unanswered(keys: DataFrame, answers: DataFrame) -> DataFrame:
    """Distinct keys that no answer is kept for."""
    return keys.select("cache_key").distinct().join(answers, "cache_key", "left_anti")


def fetched(keys: DataFrame, ask, attempts: int = 4, pause: float = 1.5) -> DataFrame:
    """cache_key, answer for each key, asked of the authority from the executors.

    ask(key) returns JSON text; after so many failures the answer is an ERROR row, never a failed job.
    """
    import time

    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for key in batch["cache_key"]:
                text = '{"matchType": "ERROR"}'
                for k in range(attempts):
                    try:
                        text = ask(key)
                        break
                    except Exception:  # noqa: BLE001  whatever the network throws
                        time.sleep(pause * (k + 1))
                out.append(text)
            yield pd.DataFrame({"cache_key": batch["cache_key"], "text": out})

    return keys.mapInPandas(run, "cache_key string, text string").select("cache_key", F.from_json("text", ANSWER).alias("answer"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, line_no, line of text files, form feeds kept within lines."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), "value")
    return whole.select("doc_id", F.posexplode(F.split("value", "\r\n|\n|\f")).alias("line_no", "line"))


def query_files(folder: str, suffix: str = ".rq") -> dict[str, str]:
    """Texts of query files by name, in order of name."""
    from pathlib import Path

    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob(f"*{suffix}"))}
