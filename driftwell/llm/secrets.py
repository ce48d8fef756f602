"""Incremental secret scan over a ledger of content-addressed blobs, in DataFrame operations only.

Every version of a text has the address sha2(text, 256). The ledger holds the pairs
(blob, rule version) that were scanned, with their findings. A scan reads only texts
whose pair the ledger lacks, each distinct text once however many rows share it, and
joins findings back to all rows ("paths") of a blob.

Null text counts as empty; null and repeated ids keep one result for each row; columns
other than id and text are dropped; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut_table, join_hot, whole_row


@dataclass(frozen=True)
class Rule:
    """Matches of pattern count if group has at least least characters. hint: a pattern that every such match contains."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: The patterns, their kinds in order, and the least lengths.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:password|passwd|secret|token|api_?key)[\"'\x20:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
RULE_VERSION = "2024-1"
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches in code points. The text between matches and the matches give each start by summation."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(whole)), lambda x: F.length(x).cast("long")).alias("gap"),
        F.transform(whole, lambda x: F.length(x).cast("long")).alias("len"),
        F.transform(value, F.length).alias("val"),
    )
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start, end = state["at"] + x["gap"], state["at"] + x["gap"] + x["len"]
        span = F.struct(start.alias("start"), F.lit(place).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["val"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.when(F.regexp_like(text, F.lit(rule.hint)), F.aggregate(steps, empty, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def find(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start, then kind: array of (start, kind as place in rules, end)."""
    return F.array_sort(F.flatten(F.array(*[_spans(text, r, i) for i, r in enumerate(rules)])))


LEDGER = f"blob string, version string, spans {SPAN}"


def addressed(docs: DataFrame) -> DataFrame:
    """The paths of a version: doc_id and blob (the text's address) for each row of docs, kept as a narrow table."""
    return cut_table(docs.select(F.col("doc_id").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob")))


def unseen(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Rows for the ledger (blob, version, spans): each distinct text of docs whose pair with version the ledger lacks, scanned once."""
    paths = docs.select(F.xxhash64("doc_id").alias("at"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    first = paths.groupBy("blob").agg(F.min("at").alias("at"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("version") == version).select("blob"), "blob", "left_anti")
    # The first row of each new blob carries its text; the small side is hashed, so texts are never sorted.
    texts = paths.join(first.hint("shuffle_hash"), ["blob", "at"], "left_semi")
    scanned = texts.select("blob", find(F.col("text"), rules).alias("spans")).groupBy("blob").agg(F.max("spans").alias("spans"))
    return scanned.select("blob", F.lit(version).alias("version"), "spans")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every row: doc_id, blob, spans; new rows for the ledger: blob, version, spans). The new rows are
    written before they are used: what a run has scanned, it reads back from its ledger."""
    new = cut_table(unseen(docs, ledger, rules, version))
    every = new if ledger is None else new.unionByName(ledger.where(F.col("version") == version).select("blob", "version", "spans"))
    hits = every.where(F.size("spans") > 0).select("blob", "spans")
    found = join_hot(addressed(docs), hits, "blob", "left")
    return found.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")), new


class Ledger:
    """A ledger kept as a table in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
        """Findings of every row of docs; what had to be scanned for them is added to the ledger."""
        found, new = scan(docs, self.rows(), rules, version)
        new.write.mode("append").parquet(self.path)
        return found


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """docs with every found span replaced by mark and n_chars brought up to date; texts without secrets stay as they are."""
    found, _ = scan(docs, None, rules, version)
    # Findings by blob, so that rows with a null or repeated id are not multiplied.
    hits = found.where(F.size("spans") > 0).groupBy("blob").agg(F.max("spans").alias("spans"))
    rows = docs.select(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("blob"), F.col("text").alias("clear"), whole_row(docs))
    joined = rows.join(hits, "blob", "left")

    def cut_at(state: Column, s: Column) -> Column:
        gap = F.col("clear").substr(state["at"].cast("int") + 1, F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    rest = lambda s: F.concat(s["out"], F.col("clear").substr(s["at"].cast("int") + 1, F.length("clear")))
    clean = F.aggregate(F.col("spans"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), cut_at, rest)
    masked = joined.select("row", F.when(F.col("spans").isNotNull(), clean).alias("masked"))
    new = {"text": F.coalesce("masked", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("masked").cast(docs.schema["n_chars"].dataType), F.col("row")["n_chars"])
    return masked.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
