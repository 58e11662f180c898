"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of a text is addressed by its SHA-256. The ledger remembers which pairs of
blob and rule version were scanned; an update scans the unseen pairs only, once per blob
however many paths hold it, and findings are joined back to all paths. All of it is
DataFrame work: the regular expressions run in the JVM, and positions come from the lengths
of what lies between the matches.

Defined cases: a null text is the empty blob; a null path is a path like any other; repeated
rows share their blob and each get its findings; an empty table gives an empty result; other
columns of the input are not read. Texts are scanned whole, of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Matches are whole runs, so the least length may stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

#: Further kinds of credentials, by their public prefixes.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # With the lines of the key, up to its end line or to where they stop; no part is looked at twice.
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s++[A-Za-z0-9+/=]{32,}+)*+"
        r"(?:\s++[A-Za-z0-9+/=]++(?=\s*+-----END))?+(?:\s*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?+",
        version=2,
    ),
)

RULES = BASE_RULES + MORE_RULES


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _parts(text: Column, rule: Rule) -> Column:
    """Per match the code points before it (since the last one), its own and its group's."""
    pattern = F.lit(rule.pattern)

    def lengths(items: Column) -> Column:
        return F.transform(items, F.length)

    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    group = whole if rule.group == 0 else lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    return F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"), whole.alias("size"), group.alias("kept")
    )


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (blob, rule_version, kind, start, end) of ``blobs`` (blob, text, todo), where
    ``todo`` lists the rule versions to apply. Positions are code points, the end exclusive."""
    text = F.col("text")
    hits = [
        F.when(
            F.array_contains("todo", rule.key) & text.rlike(rule.pattern),
            F.struct(F.lit(n).alias("rule"), _parts(text, rule).alias("parts")),
        )
        for n, rule in enumerate(rules)
    ]
    rows = (
        blobs.select("blob", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        .select("blob", "hit.rule", F.posexplode("hit.parts").alias("n", "part"))
        .where("part.size IS NOT NULL")
    )
    upto = Window.partitionBy("blob", "rule").orderBy("n")
    end = F.sum(F.col("part.gap") + F.col("part.size")).over(upto)

    def of(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)

    return (
        rows.withColumn("end", end.cast("bigint"))
        .where(F.col("part.kept") >= of([rule.least for rule in rules]))
        .select(
            "blob",
            of([rule.key for rule in rules]).alias("rule_version"),
            of([rule.kind for rule in rules]).alias("kind"),
            (F.col("end") - F.col("part.size")).alias("start"),
            "end",
        )
    )


class BlobLedger:
    """The ledger: two Parquet tables, ``scanned`` (blob, rule_version) and ``findings``.

    Findings are appended before the pairs are marked as scanned, and read as a set: an
    update that broke off between the two is repeated without harm.
    """

    SCANNED = "blob string, rule_version string"
    FINDINGS = "blob string, rule_version string, kind string, start bigint, end bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> BlobLedger:
        ledger = cls(spark, path)
        spark.createDataFrame([], cls.SCANNED).write.parquet(f"{path}/scanned")
        spark.createDataFrame([], cls.FINDINGS).write.parquet(f"{path}/findings")
        return ledger

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.path}/scanned")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        found = self.spark.read.schema(self.FINDINGS).parquet(f"{self.path}/findings")
        return found.where(F.col("rule_version").isin([r.key for r in rules])).distinct()

    def update(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what is new in ``texts`` (column text)."""
        blobs = texts.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        seen = self.scanned().groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        every = F.array(*[F.lit(rule.key) for rule in rules])

        def unseen(frame: DataFrame) -> DataFrame:
            todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
            return frame.join(seen, "blob", "left").withColumn("todo", todo).drop("seen").where(F.size("todo") > 0)

        # One copy of each blob; copies meet in their map task first.
        new = unseen(blobs.groupBy("blob").agg(F.first("text").alias("text")))
        scan(new, rules).write.mode("append").parquet(f"{self.path}/findings")
        marks = unseen(blobs.select("blob").distinct())
        marks.select("blob", F.explode("todo").alias("rule_version")).write.mode("append").parquet(
            f"{self.path}/scanned"
        )


def findings_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob: its spans by start, then kind as listed (blob, spans)."""
    order = F.element_at(F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)]), F.col("kind"))
    span = F.struct("start", order.alias("place"), "end", "kind")
    return findings.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def find_secrets(
    texts: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Every row of ``texts``, with its blob and the array ``spans`` (empty if none)."""
    ledger.update(texts.select("text"), rules)
    found = findings_by_blob(ledger.findings(rules), rules)
    none = F.array().cast(found.schema["spans"].dataType)
    paths = texts.withColumn("blob", blob_of(F.col("text")))
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or each run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("upto"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["upto"]
        between = F.substring(text, (state["upto"] + 1).cast("int"), (span["start"] - state["upto"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"]).alias("out"),
            F.greatest(state["upto"], span["end"]).alias("upto"),
        )

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["upto"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))
