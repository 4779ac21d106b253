"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of the text. The ledger, a
table in the shared folder, holds which (blob, rule, rule version) pairs were scanned and what was found.
A scan reads each unseen pair once, whatever the number of paths that hold the blob, appends to the
ledger, and joins findings back to all paths. Raising a rule's version scans the known blobs again for
that rule alone.

Spans come from the gaps between matches (split) and the matches (regexp_extract_all), so they are code
points, as long as length() counts those.

Defined results: a null text counts as empty (no findings); an empty table gives an empty result; all
paths of a blob get its findings; repeated rows give repeated results; other columns are kept, but for such named
blob or spans, which the results replace.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """kind; its place among the kinds; version; pattern; the group whose length counts, and its least length."""

    kind: str
    order: int
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules. For access and hex the least length is part of the pattern: their matches
#: are whole runs, so that a failing one hides none that would pass.
RULES = (
    Rule("assign", 0, 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 2, 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Findings of at most this many bytes in all are broadcast to the paths; beyond, both are joined by blob.
BROADCAST_BYTES = 16 << 20
SPANS = "array<struct<start:int,kind_order:int,end:int,rule:string>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the leftmost non-overlapping matches that pass the rule's length."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(
        F.arrays_zip(whole.alias("w"), part.alias("p")),
        F.slice(gaps, 1, F.size(whole)),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m["w"]).alias("long"), (F.length(m["p"]) >= rule.least).alias("kept")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + s["gap"]
        last = first + s["long"]
        span = F.struct(first.alias("start"), F.lit(rule.order).alias("kind_order"), last.alias("end"), F.lit(rule.name).alias("rule"))
        return F.struct(last.alias("at"), F.when(s["kept"], F.array_append(acc["found"], span)).otherwise(acc["found"]).cast(SPANS).alias("found"))

    found = F.aggregate(steps, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


class Ledger:
    """blob, rules (scanned in this row) and spans (what they found), appended to by each scan."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"blob string, rules array<string>, spans {SPANS}").parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def addressed(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """versions with blob, the content address of the text, in place of any columns blob and spans."""
    blob = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("blob")
    return versions.select(*(c for c in (F.col(f"`{n}`") for n in versions.columns if n.lower() not in ("blob", "spans"))), blob)


def scan(texts: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> None:
    """texts: text, of any number of copies. Scans pairs of blob and rule version that the ledger lacks."""
    names = F.array(*(F.lit(r.name) for r in rules))
    rows = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    blobs = rows.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("blob")).agg(F.first("text").alias("text"))
    known = ledger.rows()
    if known is None:
        pending = blobs.withColumn("rules", names)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        none = F.array().cast("array<string>")
        pending = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", none))).where(F.size("rules") > 0)
    empty = F.array().cast(SPANS)
    each = [F.when(F.array_contains("rules", r.name), spans(F.col("text"), r)).otherwise(empty) for r in rules]
    ledger.add(pending.select("blob", "rules", F.concat(*each).alias("spans")))


def findings(ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and spans under the given rule versions, for blobs that have any."""
    current = F.array(*(F.lit(r.name) for r in rules))
    own = ledger.rows().select("blob", F.filter("spans", lambda s: F.array_contains(current, s["rule"])).alias("spans"))
    own = own.where(F.size("spans") > 0)
    return own.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def scanned(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """versions with blob and spans: an array of (start, kind_order, end, rule) by start, then kind."""
    scan(versions.select(F.col(text_col).alias("text")), ledger, rules)
    found = written(findings(ledger, rules), "findings")
    size = found.agg(F.coalesce(F.sum(100 + 40 * F.size("spans")), F.lit(0)).alias("n")).first()["n"]
    every = addressed(versions, text_col).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "blob", "left")
    return every.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def number(spans_col: Column, rule: Rule) -> Column:
    """How many of the spans are of the rule's kind."""
    return F.size(F.filter(spans_col, lambda s: s["kind_order"] == rule.order)).cast("long")


def joined(spans_col: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in sorted(rules, key=lambda r: r.order)))
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", F.get(kinds, s["kind_order"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans_col: Column, mask: str = "[secret]") -> Column:
    """text with each span replaced by mask; overlapping spans are masked once."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans_col, start, step)
    return F.when(F.size(spans_col) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
