"""Secrets: a ledger of content-addressed blobs, each scanned once by each version of each rule.

Every version of every path is a blob, named by the SHA-256 of its text. Only (blob, rule version)
pairs that the ledger does not hold are scanned, each distinct blob once however many paths and
versions carry it; the findings are joined back to all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .spans import SPAN, as_text, count_kind, matches, no_spans, replaced

#: Kinds in the order that breaks ties of position; the first three are always kept.
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """A pattern under a version; a change of the pattern needs a new version to be scanned for."""

    kind: str
    version: int
    pattern: str
    rank: int
    guard: str  # a cheap pattern that every text with a match has

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
RULES = (
    Rule("assign", 1, _ASSIGN, 0, r"(?i)password|passwd|secret|token|api_?key"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", 1, "AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+", 2, r"[0-9a-f]{24}"),
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[^-]*+(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", 3, "PRIVATE KEY-----"),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+", 4, "gh[pousr]_"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 5, "eyJ"),
)
#: What a ledger's row holds: a blob, the rule versions it was scanned for, and under which of them what was found.
FOUND = "array<struct<rule:string,span:struct<start:bigint,rank:int,stop:bigint,kind:string,score:double>>>"
LEDGER = f"blob string, rules array<string>, found {FOUND}"


def _scan(text: Column, rule: Rule) -> Column:
    """What one rule finds in a text, as SPAN."""
    found = matches(text, rule.pattern)
    if rule.kind == "assign":  # the value is the last group; a shorter one drops the match, which is not tried again
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], _ASSIGN, 1)) >= 6)
    made = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rule.rank).alias("rank"), m["stop"].alias("stop"),
            F.lit(rule.kind).alias("kind"), F.lit(1.0).alias("score"),
        ),
    )
    return F.when(text.rlike(rule.guard), made.cast(SPAN)).otherwise(no_spans())


def _guards(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether any rule can match: one cheap search that most texts fail, and no text with a match does."""
    found = F.lit(False)
    for rule in rules:
        found = found | text.rlike(rule.guard)
    return found


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rules, found) of distinct blobs (blob, text), for the rule versions that ``ledger`` lacks.

    A blob in which nothing is found gets a row too, since it has been scanned.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.select("blob", "text", keys.alias("rules"))
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        left = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.join(seen, "blob", "left").select("blob", "text", left.alias("rules")).where(F.size("rules") > 0)
    found = [F.when(F.array_contains("rules", r.key), _scan(F.col("text"), r)).otherwise(no_spans()) for r in rules]
    under = lambda spans, key: F.transform(spans, lambda s: F.struct(F.lit(key).alias("rule"), s.alias("span")))
    return blobs.select("blob", "rules", F.concat(*[under(spans, r.key) for r, spans in zip(rules, found)]).cast(FOUND).alias("found"))


def _hits(fresh: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(hit, __found): what the ledger holds under just these rule versions, of blobs with findings, each finding once."""
    keys = [r.key for r in rules]
    spans = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda f: f["rule"].isin(keys)), lambda f: f["span"])))
    if ledger is None:
        return fresh.where(F.size("found") > 0).select(F.col("blob").alias("hit"), spans(F.col("found")).alias("__found"))
    both = fresh.select("blob", "found").unionByName(ledger.select("blob", "found")).where(F.size("found") > 0)
    # written, for Spark splits a hot blob's rows only where nothing but the join wants them together
    return written(both.groupBy("blob").agg(spans(F.flatten(F.collect_list("found"))).alias("__found")).withColumnRenamed("blob", "hit"), "hits")


def secrets(
    versions: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "found",
    rules: tuple[Rule, ...] = RULES,
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings by row, ledger rows to append).

    The first has ``id_col`` and ``out`` for every row of ``versions``, repeated rows and null ids
    included; a null or empty text has no findings; other columns are left out, whatever their names.
    The second holds what this scan adds to the ledger.

    One pass over the texts names each blob and keeps the text only where some rule can match; only
    those texts are exchanged, and copies are dropped before the exchange where they meet in a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = versions.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), F.when(_guards(text, rules), text).alias("text"))
    named = written(named, "versions")
    scanned = scan_blobs(named.where(F.col("text").isNotNull()).select("blob", "text").dropDuplicates(["blob"]), rules, ledger)
    idle = named.where(F.col("text").isNull()).select("blob").distinct()
    idle = scan_blobs(idle.withColumn("text", F.lit("")), rules, ledger)
    fresh = written(scanned.unionByName(idle), "ledger")
    hits = _hits(fresh, ledger, rules)
    rows = named.where(F.col("text").isNotNull()).select("id", "blob")
    joined = rows.join(hits, rows["blob"] == hits["hit"], "left").select("id", F.coalesce("__found", no_spans()).alias(out))
    rest = named.where(F.col("text").isNull()).select("id", no_spans().alias(out))
    return joined.unionByName(rest).withColumnRenamed("id", id_col), fresh


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with each secret in ``text_col`` replaced by its kind in brackets; all rows and columns stay.

    Texts in which no rule can match stay where they are; the others meet the ledger by their blob.
    A null text stays null.
    """
    own = F.col(f"`{text_col}`")
    text = F.coalesce(own, F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.sha2(text, 256).alias("blob"), _guards(text, rules).alias("can"))
    plain, able = named.where(~F.col("can")).select("doc"), named.where(F.col("can")).select("doc", "blob")
    blobs = able.select("blob", F.col("doc").getField(text_col).alias("text")).dropDuplicates(["blob"])
    fresh = written(scan_blobs(blobs, rules, ledger), "ledger")
    hits = _hits(fresh, ledger, rules)
    text = F.col("doc").getField(text_col)
    mended = able.join(hits, able["blob"] == hits["hit"], "left").select("doc", replaced(text, F.coalesce("__found", no_spans())).alias("text"))
    back = lambda c: F.col("doc").getField(c)
    clean = mended.select(*[F.col("text").alias(c) if c == text_col else back(c).alias(c) for c in docs.columns])
    return plain.select(*[back(c).alias(c) for c in docs.columns]).unionByName(clean)


def digest(found: DataFrame, id_col: str = "doc_id", out: str = "found") -> DataFrame:
    """Counts and digests of what ``secrets`` returns."""
    base = lambda s: s["kind"].isin(*BASE)
    return found.select(
        F.col(id_col),
        *[count_kind(F.col(out), k).alias(f"n_{k}") for k in BASE],
        F.sha2(as_text(F.filter(out, base)), 256).alias("base_sha256"),
        as_text(F.col(out)).alias("spans"),
    )
