"""Secrets in texts, and credentials whose parts only tell together.

Base spans are found by pattern alone.  Access identifiers, secrets and endpoints that are too weak to
report by themselves are collected as parts; a part is reported when one of a complementary kind lies
within the same scope: an interval join of parts by distance.  The join runs on stretches of one
scope's length: of every stretch and role only the first and last place are kept, which is
enough to tell whether any part of that role is near, so a text full of parts makes no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import Scratch

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Base kinds in the order of their lists: (kind, pattern, group that is measured, least length).
BASE = (
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more, as a run that is measured afterwards
)
#: Weak parts: (kind, role, pattern).
WEAK = (
    ("id", "id", r"(?<![A-Za-z0-9_])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{8,}"),
    ("key", "secret", r"[A-Za-z0-9+/_-]{32,}"),
    ("endpoint", "endpoint", r"(?<![A-Za-z0-9_])(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{4,}"),
)
#: Roles of base spans as complementary parts.
BASE_ROLES = {"assign": "secret", "access": "id", "hex": "secret"}
ROLES = ("id", "secret", "endpoint")
#: Parts at most this many code points apart share a scope.
SCOPE = 300
ORDER = ("assign", "access", "hex", "id", "key", "endpoint")
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass
class Matches:
    """Matches of a pattern as columns: texts, and where each starts in code points."""

    text: Column
    pattern: str

    def found(self) -> Column:
        return F.regexp_extract_all(self.text, F.lit(self.pattern), F.lit(0))

    def between(self) -> Column:
        return F.split(self.text, self.pattern, -1)


def _spans(matches: Column, gaps: Column, kind: int, keep) -> Column:
    """(start, kind, end) of the matches that ``keep`` accepts; ``gaps`` are the texts between matches."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.concat(acc["out"], F.array(span))
        return F.struct(end.alias("at"), F.when(keep(m["match"]), more).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(
        m.alias("match"), g.alias("gap")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _kind_spans(text: Column, kind: str, pattern: str, keep) -> Column:
    hit = Matches(text, pattern)
    spans = _spans(hit.found(), hit.between(), ORDER.index(kind), keep)
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def find_parts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: row number, id, one array of spans per base and weak kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = {}
    for kind, pattern, group, least in BASE:
        def keep(m, pattern=pattern, group=group, least=least):
            return F.length(F.regexp_extract(m, pattern, group)) >= least
        columns[kind] = _kind_spans(F.col("text"), kind, pattern, keep)
    for kind, _, pattern in WEAK:
        columns[kind] = _kind_spans(F.col("text"), kind, pattern, lambda m: F.lit(True))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       text.alias("text"))
    return rows.select("row", "doc_id", *[c.alias(k) for k, c in columns.items()])


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, start, kind, end) of weak parts with a complementary part in scope.

    In scope are parts that end at most ``scope`` before this one starts, or start at most that far
    after it ends; parts that overlap are one thing, not two.  Base spans count as parts of their role.
    """
    role = F.create_map(*[F.lit(x) for k in ORDER for x in (
        ORDER.index(k), ROLES.index(BASE_ROLES.get(k) or next(r for w, r, _ in WEAK if w == k)))])
    parts = found.filter(F.size("id") + F.size("key") + F.size("endpoint") > 0).select(
        "row", F.explode(F.concat(*[F.col(k) for k in ORDER])).alias("s")).select(
        "row", "s.*", role[F.col("s.kind")].alias("role"))
    weak = [ORDER.index(k) for k, _, _ in WEAK]
    # all ends in the stretch before a start's own are early enough, all in its own are near enough
    step = F.lit(scope)
    ends = parts.groupBy("row", F.col("role").alias("other"), F.floor(F.col("end") / step).alias("at")).agg(
        F.min("end").alias("first"), F.max("end").alias("last"))
    starts = parts.groupBy("row", F.col("role").alias("other"), F.floor(F.col("start") / step).alias("at")).agg(
        F.min("start").alias("first"), F.max("start").alias("last"))
    asks = parts.filter(F.col("kind").isin(weak))
    home, goal = F.floor(F.col("start") / step), F.floor(F.col("end") / step)
    apart = F.col("other") != F.col("role")
    before = asks.withColumn("at", F.explode(F.array(home - 1, home))).join(ends, ["row", "at"]).filter(
        apart & F.when(F.col("at") < home, F.col("last") >= F.col("start") - scope).otherwise(
            F.col("first") <= F.col("start")))
    after = asks.withColumn("at", F.explode(F.array(goal, goal + 1))).join(starts, ["row", "at"]).filter(
        apart & F.when(F.col("at") > goal, F.col("first") <= F.col("end") + scope).otherwise(
            F.col("last") >= F.col("end")))
    span = ["row", "start", "kind", "end"]
    return before.select(*span).union(after.select(*span)).distinct()


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(
    docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """Per row: doc_id, base and added (arrays of (start, kind number, end), by start then kind).

    Places are code points, ends are exclusive, kind numbers index ``ORDER``.  A null text counts as
    empty and has no spans; null ids and repeated rows are each searched; texts are searched whole.
    Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(find_parts(docs, id_col, text_col), "parts")
    linked = link_parts(found, scope).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("linked"))  # spans of one text
    base = F.array_sort(F.concat(*[F.col(k) for k, *_ in BASE]))
    both = found.select("row", "doc_id", base.alias("base")).join(linked, "row", "left")
    fresh = F.filter(F.coalesce("linked", F.array().cast(SPAN)), lambda s: ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return both.select("doc_id", "base", F.array_sort(fresh).alias("added"))


def secret_report(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans that ``find_secrets`` returns."""
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{ORDER[k]}")

    counts = [count(k) for k in range(len(BASE))]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_linked"))
