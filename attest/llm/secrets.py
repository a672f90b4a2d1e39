"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger table holds, for each blob and rule
version, what a scan found. A run joins all versions with the ledger by blob, so that equal texts meet; blobs that the ledger
does not hold under the current rules are scanned, the first of equal ones only, and all paths get the findings of their blob.
Texts are shuffled once.
"""
from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..session import checkpoint_folder
from .common import materialise, small_batches, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if `group` has at least `least` characters; matches never overlap in a kind.

    cue: characters without which no match is possible, or nothing. whole: the group that is the secret, or all of the match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False
    base: bool = False
    cue: str = ""
    whole: int = 0


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True),
)
# Kinds beyond these, from the published forms of such keys.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", cue="PRIVATE KEY"),
    # From the first mark of a run of token characters on; nothing of a run is looked at twice.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", cue="eyJ", whole=1),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}", cue="gh"),
    Rule("chat_token", r"xox[abeprs]-[A-Za-z0-9-]{10,}", cue="xox"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:([^\s/@]{3,128})@", 1, cue="://"),
)
RULES = BASE + MORE


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        # A run of at least `least` characters can be asked for at once where the whole match is one run.
        self.rules = [(r, re.compile(self._long(r), re.ASCII | (re.IGNORECASE if r.fold else 0))) for r in rules]

    @staticmethod
    def _long(rule: Rule) -> str:
        single = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
        return f"{single[1]}{{{rule.least},}}" if single and not rule.group else rule.pattern

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule number) of all matches, by start, then rule."""
        out = []
        for number, (rule, pattern) in enumerate(self.rules):
            if rule.cue and rule.cue not in text:
                continue
            out += [(m.start(rule.whole), m.end(rule.whole), number) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return sorted(out, key=lambda s: (s[0], s[2], s[1]))


SPANS = "spans array<struct<kind: string, start: long, end: long>>"
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Ledger:
    """The table of scanned blobs, in a folder that all executors share: blob, spans, and rule_version as partition."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def scanned(self, version: str) -> DataFrame:
        """blob and spans of what was scanned under a rule version, one row for each blob."""
        schema = f"blob string, {SPANS}"
        try:
            # Two runs at once may both have scanned a blob, with the same findings.
            return self.spark.read.schema(schema).parquet(f"{self.path}/rule_version={version}").groupBy("blob").agg(F.first("spans").alias("spans"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return self.spark.createDataFrame([], schema)
            raise

    def add(self, found: DataFrame, version: str) -> None:
        """Spark commits a scan as a whole: after a failure nothing of it is in the ledger, and the next run scans it again."""
        found.write.mode("append").parquet(f"{self.path}/rule_version={version}")


def blob(text: Column) -> Column:
    """The content address of a text; a null is an empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


SHARE = 1000  # a blob that holds more than one of so many rows is dealt to several tasks; there are fewer than SHARE of them


def scan(documents: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns of every row, its blob, and its spans; repeated rows and versions keep rows of their own.

    Spans: kind, start and end in code points, by start, then kind as listed. A null text is an empty one. The rows of a blob and what
    the ledger has of it meet in one task, those of a hot blob in several; each scans it once, and the ledger gets one row for it.
    """
    version = rules_version(rules)
    kept = [f"__{i}" for i in range(len(keep))]
    text = kept[keep.index(text_col)] if text_col in keep else "__text"  # a text that is kept travels once
    rows = documents.select(*(F.col(c).alias(k) for c, k in zip(keep, kept)), *([] if text_col in keep else [F.col(text_col).alias(text)]), blob(F.col(text_col)).alias("__blob"))
    carried = [*kept, *([] if text_col in keep else [text])]
    sizes = materialise(rows.groupBy("__blob").count(), "blob-sizes")
    most = (sizes.agg(F.sum("count")).first()[0] or 0) / SHARE
    hot = sizes.filter(F.col("count") > max(1, most)).filter(F.col("count") > SHARE).select("__blob", F.ceil(F.col("count") / F.lit(max(1.0, most))).cast("int").alias("__shares"))
    share = F.pmod(F.monotonically_increasing_id(), F.coalesce("__shares", F.lit(1))).cast("int")
    rows = rows.join(F.broadcast(hot), "__blob", "left").select(*carried, "__blob", share.alias("__share"), F.lit(1).alias("__kind"), F.lit(None).cast(SPANS.split(" ", 1)[1]).alias("__known"))
    known = ledger.scanned(version).select(F.col("blob").alias("__blob"), F.col("spans").alias("__known")).join(sizes.select("__blob"), "__blob", "left_semi") \
        .join(F.broadcast(hot), "__blob", "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1)))
    met = rows.union(known.select(*(F.lit(None).alias(k) for k in carried), "__blob", "__share", F.lit(0), "__known")) \
        .repartition("__blob", "__share").sortWithinPartitions("__blob", "__share", "__kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(rules)
        kinds = [r.kind for r in rules]
        last, spans = None, None
        for batch in batches:
            texts, blobs, kind, known = batch.column(text), batch.column("__blob").to_pylist(), batch.column("__kind").to_pylist(), batch.column("__known")
            place, found, new = [], [], []
            for i, name in enumerate(blobs):
                fresh = name != last
                if not kind[i]:  # what the ledger has of the rows that follow
                    last, spans = name, known[i].as_py()
                    continue
                if fresh:
                    last, spans = name, [{"kind": kinds[n], "start": a, "end": b} for a, b, n in s.spans(texts[i].as_py() or "")]
                place.append(i)
                found.append(spans)
                new.append(fresh)
            own = batch.select([*kept, "__blob"]).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, FOUND), pa.array(new, pa.bool_())], [*kept, "blob", "spans", "new"])

    small_batches(documents.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"{k} {types[c]}" for c, k in zip(keep, kept)), "blob string", SPANS, "new boolean"])
    out = materialise(met.select(*carried, "__blob", "__kind", "__known").mapInArrow(run, schema), "scanned-versions")
    ledger.add(out.filter("new").groupBy("blob").agg(F.first("spans").alias("spans")), version)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept)), "blob", "spans")


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{checkpoint_folder(spark)}/attest/secret-ledger-{uuid.uuid4().hex}")


def scanned_twice(documents: DataFrame, later: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """run, versions, blobs, scanned and findings of two runs over one ledger: the second one scans only what the first has not seen.

    Both are tables of versions with doc_id and text.
    """
    out = None
    for number, versions in enumerate((documents, later), 1):
        before = materialise(ledger.scanned(rules_version(rules)), "ledger-before")
        found = scan(versions, ledger, rules)
        row = found.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("blob").alias("blobs"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).cast("long").alias("findings"))
        new = ledger.scanned(rules_version(rules)).join(before, "blob", "left_anti").agg(F.count(F.lit(1)).alias("scanned"))
        row = row.withColumn("one", F.lit(1)).join(new.withColumn("one", F.lit(1)), "one").select(F.lit(number).alias("run"), "versions", "blobs", "scanned", "findings")
        # Counted before the next run adds to the ledger: in one plan two reads of its folder count as the same, whatever files each has listed.
        row = materialise(row, "ledger-run")
        out = row if out is None else out.union(row)
    return out


def op8_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in every document; the ledger starts empty, so every distinct text is scanned once."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*(r.kind for r in BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(table(spark, d, "documents"), new_ledger(spark)).select(
        "doc_id", *(count(r.kind) for r in BASE), F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def secret_versions(spark: SparkSession, d: str) -> DataFrame:
    """Two scans over one ledger: all documents, then all of them again with labelled ones changed; the second scans the changed ones."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    marked = table(spark, d, "labels").select("doc_id", F.lit(" token = changed-in-version-2").alias("more")).distinct()
    later = docs.join(marked, "doc_id", "left").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce("more", F.lit(""))).alias("text"))
    return scanned_twice(docs, later, new_ledger(spark)).drop("findings")


SECRET_VERSIONS_SQL = r"""
with docs as (select doc_id, coalesce(text, '') t from documents),
later as (select d.doc_id, case when exists (select 1 from labels l where l.doc_id = d.doc_id) then t || ' token = changed-in-version-2' else t end t from docs d)
select 1::int run, (select count(*) from docs) versions, (select count(distinct t) from docs) blobs, (select count(distinct t) from docs) scanned
union all
select 2::int, (select count(*) from later), (select count(distinct t) from later), (select count(distinct t) from later where t not in (select t from docs))
"""
