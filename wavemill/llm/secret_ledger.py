"""Secret scans by an incremental blob ledger, DataFrame functions only.

Every text version is content-addressed (SHA-256 of its UTF-8 bytes). The ledger is two tables in a folder: ``scanned``
(blob, rule, rule_version) and ``findings`` (blob, rule, rule_version, spans). A scan looks up which pairs of blob and
rule version are not in the ledger, reads one carrier row per unseen blob, appends, and joins findings back to every
row (path) that carries the blob. Scanning a second time, or after adding rows, reads only what is new; a rule with a
new version is scanned again alone.

Matches are leftmost and non-overlapping per rule; a match shorter than the rule asks is dropped after matching.
Positions are code points, end exclusive: the pieces between matches and the matches are laid end to end. Running
sums are windows over the matches of one text, so a text with very many matches needs no growing array. Every pattern reads
a text in time linear in its length: a run of characters that a pattern takes in whole is entered at its beginning only.

The registered query starts from an empty ledger; a caller that names a folder scans only what is new in it.

Null text counts as empty, a null id is kept. Repeated rows get the findings of their text each, rows of one id and
different texts those of their own. Very long texts are matched whole. An empty table gives an empty result. Only the id
and text columns are used, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, scratch_dir


@dataclass(frozen=True)
class Rule:
    """least: code points that capture group ``group`` (0: the match) needs. hint: a cheap condition that every match implies."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# The patterns, their smallest lengths and their order.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, r"(?i:passw(?:or)?d|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
# Further rules, same form; their order follows that of the first ones.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 30, r"PRIVATE KEY"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40, r"gh[oprsu]_"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]+", 0, 20, r"xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39, r"AIza"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24, r"k_live_"),
)
ALL_RULES = RULES + MORE_RULES
FINDINGS = "blob string, rule string, rule_version int, start long, end long"
SCANNED = "blob string, rule string, rule_version int"


def _read(docs: DataFrame, path: str, schema: str) -> DataFrame:
    """The ledger table, empty before the first scan."""
    spark = docs.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def matches(texts: DataFrame, rule: Rule) -> DataFrame:
    """(blob, text) -> (blob, rule, rule_version, start, end) of the rule's matches that are long enough."""
    # A run of 16 hex digits is found by its whole-run pattern; shorter runs could only be dropped again.
    pattern = rf"[0-9a-f]{{{rule.least},}}" if rule.pattern == r"[0-9a-f]+" else rule.pattern
    hit = texts.where(F.col("text").rlike(rule.hint))
    hit = hit.select("blob", F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits"))
    hit = hit.where(F.size("hits") > 0).select("blob", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("hits")).alias("gap"), F.col("hits").alias("hit"))).alias("nr", "m"))
    laid = W.partitionBy("blob").orderBy("nr").rowsBetween(W.unboundedPreceding, 0)
    hit = hit.select("blob", F.col("m.hit").alias("hit"), F.sum(F.length("m.gap") + F.length("m.hit")).over(laid).alias("end"))
    found = F.col("hit") if rule.group == 0 else F.regexp_extract("hit", pattern, rule.group)
    hit = hit.where(F.length(found) >= rule.least)
    return hit.select("blob", F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("rule_version"), (F.col("end") - F.length("hit")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def scan(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """Bring the ledger up to date; returns (id, blob, may: some rule can match) of every row. The ledger folder must be shared by all executors."""
    spark, batch = docs.sparkSession, scratch_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    may = F.col("text").rlike("|".join(r.hint for r in rules))  # some rule can match
    texts.select("id", F.sha2("text", 256).alias("blob"), may.alias("may")).write.parquet(f"{batch}/rows")
    rows = spark.read.parquet(f"{batch}/rows")
    scanned = _read(docs, f"{ledger}/scanned", SCANNED)
    known = scanned.where(" or ".join(f"(rule = '{r.name}' and rule_version = {r.version})" for r in rules)).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    # one carrier row per blob, counted before anything is shuffled; blobs with all rules done leave here
    carriers = rows.groupBy("blob").agg(F.min("id").alias("carrier"), F.max("may").alias("may")).join(known, "blob", "left")
    carriers = carriers.where(F.coalesce(F.size("done"), F.lit(0)) < len(rules)).select("blob", "carrier", "may", F.coalesce("done", F.array().cast("array<string>")).alias("done"))
    carriers.write.parquet(f"{batch}/unseen")
    unseen = spark.read.parquet(f"{batch}/unseen")
    # only texts in which some rule can match go on; they are few and are written once for all rules
    wanted = unseen.where("may").select("blob", "carrier", "done")
    found = texts.where(may).join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("carrier"))).where(F.sha2("text", 256) == F.col("blob"))
    found.select("blob", "text", "done").write.parquet(f"{batch}/candidates")
    candidates = spark.read.parquet(f"{batch}/candidates").dropDuplicates(["blob"])
    found = None
    for rule in rules:
        one = matches(candidates.where(~F.array_contains("done", rule.name)).select("blob", "text"), rule)
        found = one if found is None else found.unionByName(one)
    found.write.mode("append").parquet(f"{ledger}/findings")
    # findings first: a run that is lost in between only scans again; duplicates fall away when read
    pairs = unseen.select("blob", F.explode(F.array_except(F.array(*(F.lit(r.name) for r in rules)), "done")).alias("rule"))
    version = F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version)))), F.col("rule"))
    pairs.select("blob", "rule", version.alias("rule_version")).write.mode("append").parquet(f"{ledger}/scanned")
    return rows


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """(blob, rule, start, end) of the rules' current versions, each once."""
    current = " or ".join(f"(rule = '{r.name}' and rule_version = {r.version})" for r in rules)
    return _read(docs, f"{ledger}/findings", FINDINGS).where(current).select("blob", "rule", "start", "end").distinct()


def secrets_by_row(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """One row per input row: id, n_<rule> of each rule, spans (kind:start:end by start, then rule order, comma-joined)."""
    ledger = ledger or scratch_dir(docs.sparkSession)
    rows = scan(docs, ledger, id_col, text_col, rules)
    order = F.element_at(F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k)))), F.col("rule"))
    span = F.struct("start", order.alias("place"), F.concat_ws(":", "rule", "start", "end").alias("said"))
    per_blob = findings(docs, ledger, rules).groupBy("blob").agg(
        *(F.count_if(F.col("rule") == r.name).alias(f"n_{r.name}") for r in rules),
        F.array_join(F.transform(F.sort_array(F.collect_list(span)), lambda s: s["said"]), ",").alias("spans"),
    )
    # rows that no rule can match look up nothing; copies of one blob may be a third of the others
    out = join_hot(rows.where("may"), per_blob, ["blob"], F.col("id")).unionByName(rows.where("not may"), allowMissingColumns=True)
    return out.select(F.col("id").alias(id_col), *(F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in rules), F.coalesce("spans", F.lit("")).alias("spans"))
