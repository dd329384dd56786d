"""Secret scanning with an incremental ledger of blobs.

Every version of every text is named by the SHA-256 of its content. The ledger holds which blobs were scanned by
which version of which rule, and what was found; a run scans only pairs of blob and rule version that it lacks,
each blob once however many paths have it, and joins what is known of a blob back to all its paths. A run adds
files of its own to the ledger's folder and rewrites none.

Only texts with one of the rules' literal anchors, which any match must contain, leave the scan's own task: a
text without one has its pairs entered in the ledger as scanned. So blobs are compared by their hashes, and the
few texts with anchors are all that a shuffle carries.

Defined cases. Rows without a doc_id are left out; rows that repeat a doc_id are versions of one path. Null texts
are no blob; empty texts are one, without findings. Equal secrets in one blob are separate findings, numbered in
order. Findings never hold a secret itself, only its SHA-256 and length. Columns other than doc_id and text are
never read; ``remove`` keeps them. No rows in, no rows out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm.common import BROADCAST_BYTES, keyed, shared_dir, stored, stored_bytes, table, with_ids


@dataclass(frozen=True)
class Rule:
    """A rule's pattern has the secret as group 1; anchor is a pattern that occurs in every text the rule matches."""

    name: str
    version: int
    anchor: str
    pattern: str

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


_BEFORE = "(?:^|[^A-Za-z0-9_])"
#: What may follow a keyword in the name that a secret is assigned to; before the keyword anything may stand.
_NAME = "[A-Za-z0-9_.-]*"
RULES = (
    Rule("aws_access_key", 1, "AKIA|ASIA", _BEFORE + "((?:AKIA|ASIA)[A-Z0-9]{16})"),
    Rule("github_token", 1, "gh[pousr]_", _BEFORE + "(gh[pousr]_[A-Za-z0-9]{36,})"),
    Rule("slack_token", 1, "xox[abprs]-", _BEFORE + "(xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("google_api_key", 1, "AIza", _BEFORE + "(AIza[0-9A-Za-z_-]{35})"),
    Rule("payment_key", 1, "[rs]k_live_", _BEFORE + "([rs]k_live_[0-9A-Za-z]{16,})"),
    Rule("json_web_token", 1, "eyJ", _BEFORE + r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("private_key", 1, "PRIVATE KEY-----", "(-----BEGIN (?:[A-Z]{2,12} )?PRIVATE KEY-----)"),
    Rule("password", 3, "(?i:passw|pwd)", "(?i)(?:passw(?:or)?d|pwd)" + _NAME + """["']?[ \\t]*[:=][ \\t]*["']?([^ \\t\\r\\n"',;]{8,})"""),
    Rule("keyed_token", 2, "(?i:token|secret|(?:api|access).?key)", "(?i)(?:token|secret|(?:api|access)[_.-]?key)" + _NAME + """["']?[ \\t]*[:=][ \\t]*["']?([A-Za-z0-9_/+=-]{16,})"""),
)


#: The rules before those that go by names.
EARLIER = RULES[:-2]


@dataclass(frozen=True)
class Ledger:
    """seen(blob_id, rules): the rules, as name@version, that a blob was scanned by, maybe in several rows; findings(blob_id, rule_id,
    rule_version, match_no, secret_sha256, secret_chars). Of a ledger that ``scan`` gives, new_seen and new_findings are what that run added."""

    seen: DataFrame
    findings: DataFrame
    new_seen: DataFrame | None = None
    new_findings: DataFrame | None = None
    run: str = ""

    @property
    def scanned(self) -> DataFrame:
        """blob_id, rule_id, rule_version: the pairs themselves."""
        rule = F.split(F.col("rule"), "@")
        return self.seen.select("blob_id", F.explode("rules").alias("rule")).distinct().select("blob_id", rule[0].alias("rule_id"), rule[1].cast("int").alias("rule_version"))

    def save(self, path: str) -> None:
        """Add what the run found to the ledger in a folder, under the run's own name: nothing older is read or written again, and
        saving twice is saving once. Findings go first, so that no pair counts as scanned before they are there."""
        self.new_findings.write.mode("overwrite").parquet(f"{path}/findings/run={self.run}")
        self.new_seen.write.mode("overwrite").parquet(f"{path}/seen/run={self.run}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ledger:
        """The ledger of all runs in the folder. A run that broke off before its pairs were written left findings that the next one found again."""
        found = spark.read.parquet(f"{path}/findings").drop("run").dropDuplicates(["blob_id", "rule_id", "rule_version", "match_no"])
        return Ledger(spark.read.parquet(f"{path}/seen").drop("run"), found)


def _matches(r: Rule, todo: Column) -> Column:
    found = F.when(todo, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda m, i: F.struct(F.lit(r.name).alias("rule_id"), F.lit(r.version).alias("rule_version"), (i + 1).alias("match_no"), F.sha2(m, 256).alias("secret_sha256"), F.length(m).alias("secret_chars")))


def scan(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Ledger]:
    """Versions (doc_id, blob_id), and the ledger with the pairs and findings of this run added.

    With a ledger the pairs it lacks are looked up first, by hashes alone. Texts of blobs that lack none are never searched where
    the others are few enough to be broadcast; else only texts with an anchor of a lacking rule are shuffled to meet theirs."""
    texts = keyed(docs, F.col("text").cast("string").alias("text")).filter("text is not null")
    blob = F.unhex(F.sha2("text", 256)).alias("blob_id")
    versions = stored(texts.select("doc_id", blob).distinct(), "versions")
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.select("blob_id").distinct()
    wanted = texts.select(blob, "text")
    if ledger is None:
        new_seen, lacking = blobs.withColumn("rules", keys), list(rules)
        todo = lambda r: F.lit(True)
    else:
        seen = ledger.seen.groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        left = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        new_seen = stored(blobs.join(seen, "blob_id", "left").select("blob_id", left.alias("rules")).filter(F.size("rules") > 0), "unscanned")
        keys_left = {x["rule"] for x in new_seen.select(F.explode("rules").alias("rule")).distinct().collect()}  # at most one row a rule
        lacking = [r for r in rules if r.key in keys_left]
        todo = lambda r: F.array_contains("rules", r.key)
        if stored_bytes(new_seen) * 4 <= BROADCAST_BYTES:
            wanted = wanted.join(F.broadcast(new_seen.select("blob_id")), "blob_id", "left_semi")
    anchors = "|".join(f"(?:{r.anchor})" for r in lacking)
    anchored = wanted.filter(F.col("text").rlike(anchors) if lacking else F.lit(False)).groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger is not None:
        anchored = anchored.join(new_seen, "blob_id")
    hits = F.concat(*[_matches(r, todo(r)) for r in lacking or rules])
    found = stored(anchored.select("blob_id", F.explode(hits).alias("h")).select("blob_id", "h.*"), "findings")
    before = (ledger.seen, ledger.findings) if ledger is not None else (new_seen.limit(0), found.limit(0))
    return versions, Ledger(before[0].unionByName(new_seen), before[1].unionByName(found), new_seen, found, uuid.uuid4().hex)


def findings(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every finding of the current rule versions at every path (doc_id) whose text has it, scanned now or before."""
    return at_paths(*scan(docs, ledger, rules), rules)


def at_paths(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's findings of the given rules at the paths of ``versions``."""
    current = F.concat_ws("@", "rule_id", F.col("rule_version").cast("string")).isin([r.key for r in rules])
    return versions.join(ledger.findings.filter(current), "blob_id").select("doc_id", F.lower(F.hex("blob_id")).alias("blob_id"), "rule_id", "rule_version", "match_no", "secret_sha256", "secret_chars")


def remove(docs: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents without any finding, one row of each doc_id."""
    return with_ids(docs, findings(docs, ledger, rules).select("doc_id").distinct(), keep=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents with one ledger in the shared folder: the first knows the tokens' rules only, and the second
    scans for the pairs which that left, those of the rules that came later."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}"
    scan(docs, None, EARLIER)[1].save(path)
    return findings(docs, Ledger.load(spark, path))


def _one(r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""SELECT doc_id, sha256(text) AS blob_id, '{r.name}' AS rule_id, {r.version} AS rule_version, i AS match_no, sha256(m[i]) AS secret_sha256, length(m[i]) AS secret_chars
FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(text, '{pattern}', 1) AS m FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), unnest(range(1, len(m) + 1)) AS u(i)"""


ORACLE = "\nUNION ALL\n".join(_one(r) for r in RULES)
