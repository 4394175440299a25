"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger has a row for each blob and rule version that
was scanned; a scan looks only at blobs that it lacks for the rule version at hand, each once, however many paths and versions
hold it, and appends what it finds. Findings are then joined back to all paths by content address.

Null texts count as empty blobs. Rows with equal paths each get their row. An empty table gives an empty table and scans nothing.
Further columns of the versions are kept by scan(), but for those named as its own, which give way. Offsets are code points, ends exclusive. A blob that very many paths hold is
moved once for each input partition, and its paths are dealt out by Spark's skew join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RULE_VERSION = "2"
#: The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: Further kinds that this rule version knows, each by its issuer's public prefix.
FURTHER = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}
KINDS = ("assign", "access", "hex", *FURTHER)
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more starts where the run of any length does
_FURTHER = {k: (re.compile(p), re.match(r"[A-Za-z-]+", p)[0]) for k, p in FURTHER.items()}
#: In lower case, one of these is in each text that _ASSIGN finds something in.
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, (pattern, hint) in _FURTHER.items():
        if hint in text:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Ledger:
    """Scanned blobs as a Parquet table at path, with a folder for each rule version; it is created by the first scan.

    Scans at the same time may both append a blob, and a batch may be appended again: known() has each blob once.
    """

    SCHEMA = f"rule_version string, blob binary, findings {FINDINGS}"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def known(self, rule_version: str) -> DataFrame:
        return self.read().filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def address(text: Column) -> Column:
    """A blob's content address."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: Ledger, rule_version: str = RULE_VERSION, text: str = "text") -> DataFrame:
    """versions without its text, with blob and findings; blobs that the ledger lacked are scanned and appended to it."""
    common.small_batches(common.session(versions))
    addressed = versions.drop("blob", "findings").withColumn("blob", address(F.col(text)))
    unseen = addressed.select("blob", F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    unseen = unseen.join(ledger.known(rule_version).select("blob"), "blob", "left_anti")

    def found(texts: list[str]) -> dict:
        return {"findings": [[dict(zip(("kind", "start", "end"), x)) for x in find(t)] for t in texts]}

    schema = f"blob binary, findings {FINDINGS}"
    new = unseen.mapInArrow(common.over_texts(found, ["blob"], schema), schema)
    new.select(F.lit(rule_version).alias("rule_version"), "blob", "findings").write.mode("append").partitionBy("rule_version").parquet(ledger.path)
    return addressed.drop(text).join(ledger.known(rule_version).select("blob", "findings"), "blob", "left")


def joined(findings: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each finding of these kinds, comma-joined."""
    own = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    found = scan(docs, Ledger(spark, common.fresh_path(spark, "secret-ledger")))
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(F.col("findings"), KINDS[:3]).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
