"""Secret scans over an incremental blob ledger.

Every version of every file is content-addressed by SHA-256. Only pairs of blob and rule version that the ledger
has not seen are scanned, once each, and findings are joined back to every path that ever held the blob. The ledger is a
Parquet folder, partitioned by rule version, to which each run appends what it has scanned (``scan_with_ledger``). A run reads
its own version's part alone.

Defined cases: null content counts as empty and has no findings; rows that repeat share one blob; an empty table
gives an empty result; columns other than the id and the content are ignored. A null id keeps its row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join

RULE_VERSION = "2026-1"
KINDS = ("assign", "access", "hex", "private_key", "host_token", "jwt")
BASE_KINDS = KINDS[:3]
FINDINGS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
LEDGER = f"blob binary, rule_version string, findings {FINDINGS}"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_MORE = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----")),
    ("host_token", "_", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]|glpat|xox[abprs])_[A-Za-z0-9]{30,}")),
    ("jwt", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as KINDS lists it."""
    found = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    for kind, hint, pattern in _MORE:
        if hint in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if len(found) > 1 else found


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            rows.append([{"kind": k, "start": s, "end": e, "base": k in BASE_KINDS} for k, s, e in find_secrets(text)] if text else [])
        yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(rows, kind)], ["blob", "findings"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``; None where nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings per version, what is new for the ledger). Columns: id, blob, findings; and LEDGER's, a row a new blob."""
    spark = versions.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    seen = ledger.filter(F.col("rule_version") == rule_version).select("blob", "findings")
    rows = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # One row carries each unseen blob's text; ids spread evenly where blobs may not.
    blobs = cut(rows.groupBy("blob").agg(F.min("id").alias("carrier"), F.count("*").alias("n")), "blobs")
    c = blobs.join(seen.select("blob"), "blob", "left_anti").select(F.col("blob").alias("c_blob"), "carrier")
    unseen = rows.join(c, F.col("id").eqNullSafe(F.col("carrier")) & (F.col("blob") == F.col("c_blob"))).select("blob", "text")
    # Scanned once, for the findings and for the ledger.
    new = cut(unseen.mapInArrow(_scan, f"blob binary, findings {FINDINGS}"), "scanned").dropDuplicates(["blob"])
    hits = new.filter(F.size("findings") > 0).unionByName(seen.filter(F.size("findings") > 0)).dropDuplicates(["blob"])
    out = salted_join(rows.select("id", "blob"), hits, ["blob"], hot_keys(blobs, ["blob"]), ["id"], "left")
    out = out.select(F.col("id").alias(id_col), "blob", F.coalesce("findings", F.expr(f"cast(array() as {FINDINGS})")).alias("findings"))
    return out, new.select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def scan_with_ledger(versions: DataFrame, path: str, **options) -> DataFrame:
    """Findings per version; blobs that the ledger at ``path`` holds are not scanned, and those scanned now are added to it."""
    found, new = scan_versions(versions, read_ledger(versions.sparkSession, path), **options)
    new.write.mode("append").partitionBy("rule_version").parquet(path)
    return found


def redact(documents: DataFrame, mark: str = "[secret]", ledger: DataFrame | None = None) -> DataFrame:
    """The documents with every found span replaced by ``mark``; overlapping spans are replaced as one.

    Defined cases: rows may share an id or have none, each is redacted by the findings of its own text; null texts stay null;
    n_chars is set anew where something was replaced; other columns, whatever their names, stay as they are.
    """
    found, _ = scan_versions(documents, ledger)
    names = documents.columns
    # Ids spread evenly where blobs may not. The row itself travels as one column, so that no name can clash.
    hit = found.filter(F.size("findings") > 0).select(F.col("doc_id").alias("hit_id"), F.col("blob").alias("hit_blob"), "findings").dropDuplicates(["hit_id", "hit_blob"])
    own = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    fields = [F.col(f"`{n}`").cast("bigint").alias(n) if n == "n_chars" else F.col(f"`{n}`") for n in names]
    rows = documents.select(F.struct(*fields).alias("row"), F.col("doc_id").alias("own_id"), own.alias("own_blob"))
    joined = rows.join(hit, F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_blob") == F.col("hit_blob")), "left").select("row", "findings")

    def cover(batches):
        for batch in batches:
            cols = dict(zip(names, batch.column("row").flatten(), strict=True))
            texts, spans = cols["text"].to_pylist(), batch.column("findings").to_pylist()
            for k, (text, own) in enumerate(zip(texts, spans, strict=True)):
                if text and own:
                    parts, at = [], 0
                    for s, e in sorted((x["start"], x["end"]) for x in own):
                        if s >= at:
                            parts += [text[at:s], mark]
                        at = max(at, e)
                    texts[k] = "".join([*parts, text[at:]])
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([n if not own or t is None else len(t) for n, t, own in zip(cols["n_chars"].to_pylist(), texts, spans, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    kinds = ", ".join(f"`{n}` {'bigint' if n == 'n_chars' else t}" for n, t in documents.dtypes)
    return joined.mapInArrow(cover, kinds)
