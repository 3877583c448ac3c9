"""Secret scans over file histories with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds one row for
each (blob, rule version) that has been scanned, with the spans found. A run scans only the pairs
that the ledger lacks, each distinct blob once, and joins the ledger back to all paths. The version
is a checksum of the rules, so changed rules scan all blobs anew.

Defined results: a null text is the empty text; an empty table gives no rows; rows that repeat keep
one result row each; extra columns are ignored unless they are named as path columns; a very long text
is one scan. A blob that the ledger lacks has null spans, one that it holds twice counts once.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import map_texts

BASE_KINDS = ("assign", "access", "hex")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run is consumed whole by the open-ended patterns, so asking for the least length at once finds the same spans.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
# Three parts between dots, looked for from the second: a run of the class is passed once, however often it holds the first letters.
_WEB_PART = re.compile(r"[A-Za-z0-9_-]+")
_WEB_START, _MIN_WEB_PART = "eyJ", 10
MIN_ASSIGNED = 6
RULE_VERSION = zlib.crc32("\n".join((*(p.pattern for p in (_ASSIGN, _ACCESS, _HEX, _KEY_BLOCK, _WEB_PART)), _WEB_START, str(_MIN_WEB_PART), str(MIN_ASSIGNED))).encode())

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def web_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of ``eyJ`` and 10 or more, a dot, the same again, a dot, and 10 or more of letters, digits, _ and -; leftmost, not overlapping.

    A token starts at the first ``eyJ`` of its first part that leaves enough behind it; each part is looked at a fixed number of times.
    """
    least = len(_WEB_START) + _MIN_WEB_PART
    found, parts = [], []  # the last two runs, if each is followed by a dot and the next
    for m in _WEB_PART.finditer(text):
        if parts and not (m.start() == parts[-1].end() + 1 and text[parts[-1].end()] == "."):
            parts = []
        if len(parts) == 2 and m.end() - m.start() >= _MIN_WEB_PART:
            first, second = parts
            start = text.find(_WEB_START, first.start(), first.end())
            if 0 <= start <= first.end() - least and text.startswith(_WEB_START, second.start()) and second.end() - second.start() >= least:
                found.append((start, m.end()))
                parts = []
                continue
        parts = [*parts[-1:], m]
    return found


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind; offsets in code points, end exclusive."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [(m.start(), 3, m.end()) for m in _KEY_BLOCK.finditer(text)]
    if "eyJ" in text:
        found += [(a, 4, b) for a, b in web_tokens(text)]
    kinds = (*BASE_KINDS, "key_block", "web_token")
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["blob", "spans"])


def with_blob(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``blob``, the lowercase hex SHA-256 of the text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) for the pairs that ``ledger`` lacks.

    Append them to the ledger. Copies of a blob meet in a map-side aggregate, so a blob that holds a
    third of all versions reaches its task as one row from each map task.
    """
    blobs = versions.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is not None:
        # Hashes alone meet the ledger; texts are moved only for what it lacks.
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(blobs.select("blob").distinct().join(seen, "blob", "left_anti"), "blob", "left_semi")
    scanned = map_texts(blobs.dropDuplicates(["blob"]), _scan, f"blob string, spans {SPANS}")
    return scanned.select("blob", F.lit(rule_version).cast("long").alias("rule_version"), "spans")


def join_findings(versions: DataFrame, ledger: DataFrame, path_cols: list[str], text_col: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """``path_cols``, blob and spans of every version: empty for a blob without a finding, null for one never scanned."""
    paths = versions.select(*path_cols, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"))
    found = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])
    return paths.join(found, "blob", "left").select(*path_cols, "blob", "spans")


def span_list(spans) -> F.Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(findings: DataFrame) -> DataFrame:
    """The query's columns: counts of the base kinds, digest of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return findings.select("doc_id", *map(count, BASE_KINDS), F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
