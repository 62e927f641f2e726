"""URL rules from a sorted digest array.

A rule is a host and a path prefix.  It fits its host and all subdomains where
the path starts with its own.  The longest rule that fits wins (of two as long,
the one with the longer host); a rule given as both block and allow blocks.

The index holds the sorted 64-bit xxhash of every rule host and of every rule,
and the full rules.  Tasks memory-map it, look candidates up by vectorised
binary search and compare the stored strings, so a digest collision decides
nothing.  It is written to the shared folder and sent with ``addFile``; rules of
more than ``max_bytes`` are joined instead.

A rule without a host (``/x``) fits nothing.
Null urls and urls without ``://`` have an empty host and path, fit no rule and
get the default verdict.  Repeated rows are judged each; an empty rule table
gives every row the default.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from tonearm.llm.common import table
from tonearm.session import checkpoint_dir

MAX_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


class DigestArray:
    """Sorted keys with the strings they stand for, in one flat byte layout: n, keys, offsets, values, strings."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view(np.int64)[0])
        self.keys = data[8:8 + 8 * n].view(np.uint64)
        self.offsets = data[8 + 8 * n:16 + 16 * n].view(np.int64)
        self.values = data[16 + 16 * n:16 + 24 * n].view(np.int64)
        self.strings = data[16 + 24 * n:]

    @staticmethod
    def pack(values: dict[bytes, int], digest=xxhash.xxh64_intdigest) -> bytes:
        rows = sorted((digest(s), s, v) for s, v in values.items())
        blob = b"".join(r[1] for r in rows)
        offsets = np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64)
        out = b"".join([np.int64(len(rows)).tobytes(), np.array([r[0] for r in rows], np.uint64).tobytes(), offsets.tobytes(),
                        np.array([r[2] for r in rows], np.int64).tobytes(), blob])
        return out + b"\0" * (-len(out) % 8)

    def find(self, wanted: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Value of each string, -1 where it is not held.  Equal keys are tried one after another."""
        keys = np.fromiter(map(digest, wanted), np.uint64, len(wanted))
        out = np.full(len(wanted), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == keys[open_]]
            for i in open_:
                j = at[i]
                if self.strings[self.offsets[j]:self.offsets[j + 1]].tobytes() == wanted[i]:
                    out[i] = self.values[j]
            open_ = open_[out[open_] < 0]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
        return out


def split_rules(rules: DataFrame) -> DataFrame:
    """rule, rule_host, rule_path, blocks from rows (rule, verdict); null rules and those without a host are left out."""
    cut = F.instr("rule", "/")
    return (rules.filter(F.col("rule").isNotNull()).groupBy("rule").agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
            .withColumn("rule_host", F.when(cut > 0, F.substring(F.col("rule"), F.lit(1), cut - 1)).otherwise(F.col("rule")))
            .withColumn("rule_path", F.when(cut > 0, F.substring(F.col("rule"), cut, F.length("rule"))).otherwise(F.lit("")))
            .filter("rule_host <> ''"))


def _write_shared(spark, data: bytes) -> str:
    """Put bytes into the shared folder and have every executor fetch them; returns the file's name."""
    name = f"rules-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``rules`` has ``rule`` and ``verdict`` (block or allow)."""
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    listed = split_rules(rules)
    size = listed.agg(F.sum(F.octet_length("rule") + 32)).first()[0] or 0
    found = _by_array(urls, listed) if size <= max_bytes else _by_join(urls, listed)
    return found.withColumn("verdict", F.when(F.col("blocks") == 1, F.lit("block")).when(F.col("blocks") == 0, F.lit("allow"))
                            .otherwise(F.lit(default))).drop("blocks")


def _by_array(urls: DataFrame, listed: DataFrame) -> DataFrame:
    spark = urls.sparkSession
    lengths: dict[bytes, set] = {}
    exact: dict[bytes, int] = {}
    for row in listed.collect():  # at most ``max_bytes``
        host, path = row["rule_host"].encode(), row["rule_path"].encode()
        exact[host + b"\0" + path] = row["blocks"]
        lengths.setdefault(host, set()).add(len(path))
    shapes = sorted({tuple(sorted(v)) for v in lengths.values()})
    hosts = DigestArray.pack({h: shapes.index(tuple(sorted(v))) for h, v in lengths.items()})
    name = _write_shared(spark, np.int64(len(hosts)).tobytes() + hosts + DigestArray.pack(exact))
    fields = [("rule", pa.string()), ("blocks", pa.int32())]

    def run(batches):
        data = np.memmap(SparkFiles.get(name), np.uint8, "r")
        cut = 8 + int(data[:8].view(np.int64)[0])
        host_index, rule_index = DigestArray(data[8:cut]), DigestArray(data[cut:])
        for batch in batches:
            texts = [h.encode() for h in batch.column(1).to_pylist()]
            paths = [p.encode() for p in batch.column(2).to_pylist()]
            suffixes, owner = [], []
            for i, host in enumerate(texts):
                while host:
                    suffixes.append(host)
                    owner.append(i)
                    dot = host.find(b".")
                    host = host[dot + 1:] if dot >= 0 else b""
            shape = host_index.find(suffixes)
            candidates, of, hosts_of = [], [], []
            for j in np.flatnonzero(shape >= 0):
                for n in shapes[shape[j]]:
                    if n <= len(paths[owner[j]]):
                        candidates.append(suffixes[j] + b"\0" + paths[owner[j]][:n])
                        of.append(owner[j])
                        hosts_of.append(len(suffixes[j]))
            blocks = rule_index.find(candidates)
            best: list = [None] * len(texts)
            for text, i, h, b in zip(candidates, of, hosts_of, blocks):
                if b >= 0 and (best[i] is None or (len(text), h) > best[i][0]):
                    best[i] = ((len(text), h), text.replace(b"\0", b"", 1).decode(), int(b))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b and b[1] for b in best], pa.string()),
                                              pa.array([b and b[2] for b in best], pa.int32())],
                                             schema=pa.schema([*batch.schema, *fields]))

    kind = dict(urls.dtypes)["page_id"]
    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, blocks int")


def _by_join(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The same for rules too large to send: host suffixes are joined with the rules' hosts."""
    keyed = urls.withColumn("key", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = keyed.withColumn("rule_host", F.explode(suffix)).join(listed, "rule_host", "left")
    fits = F.col("path").startswith(F.col("rule_path"))
    size = F.when(fits, F.struct(F.octet_length("rule"), F.octet_length("rule_host"), F.col("rule")))
    best = near.groupBy("page_id", "host", "path", "key").agg(F.max_by(F.struct("rule", "blocks"), size).alias("best"))
    return best.select("page_id", "host", "path", "best.rule", "best.blocks")


#: The rules of the registered query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op6_url_rules(spark, folder):
    rules = spark.createDataFrame(list(RULES), "rule string, verdict string")
    return judge(table(spark, folder, "pages"), rules)


QUERIES = {"op6_url_rules": op6_url_rules}
ORACLE = {"op6_url_rules": """
    WITH r(rule, rule_host, rule_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
    FROM p LEFT JOIN r ON (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path)
    QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC NULLS LAST, length(r.rule_host) DESC) = 1"""}
