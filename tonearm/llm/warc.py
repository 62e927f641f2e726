"""WARC archives and their capture index, built by an external merge.

1. Pages become WARC 1.0 records (text writer; the record end is the line
   separator), whole-file gzip, in the folder named by ``spark.checkpoint.dir``.
   Of the rows with equal payloads those with the smallest page id are
   responses, the others revisits that refer to it.
2. Tasks read archives back and write *runs*: index entries sorted by URL key
   and time.  A run holds at most ``run_rows`` entries.
3. Splitters taken from every run cut the key space into ranges.  Each run is
   cut into chunks that lie in one range each.
4. A task gets the chunks of its ranges ordered by their first key and merges
   the runs with a loser tree.  A run's chunks do not overlap, so memory holds
   about one open chunk per run.  Ranges are in key order: (range, place) is the
   global order.  The key ends with the page id, so one URL may span ranges.

Null html is an empty payload; a null url leaves out the target and has the
empty URL key; null ids come last and are read back as null; repeated rows give
a record each.  Empty tables give an empty index.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tonearm.llm.common import table
from tonearm.session import checkpoint_dir, materialize

RECORDS_PER_ARCHIVE = 2000
RUN_ROWS = 65_536
CHUNK_ROWS = 512
#: One splitter candidate for so many entries of a run.
HEAD_EVERY = 64
END = "\r\n\r\n"
#: Pages have no capture time: without a time column it is this second plus the page id.
FIRST_SECOND = 1_704_067_200
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LAST = (1 << 63) - 1


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest: each five hex digits give four characters."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(group, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1))
                      for group in groups for i in range(4)))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            time_col: str | None = None, least_bytes: int = 0) -> DataFrame:
    """One WARC record (without its end mark) per row, in column ``record``."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        (F.unix_timestamp(F.col(time_col)) if time_col else F.lit(FIRST_SECOND) + F.coalesce(F.col(id_col), F.lit(0)) % 315_360_000).alias("second"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html")), "payload_bytes": F.octet_length("html").cast("long"),
                             "rank": F.coalesce("page_id", F.lit(LAST))})
    firsts = rows.groupBy(F.col("digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).agg(F.min("rank").alias("first"))
    rows = rows.join(firsts, (rows["digest"] == firsts["__digest"]) & (rows["payload_bytes"] == firsts["__bytes"]))
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("rank") > F.col("first"))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = F.when(revisit, F.lit(http)).otherwise(F.concat(F.lit(http), F.col("html")))
    when = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.col("second")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Date: "), when,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("url")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"),
                                 F.lit(">\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"))
    return rows.select(F.concat(fields, block).alias("record"))


def write_archives(pages: DataFrame, folder: str | None = None, records_per_archive: int = RECORDS_PER_ARCHIVE, **columns) -> str:
    """Write the records as gzip WARC files; returns their folder."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    (records(pages, **columns).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_archive).text(folder))
    return folder


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query; scheme, port, user, leading ``www.`` and fragment dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail.lower()}"


def parse_archive(data: bytes):
    """Entries (key, time, page id, offset, length, payload bytes, digest, type, refers to) of an unpacked archive."""
    at = 0
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(b": ", 1) for line in data[at:body - 4].split(b"\r\n")[1:])
        length = int(fields[b"Content-Length"])
        digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
        kind = fields[b"WARC-Type"].decode()
        if kind == "response":
            payload = data[data.index(b"\r\n\r\n", body) + 4:body + length]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"payload of the record at {at} does not have its digest {digest}")
            size, refers = len(payload), None
        else:
            size, refers = int(fields[b"X-Payload-Length"]), _page(fields[b"WARC-Refers-To"])
        end = body + length + len(END)
        url = fields.get(b"WARC-Target-URI")
        yield (url_key(url.decode("utf-8", "replace") if url is not None else None), fields[b"WARC-Date"].decode(),
               _page(fields[b"WARC-Record-ID"]), at, end - at, size, digest, kind, refers)
        at = end


def _page(urn: bytes) -> int | None:
    value = urn.removeprefix(b"<urn:page:").removesuffix(b">")
    return None if value == b"null" else int(value)


ENTRY = ("urlkey string, captured string, rank long, page_id long, archive string, offset long, length long, payload_bytes long, "
         "payload_digest string, record_type string, refers_to long")
ENTRY_TYPES = [(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in ENTRY.split(", "))]
KEY = 3  # the first columns of an entry are its sort key


def sorted_runs(spark, folder: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """Index entries of all archives in ``folder`` as sorted runs (columns ``run``, ``place``)."""
    schema = pa.schema([*ENTRY_TYPES, ("run", pa.string()), ("place", pa.int64())])

    def emit(entries, name):
        entries.sort(key=lambda e: e[:KEY])
        columns = [*zip(*entries), [name] * len(entries), range(len(entries))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        entries, name = [], None
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = name or path.rsplit("/", 1)[-1]
                archive = path.rsplit("/", 1)[-1]
                for key, when, page, offset, length, size, digest, kind, refers in parse_archive(zlib.decompress(content.as_py(), 47)):
                    entries.append((key, when, LAST if page is None else page, page, archive, offset, length, size, digest, kind, refers))
                    if len(entries) >= run_rows:
                        yield emit(entries, f"{name}-{offset}-{archive}")
                        entries = []
        if entries:
            yield emit(entries, f"{name}-end")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInArrow(run, f"{ENTRY}, run string, place long")


def splitters(runs: DataFrame, ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` keys that cut the entries into ranges of about equal size."""
    heads = runs.filter(F.col("place") % HEAD_EVERY == 0).select("urlkey", "captured", "rank")
    firsts = (heads.repartitionByRange(ranges, "urlkey", "captured", "rank").groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min(F.struct("urlkey", "captured", "rank")).alias("k")))
    return sorted(tuple(row["k"]) for row in firsts.collect())[1:]


class LoserTree:
    """The smallest head of k sources; inner nodes keep the losers, so a step replays one path.  None: used up."""

    def __init__(self, heads: list):
        self.heads, k = heads, len(heads)
        won = [0] * k + list(range(k))
        self.lost = [0] * k
        for node in range(k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.lost[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = won[1] if k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def replace(self, head) -> None:
        """The winner's source moves on to ``head``."""
        at = self.winner
        self.heads[at] = head
        node = (at + len(self.heads)) // 2
        while node:
            if self._beats(self.lost[node], at):
                self.lost[node], at = at, self.lost[node]
            node //= 2
        self.winner = at


def merge_chunks(chunks):
    """Entries in order, from (run, sorted entries) chunks that come ordered by their first key."""
    chunks = iter(chunks)
    ahead = next(chunks, None)
    slots, queues, tree = {}, [], None
    while True:
        head = tree.heads[tree.winner] if tree else None
        opened = False
        while ahead is not None and (head is None or ahead[1][0][:KEY] <= head[:KEY]):
            name, entries = ahead
            slot = slots.setdefault(name, len(queues))
            if slot == len(queues):
                queues.append([])
            rest = queues[slot]
            rest[:0] = reversed(entries)  # the next entry is the last; a later chunk of a run goes below
            opened, ahead = True, next(chunks, None)
            if head is None:
                head = entries[0]
        if opened:
            tree = LoserTree([q[-1] if q else None for q in queues])
            continue
        if head is None:
            return
        yield head
        queue = queues[tree.winner]
        queue.pop()
        tree.replace(queue[-1] if queue else None)
        if not queue and ahead is not None and len(queues) > 64 and sum(map(bool, queues)) * 2 < len(queues):
            live = [(n, queues[s]) for n, s in slots.items() if queues[s]]  # forget used-up runs
            slots, queues = {n: i for i, (n, _) in enumerate(live)}, [q for _, q in live]
            tree = LoserTree([q[-1] for q in queues]) if queues else None


def merged_index(spark, folder: str, run_rows: int = RUN_ROWS, chunk_rows: int = CHUNK_ROWS, ranges: int | None = None) -> DataFrame:
    """All entries in the order of (``range``, ``place``): by URL key, time and page id."""
    runs = materialize(sorted_runs(spark, folder, run_rows))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(runs, ranges)
    entry = pa.struct(ENTRY_TYPES)
    chunk_schema = pa.schema([("range", pa.int64()), ("urlkey", pa.string()), ("captured", pa.string()), ("rank", pa.int64()),
                              ("run", pa.string()), ("entries", pa.list_(entry))])

    def chunks(batches):
        def out(kept):
            keys = [e[0] for e in kept]
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.int64()), *(pa.array([k[1][i] for k in keys], t) for i, (_, t) in enumerate(ENTRY_TYPES[:KEY])),
                pa.array([e[1] for e in kept], pa.string()),
                pa.array([[dict(zip((n for n, _ in ENTRY_TYPES), row)) for row in e[2]] for e in kept], pa.list_(entry))], schema=chunk_schema)

        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(len(ENTRY_TYPES)))))
            names = batch.column(len(ENTRY_TYPES)).to_pylist()
            kept = []
            for name, row in zip(names, rows):
                key = row[:KEY]
                place = bisect_right(cuts, key)
                if kept and kept[-1][1] == name and kept[-1][0][0] == place and len(kept[-1][2]) < chunk_rows:
                    kept[-1][2].append(row)
                else:
                    kept.append(((place, key), name, [row]))
            if kept:
                yield out(kept)

    cut = runs.drop("place").mapInArrow(chunks, f"range long, urlkey string, captured string, rank long, run string, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    dealt = cut.repartition(ranges, "range").sortWithinPartitions("range", "urlkey", "captured", "rank")
    merged_schema = pa.schema([*ENTRY_TYPES, ("range", pa.int64()), ("place", pa.int64())])
    names = [n for n, _ in ENTRY_TYPES]

    def merge(batches):
        def stream():
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = batch.column(5)[i].as_py()
                    yield batch.column(0)[i].as_py(), batch.column(4)[i].as_py(), [tuple(r[n] for n in names) for r in rows]

        from itertools import groupby
        for place, group in groupby(stream(), key=lambda c: c[0]):
            rows, start = [], 0
            for row in merge_chunks((name, entries) for _, name, entries in group):
                rows.append(row)
                if len(rows) >= 8192:
                    yield _batch(rows, place, start, merged_schema)
                    start, rows = start + len(rows), []
            if rows:
                yield _batch(rows, place, start, merged_schema)

    return dealt.mapInArrow(merge, f"{ENTRY}, range long, place long").drop("rank")


def _batch(rows, place, start, schema):
    columns = [*zip(*rows), [place] * len(rows), range(start, start + len(rows))]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def op1_capture_index(spark, folder):
    archives = write_archives(table(spark, folder, "pages").select("page_id", "url", "html"))
    return merged_index(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_capture_index": op1_capture_index}
ORACLE = {"op1_capture_index": f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
    f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{BASE32}',
        CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM d JOIN f USING (html)"""}
