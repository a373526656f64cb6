"""WARC: pages written as archives and read back by boundary-chain verification.

Archives are plain text files of the Spark writer in the shared folder, so any
file system that Spark reaches will do, and large files are read in splits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_dir, stage, unstage

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1_000
#: Records in one archive; which bounds an archive's size in records.
RECORDS_PER_FILE = 50_000
#: The tables have no time of capture; all records bear this one.
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile of revisits whose payload is that of the record they refer to.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def _harmless(url: str):
    """url in one line, with the dot of a magic at its end, where the line's end would
    complete it, percent-encoded."""
    return F.regexp_replace(F.regexp_replace(url, r"[\r\n]", ""), r"WARC/1\.0\z", "WARC/1%2E0")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """record: the text of one WARC record per row of pages, without its end mark.

    Of rows with equal payloads of at least revisit_bytes the one of the largest
    page_id is the response and the others revisit it (rows that repeat its id are
    responses too; a null id is never the largest). Null html is an empty payload;
    a null url leaves its field out."""
    rows = pages.select(F.col(page_id).alias("page_id"), _harmless(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    keep = (rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest")
            .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null"))
    keep = broadcast_if_small(stage(keep.select("digest", "kept")))
    rows = rows.join(keep, "digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    block = F.concat(F.lit(_HTTP), F.when(again, F.lit("")).otherwise(F.col("payload")))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return rows.select(F.concat(
        F.lit(MAGIC), field("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", urn(F.col("page_id"))), field("WARC-Date", F.lit(DATE)), field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Payload-Length", F.col("bytes").cast("string")),
        field("WARC-Refers-To", F.when(again, urn(F.col("kept")))), field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block).alias("record"))


def write(pages: DataFrame, path: str, **names) -> None:
    """pages as archives below path; one record per row, in the order of the tasks."""
    records(pages, **names).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def header(chunk: bytes) -> dict | None:
    """What a candidate's text after the magic says, or None if it is no record."""
    at = chunk.find(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in _FIELD.findall(chunk[:at])} if at >= 0 else {}
    length = fields.get(b"content-length", b"")
    if b"warc-type" not in fields or b"warc-record-id" not in fields or not length.isdigit():
        return None
    return fields | {"block": at + 4, "end": at + 4 + int(length)}


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<urn:page:(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _payload(block: bytes) -> bytes:
    return block[block.find(b"\r\n\r\n") + 4 :]


_CANDIDATE = ("file string, split long, seq long, start long, bytes long, successor long, whole boolean, type string, "
              "page_id long, refers_to long, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' texts between magics, in the order of the file within a split."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                        F.col("value").cast("binary").alias("chunk"))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text between magics: where it starts in its split, and, if it
    reads as a record, where that record would end."""
    at: dict[tuple, tuple[int, int]] = {}
    for batch in batches:
        rows = []
        for file, split, chunk in zip(batch["file"], batch["split"], batch["chunk"], strict=True):
            seq, start = at.get((file, split), (0, 0))
            h = header(chunk)
            row = [file, split, seq, start, len(chunk) + len(MAGIC)]
            if h:
                whole = len(chunk) == h["end"] + len(END) and chunk.endswith(END.encode())
                payload = _payload(chunk[h["block"] : h["end"]]) if whole else None
                row += [start + h["end"] + len(END), whole, h[b"warc-type"].decode("ascii", "replace"), _page(h[b"warc-record-id"]),
                        _page(h.get(b"warc-refers-to")), int(h.get(b"warc-payload-length") or -1),
                        h.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:"),
                        len(payload) if whole else None, hashlib.sha1(payload).hexdigest() if whole else None]
            else:
                row += [None, False] + [None] * 7
            rows.append(row)
            at[file, split] = seq + 1, start + row[4]
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CANDIDATE.split(", ")]).astype(
            {c: "Int64" for c in ("successor", "page_id", "refers_to", "stated_bytes", "payload_bytes")})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at: dict[tuple, int] = {}
    for batch in batches:
        seqs = []
        for key in zip(batch["file"], batch["split"], strict=True):
            seqs.append(at.get(key, 0))
            at[key] = seqs[-1] + 1
        yield batch.assign(seq=seqs)


def reachable(nodes: DataFrame) -> DataFrame:
    """file, pos of the candidates that the chain of successors from pos 0 meets.

    nodes: file, pos, successor. By pointer jumping: each round marks what the
    marked candidates point to and doubles all pointers, so a chain of n records
    takes about log2(n) rounds of equi-joins, whichever tasks its records are in."""
    cur = stage(nodes.select("file", "pos", F.col("successor").alias("jump"), (F.col("pos") == 0).alias("met")))
    while True:
        ahead = cur.select("file", F.col("pos").alias("jump"), F.col("jump").alias("next"))
        marks = cur.where("met and jump is not null").select("file", F.col("jump").alias("pos"), F.lit(True).alias("mark")).distinct()
        now = (cur.join(marks, ["file", "pos"], "left").join(ahead, ["file", "jump"], "left")
               .select("file", "pos", F.col("next").alias("jump"), (F.col("met") | F.coalesce("mark", F.lit(False))).alias("met")))
        before, cur = cur, stage(now)
        unstage(before)
        if not cur.where("met and jump is not null").limit(1).count():
            return cur.where("met").select("file", "pos")


def read(spark: SparkSession, path: str) -> DataFrame:
    """type, page_id, refers_to, payload_bytes and payload_digest of every record.

    Each magic in the files makes a candidate with the offset at which its record
    would end. Only those on the chain from the file's start are records; a magic
    or a whole record inside a payload is passed over. A record whose payload holds
    a magic is put together from its parts in a second pass over the files, which
    is left out if there is none. A revisit's size and digest are those it states
    of the payload that it revisits; if no response of that page has a payload of this size
    and digest, the archives are refused. An empty folder of archives gives no rows. An
    archive whose chain doesn't end with its last byte is refused."""
    found = stage(_chunks(spark, path).mapInPandas(_candidates, _CANDIDATE))
    sums = found.groupBy("file", "split").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    placed = (found.join(broadcast_if_small(stage(base)), ["file", "split"])
              .withColumn("pos", F.col("base") + F.col("start") - len(MAGIC)).withColumn("successor", F.col("base") + F.col("successor"))
              .drop("base", "start", "bytes"))
    placed = stage(placed.where("pos >= 0"))
    good = placed.where("successor is not null")
    kept = stage(good.join(reachable(good), ["file", "pos"]))
    # text is counted with a magic at its end, which the last one of a file hasn't
    ends = kept.groupBy("file").agg(F.max("successor").alias("end"))
    sizes = sums.groupBy("file").agg((F.sum("bytes") - len(MAGIC)).alias("size"))
    broken = sizes.join(ends, "file", "left").where(~F.col("end").eqNullSafe(F.col("size"))).first()
    if broken:
        raise ValueError(f"{broken.file}: its records end at byte {broken.end} of {broken.size}")
    done = kept.where("whole")
    out = ["type", "page_id", "refers_to", "stated_bytes", "stated_digest", "payload_bytes", "payload_digest"]
    if kept.where("not whole").limit(1).count():
        torn = kept.where("not whole").select("file", "pos", "successor")
        # the last record to start at or before a candidate owns its text
        upto = Window.partitionBy("file").orderBy("pos")
        owner = placed.join(kept.select("file", "pos", F.col("pos").alias("own")), ["file", "pos"], "left").select(
            "file", "split", "seq", "pos", F.last("own", ignorenulls=True).over(upto).alias("owner"))
        parts = stage(owner.join(torn.select("file", F.col("pos").alias("owner")), ["file", "owner"]))
        texts = _chunks(spark, path).mapInPandas(_texts, "file string, split long, chunk binary, seq long")
        texts = texts.join(broadcast_if_small(parts.select("file", "split", "seq", "pos", "owner")), ["file", "split", "seq"])
        whole = texts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk"))).alias("parts"))
        joined = whole.select("file", F.col("owner").alias("pos"), F.expr(
            f"aggregate(parts, cast('' as binary), (a, p) -> if(length(a) = 0, p.chunk, concat(a, encode('{MAGIC[:8]}\\r\\n', 'utf-8'), p.chunk)))").alias("chunk"))

        @F.pandas_udf("payload_bytes long, payload_digest string")
        def digest(s: pd.Series) -> pd.DataFrame:
            rows = []
            for chunk in s:
                h = header(chunk)
                payload = _payload(chunk[h["block"] : h["end"]])
                rows.append((len(payload), hashlib.sha1(payload).hexdigest()))
            return pd.DataFrame(rows, columns=["payload_bytes", "payload_digest"])

        mended = (kept.where("not whole").drop("payload_bytes", "payload_digest")
                  .join(joined.withColumn("d", digest("chunk")).select("file", "pos", "d.*"), ["file", "pos"]))
        done = done.select(out).unionByName(stage(mended.select(out)))
    # what revisits state, once for all revisits of a payload
    stated = stage(done.where("type = 'revisit'").select(F.col("refers_to").alias("page_id"), "stated_bytes", "stated_digest").distinct())
    is_so = [F.col("page_id") == F.col("id"), F.col("stated_bytes") == F.col("payload_bytes"), F.col("stated_digest") == F.col("payload_digest")]
    held = done.where("type = 'response'").select(F.col("page_id").alias("id"), "payload_bytes", "payload_digest")
    true = held.join(broadcast_if_small(stated), is_so).select(stated.columns).distinct()
    wrong = stated.join(true, stated.columns, "left_anti").first()
    if wrong:
        raise ValueError(f"no response of page {wrong.page_id} has the {wrong.stated_bytes} bytes of digest {wrong.stated_digest} that a record revisits")
    same = F.col("type") == "revisit"
    return done.select("type", "page_id", "refers_to",
                       F.when(same, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(same, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"))


def query(spark, sf_dir):
    from .common import table

    path = shared_dir(spark) + "-warc"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= {REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept IS NULL OR kept = page_id THEN NULL ELSE kept END AS refers_to
FROM p LEFT JOIN k USING (d)"""
