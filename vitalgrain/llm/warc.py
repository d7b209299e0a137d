"""Deterministic sharded WARC writer and reader.

Rows are range-sorted by (page id, payload digest), so shards follow the order of ids and one frequent
id or null ids still spread over shards. The number of shards follows from the bytes of all payloads, and
the keys that part them from rows chosen by a hash: both depend on the rows alone, not on how they lie in
partitions or on a sample that differs from run to run. Payloads cross the network once: which payloads
repeat, and under which largest id, is found from digests alone, and that small table meets the payloads
in the same sort. A shard writes gzip members, one per record, and starts a new file when the compressed
size reaches ``roll_bytes``. Files are written under names of their own attempt; the manifest of the
attempts that succeeded says which are renamed, the rest is deleted. Names, headers, record ids and
digests depend on the rows alone, so a repeated run gives the same files, byte for byte.

Of records with equal payloads of at least ``least_bytes`` bytes, those of the largest page id are
responses and the others revisits that refer to it; smaller payloads are always responses.

Defined results: a null html counts as an empty payload; a null id is smaller than any other and
stays null on reading, as does a null url; a url with characters that a URI can't hold is escaped in the
target header and kept whole beside it; rows that share id and payload stay in one shard and are alike,
so if their id is the largest all of them are responses; an empty table writes no archive and reads
back no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrain.llm.common import materialize, open_fs, remove, small_batches, tidied, work_dir

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
URI = "%:/?#[]@!$&'()*+,;=~"
MANIFEST = "file string, records long, bytes long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("ascii") + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}:{digest}"))


def page_record(page_id: int | None, url: str | None, payload: bytes, leader: int | None, revisit: bool) -> bytes:
    """One response record, or a revisit of the leader's."""
    digest = base32_sha1(payload)
    headers = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if url is not None:
        target = quote(url, safe=URI)
        headers.append(("WARC-Target-URI", target))
        if target != url:
            headers.append(("X-Original-URL", quote(url, safe="")))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if not revisit:
        return _record("response", record_id(page_id, digest), headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_id(leader, digest)}>"), ("X-Refers-To-Page-Id", str(leader))]
    return _record("revisit", record_id(page_id, digest), headers, http)


def shard_bounds(light: DataFrame, shards: int, per_shard: int = 16) -> list[dict]:
    """Up to ``shards`` - 1 keys that part the rows (id, digest, bytes) into ranges of about equal bytes.

    Rows are chosen by a hash of their key, some ``per_shard`` for each shard; equal keys count as one with their bytes.
    """
    if shards < 2:
        return []
    every = max(1, light.count() // (shards * per_shard))
    some = light.where(F.pmod(F.xxhash64("id", "digest"), F.lit(every)) == 0).groupBy("id", "digest").agg(F.sum("bytes").alias("bytes")).collect()
    rows = sorted((r.id is not None, r.id or 0, bytes(r.digest).hex(), r.bytes) for r in some)
    total, upto, out = sum(r[3] for r in rows), 0, []
    for known, page_id, digest, n in rows:
        if upto * shards >= total * (len(out) + 1) and len(out) < shards - 1:
            out.append({"known": known, "id": page_id, "digest": digest})
        upto += n
    return out


def shard_of(bounds: list[dict]):
    """The number of bounds that lie at or before the row's key, by halving steps."""
    if not bounds:
        return F.lit(0)
    # a literal array, folded once
    table = F.from_json(F.lit(json.dumps(bounds)), "array<struct<known:boolean,id:bigint,digest:string>>")
    key = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.lower(F.hex("digest")).alias("digest"))
    steps = F.array(*(F.lit(2**i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def write(
    pages: DataFrame, out: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, roll_bytes: int = 64 << 20, level: int = 5,
    shard_bytes: int = 32 << 20, most_shards: int = 16_384,
) -> DataFrame:
    """Write the archives below ``out``; the committed manifest: file, records, bytes.

    There is a shard for each ``shard_bytes`` of payload, but at most ``most_shards``, which then grow instead.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    small_batches(spark, 500)
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("x")
    ).withColumn("digest", F.unhex(F.sha1(F.col("x").cast("binary"))))
    light = materialize(rows.select("id", "digest", F.octet_length("x").cast("long").alias("bytes")), f"{out}/_light")
    total = light.agg(F.sum("bytes").alias("n")).first().n or 0
    shards = max(1, min(most_shards, -(-total // shard_bytes)))
    shard = shard_of(shard_bounds(light, shards)).alias("shard")
    large = light.where(F.col("bytes") >= least_bytes).select("id", "digest")
    repeated = large.groupBy("digest").agg(F.max("id").alias("leader"), F.count("*").alias("n")).where("n > 1 AND leader IS NOT NULL")
    marks = large.join(repeated.drop("n"), "digest").where("id IS NULL OR id < leader").select(shard, "id", "digest", F.lit(0).alias("kind"), "leader", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("x"))
    bodies = rows.select(shard, "id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("leader"), "url", "x")
    ordered = marks.unionByName(bodies).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "id", "digest", "kind", "url")

    schema = pa.schema([("temp", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def put(batches):
        fs, base = open_fs(out)
        attempt = uuid.uuid4().hex[:8]
        done: list[dict] = []
        stream, at, mark = None, None, (None, None, None)

        def member(data: bytes) -> int:
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            return stream.write(packer.compress(data) + packer.flush())

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shard", "id", "digest", "kind", "leader", "url", "x")]
            for shard, page_id, digest, kind, leader, link, text in zip(*cols, strict=True):
                if not kind:
                    mark = (page_id, digest, leader)
                    continue
                if stream is None or at[0] != shard or done[-1]["bytes"] >= roll_bytes:
                    if stream is not None:
                        stream.close()
                    at = (shard, at[1] + 1 if at and at[0] == shard else 0)
                    name = f"part-{at[0]:06d}-{at[1]:05d}"
                    fs.create_dir(f"{base}/_temporary", recursive=True)
                    done.append({"temp": f"_temporary/{name}.{attempt}", "file": f"{name}.warc.gz", "records": 0, "bytes": 0})
                    stream = fs.open_output_stream(f"{base}/{done[-1]['temp']}", compression=None)
                    info = b"software: vitalgrain\r\nformat: WARC File Format 1.1\r\n"
                    done[-1]["bytes"] += member(_record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_OID, name)), [("WARC-Filename", f"{name}.warc.gz"), ("Content-Type", "application/warc-fields")], info))
                revisit = mark[:2] == (page_id, digest)
                done[-1]["bytes"] += member(page_record(page_id, link, text.encode("utf-8", "surrogatepass"), mark[2], revisit))
                done[-1]["records"] += 1
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_pylist(done, schema)

    attempts = materialize(ordered.mapInArrow(tidied(put), f"temp string, {MANIFEST}"), f"{out}/_attempts")

    def commit(batches):
        fs, base = open_fs(out)
        for batch in batches:
            for temp, name in zip(batch["temp"].to_pylist(), batch["file"].to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{temp}").type.name != "NotFound":  # else an earlier try renamed it
                    fs.move(f"{base}/{temp}", f"{base}/{name}")
            yield batch.select(["file", "records", "bytes"])

    manifest = materialize(attempts.mapInArrow(tidied(commit), MANIFEST), f"{out}/manifest")
    remove(spark, f"{out}/_temporary")
    remove(spark, f"{out}/_attempts")
    remove(spark, f"{out}/_light")
    return manifest


def parse(stream):
    """(headers, block) of each record of an uncompressed stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("ascii").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def read(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """The page records of the committed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]."""
    import pyarrow as pa
    from urllib.parse import unquote

    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def get(batches):
        fs, base = open_fs(out)
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        if "sha1:" + base32_sha1(block) != headers["WARC-Block-Digest"]:
                            raise ValueError(f"damaged record in {name}")
                        payload = block.partition(b"\r\n\r\n")[2]
                        response = headers["WARC-Type"] == "response"
                        digest = base32_sha1(payload) if response else headers["WARC-Payload-Digest"][5:]
                        if "sha1:" + digest != headers["WARC-Payload-Digest"]:
                            raise ValueError(f"damaged payload in {name}")
                        number = lambda k: int(headers[k]) if k in headers else None
                        row = {
                            "page_id": number("X-Page-Id"), "url": unquote(headers["X-Original-URL"]) if "X-Original-URL" in headers else headers.get("WARC-Target-URI"),
                            "payload_bytes": len(payload) if response else number("X-Payload-Length"), "payload_digest": digest,
                            "record_type": headers["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"),
                        }
                        rows.append(row | ({"payload": payload} if payloads else {}))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "file").mapInArrow(tidied(get), kind)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write to a fresh shared folder and read back."""
    out = work_dir(pages.sparkSession, "warc")
    write(pages, out, **options)
    return read(pages.sparkSession, out)
