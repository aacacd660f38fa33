"""WARC records of pages, and a Merkle audit of their replicas.

Records are put in order of page id (nulls last), url and digest and laid out in shards of RECORDS consecutive ones, each
with its offset and length in bytes. A leaf hashes a record together with its range; a node hashes its FAN children in
order with the range they span; a shard has one root. A shard's tree is one row, with an array for each level. The audit
compares the roots of two replicas, which is all that is read of shards that agree; of the others it reads the levels, and
goes down through differing nodes only to the records that differ, are missing or are added. Nothing is collected but the
names of the directories, PARTS of them at most, in which a root differs.

Defined cases: a null url or html is an empty one; repeated rows are separate records; empty archives agree; a replica that
lacks records in the middle of a shard is compared place by place. A record that is cut short, or whose Content-Length is no
number or too large or too small, is read as damaged, with the body that is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from ..storage import scratch
from ._shared import stored

RECORDS, FAN = 1024, 16
#: Directories over which a table of trees is spread.
PARTS = 256
#: The date of records whose page has none.
DATE = "1970-01-01T00:00:00Z"


def _head(url: Column, html: Column, date: Column) -> Column:
    """Mandatory fields: the record's id is made of what it holds."""
    hexed = F.md5(F.concat(url, F.lit("\n"), html))
    cut = lambda a, n: F.substring(hexed, a, n)
    name = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(">\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(url, r"[\r\n]+", " "),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, held: Callable[[Column], Column] = lambda record: record, whole: bool = True, date: str = DATE) -> DataFrame:
    """page_id, shard, seq, offset, length, digest and, if `whole`, record (binary). Order and ranges are those of the records
    as made; record and digest are of what `held` leaves of them (a replica's bytes). The digest is taken before the records
    are put in order, so that who doesn't ask for the records themselves moves none of them."""
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    made = pages.select("page_id", url.alias("_u"), F.encode(F.concat(_head(url, html, F.lit(date)), html, F.lit("\r\n\r\n")), "UTF-8").alias("_made"))
    rows = made.select("page_id", "_u", F.length("_made").cast("long").alias("length"), F.sha2("_made", 256).alias("_d"), held(F.col("_made")).alias("record"))
    rows = rows.withColumn("digest", F.sha2("record", 256))
    placed = numbered(rows if whole else rows.drop("record"), "_rank", F.asc_nulls_last("page_id"), F.asc("_u"), F.asc("_d"))
    at = F.col("_rank") - 1
    placed = placed.withColumns({"shard": F.floor(at / RECORDS).cast("long"), "seq": at % RECORDS})
    order = Window.partitionBy("shard").orderBy("seq")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("page_id", "shard", "seq", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "length", "digest", *["record"] * whole)


def _levels() -> int:
    depth, n = 1, RECORDS
    while n > 1:
        depth, n = depth + 1, -(-n // FAN)
    return depth


def _parents(kids: Column) -> Column:
    def node(i: Column) -> Column:
        own = F.filter(F.slice(kids, i * FAN + 1, F.lit(FAN)), lambda k: k.isNotNull())
        offset, end = F.array_min(F.transform(own, lambda k: k["offset"])), F.array_max(F.transform(own, lambda k: k["offset"] + k["length"]))
        span = F.concat_ws(":", F.array_join(F.transform(F.slice(kids, i * FAN + 1, F.lit(FAN)), lambda k: F.coalesce(k["hash"], F.lit("-"))), ","), offset.cast("string"), (end - offset).cast("string"))
        return F.struct(F.sha2(span, 256).alias("hash"), offset.alias("offset"), (end - offset).alias("length"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(kids) / FAN).cast("int") - 1), node)


def tree(archive: DataFrame) -> DataFrame:
    """A row for each shard, written to the shared folder: part, shard, root, and l0 (leaves), l1, ... up to the root's level.
    Of an archive without records, the digests are taken as they are."""
    digest = F.sha2(F.col("record"), 256) if "record" in archive.columns else F.col("digest")
    span = F.concat_ws(":", digest, F.col("offset").cast("string"), F.col("length").cast("string"))
    leaf = F.struct(F.col("seq").cast("int").alias("at"), F.sha2(span, 256).alias("hash"), F.col("offset"), F.col("length"))
    rows = archive.groupBy("shard").agg(F.array_sort(F.collect_list(leaf)).alias("kids"))
    # a leaf stands at its own place, also if others before it are gone
    top = F.element_at("kids", -1)["at"]
    spread = F.transform(F.sequence(F.lit(0), top), lambda i: F.get(F.filter("kids", lambda k: k["at"] == i), F.lit(0)))
    rows = rows.withColumn("l0", F.when(F.size("kids") == top + 1, F.col("kids")).otherwise(spread)).drop("kids")
    last = _levels() - 1
    for k in range(1, last + 1):
        rows = rows.withColumn(f"l{k}", _parents(F.col(f"l{k - 1}")))
    rows = rows.withColumns({"root": F.col(f"l{last}")[0]["hash"], "part": F.pmod(F.floor(F.col("shard") / 64), F.lit(PARTS)).cast("int")})
    path = scratch(archive.sparkSession, "merkle")
    names = ["shard", "root", *(f"l{k}" for k in range(last + 1)), "part"]
    rows = rows.select(*names)
    rows.write.partitionBy("part").parquet(path)
    return archive.sparkSession.read.schema(rows.schema).parquet(path)


def _differs(a: Column, b: Column) -> Callable[[Column], Column]:
    return lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves that differ of two trees: shard, at, left_hash, right_hash (null where a replica lacks the record)."""
    root = lambda x, name: x.select("part", "shard", F.col("root").alias(name))
    differ = root(left, "l").join(root(right, "r"), ["part", "shard"], "full_outer").filter(~F.col("l").eqNullSafe(F.col("r"))).select("part", "shard")
    differ = stored(differ, "differ")
    parts = [r.part for r in differ.select("part").distinct().collect()]
    last = _levels() - 1
    side = lambda x, name: x.filter(F.col("part").isin(*parts) if parts else F.lit(False)).join(differ, ["part", "shard"], "left_semi").select(
        "shard", *(F.transform(f"l{k}", lambda n: n["hash"]).alias(f"{name}{k}") for k in range(last + 1))
    )
    pair = side(left, "a").join(side(right, "b"), "shard", "full_outer")
    found = F.array(F.lit(0))
    for k in range(last, -1, -1):
        if k < last:
            found = F.flatten(F.transform(found, lambda i: F.sequence(i * FAN, i * FAN + FAN - 1)))
        # where a replica has no such shard, all of the other's nodes differ from null
        pair = pair.withColumn("_at", F.filter(found, _differs(F.col(f"a{k}"), F.col(f"b{k}"))))
        found = F.col("_at")
    rows = pair.select("shard", "a0", "b0", F.explode("_at").alias("at"))
    return rows.select("shard", F.col("at").cast("long").alias("at"), F.get("a0", F.col("at")).alias("left_hash"), F.get("b0", F.col("at")).alias("right_hash"))


_END = b"\r\n\r\n"
_SEPARATOR = _END + b"WARC/1."


def write_warc(archive: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of whole shards, record after record in their order. archive: with record."""
    rows = archive.repartition("shard").sortWithinPartitions("shard", "seq").withColumn("record", F.decode("record", "UTF-8"))
    rows.select(F.substring("record", F.lit(1), F.length("record") - 4).alias("value")).write.option("lineSep", _END.decode()).option("compression", compression).text(path)


def _parsed(raw: bytes) -> tuple[list[tuple[str, str]], int | None, bytes]:
    """Headers, the length that they name (None if none can be read) and what comes after them."""
    head, _, body = raw.partition(_END)
    fields = [(k.strip().lower(), v.strip()) for k, colon, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if colon]
    size = dict(fields).get("content-length", "")
    return fields, int(size) if size.isascii() and size.isdigit() else None, body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc and .warc.gz files: path, headers map, body, damaged. Files are read as a stream cut where a record can
    begin, large plain ones by several tasks; a body that holds such a place itself is put together again by its length."""
    kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        name, raw = None, b""

        def close() -> None:
            if raw.strip(b"\r\n"):
                fields, size, body = _parsed(raw)
                good = size is not None and len(body) >= size and body[size:].strip(b"\r\n") == b""
                out.append((name, list(dict(fields).items()), body[:size] if good else body.removesuffix(_END), not good))

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["path", "headers", "body", "damaged"])

        for batch in batches:
            for file, chunk in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if raw and file == name:
                    _, size, body = _parsed(raw)
                    if size is not None and len(body) < size:
                        raw += _SEPARATOR + chunk
                        continue
                close()
                name, raw = file, chunk if chunk.startswith(b"WARC/1.") else b"WARC/1." + chunk
                if len(out) >= 500 or sum(len(r[2]) for r in out[-8:]) > 8 << 20:
                    yield table()
                    out.clear()
        close()
        yield table()

    rows = spark.read.option("lineSep", _SEPARATOR.decode()).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(run, "path string, headers map<string,string>, body binary, damaged boolean")


def op9_warc_audit(spark, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which the records of ids divisible by 97 have lost a byte's case:
    page_id, shard, offset, length, digest, damaged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")

    def hurt(record: Column) -> Column:
        return F.when(F.col("page_id") % 97 == 0, F.encode(F.concat(F.lit("warc"), F.substring(F.decode(record, "UTF-8"), 5, 1 << 30)), "UTF-8")).otherwise(record)

    archive = stored(records(pages, whole=False), "archive")
    found = audit(tree(archive), tree(records(pages, hurt, whole=False))).select("shard", F.col("at").alias("seq"), F.lit(True).alias("damaged"))
    rows = archive.join(found, ["shard", "seq"], "left")
    return rows.select("page_id", "shard", "offset", "length", "digest", F.coalesce("damaged", F.lit(False)).alias("damaged"))


_EOL = "chr(13) || chr(10)"
_ID = "md5(coalesce(url, '') || chr(10) || coalesce(html, ''))"
OP9_SQL = rf"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, 'WARC/1.0' || {_EOL} || 'WARC-Type: resource' || {_EOL} || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr({_ID}, 1, 8), substr({_ID}, 9, 4), substr({_ID}, 13, 4), substr({_ID}, 17, 4), substr({_ID}, 21, 12)) || '>'
    || {_EOL} || 'WARC-Date: {DATE}' || {_EOL} || 'WARC-Target-URI: ' || coalesce(url, '') || {_EOL} || 'Content-Type: text/html' || {_EOL} || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || {_EOL} || {_EOL}
    || coalesce(html, '') || {_EOL} || {_EOL} AS rec FROM pages
), k AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS LAST, url, sha256(rec)) - 1 AS k FROM r)
SELECT page_id, (k // {RECORDS})::BIGINT AS shard, coalesce(sum(strlen(rec)) OVER (PARTITION BY k // {RECORDS} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  strlen(rec)::BIGINT AS length, sha256(rec) AS digest, page_id % 97 = 0 AS damaged FROM k
"""
