"""WARC archives of pages, with a globally ordered capture index merged from sorted runs.

Tasks write archives of gzip members (WARC/1.1) and, for what they wrote, capture runs: index lines
``urlkey timestamp archive offset length`` in byte order, with every ``SPARSE``-th line's place beside them. An
external merge makes one ordered history of all runs: splitters taken from the runs cut the key space into ranges of
about ``RANGE_LINES`` lines; each task merges the parts of at most ``FAN_IN`` runs that lie in one range with a loser
tree, reading them as streams, and passes repeat within a range until one file is left. A url with any number of
captures is cut by timestamp like the rest.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import cut, open_folder, scratch_folder, shuffle_width, write_whole

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64_000_000
RUN_LINES = 200_000
SPARSE = 64
RANGE_LINES = 500_000
FAN_IN = 64
SPLIT_SAMPLES = 100_000
_START = datetime(2024, 1, 1, tzinfo=timezone.utc)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_LATEST = 2**31


def url_key(url: str) -> str:
    """Host labels from the top down, then path and query: the order that keeps a site's captures together."""
    rest = url.partition("://")[2] or url
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:at].lower().removeprefix("www."), rest[at:].partition("#")[0] or "/"
    return urllib.parse.quote(",".join(reversed(host.split("."))) + ")" + tail.lower(), safe="/?&=%,;:@+!*'()~$")


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A gzip member with one record, and its timestamp."""
    when = _START + timedelta(seconds=(page_id or 0) % _LATEST)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=SAFE)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush(), f"{when:%Y%m%d%H%M%S}"


#: Characters that a target URI keeps; all others, line ends above all, are percent-encoded.
SAFE = "/?&=%,;:@+!*'()~$#[]"


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class _Runs:
    """Collects index lines of one task and writes them as sorted runs."""

    def __init__(self, folder: str, piece: int, most: int):
        self.folder, self.piece, self.most, self.lines, self.made = folder, piece, most, [], []

    def add(self, line: bytes) -> None:
        self.lines.append(line)
        if len(self.lines) >= self.most:
            self.close()

    def close(self) -> None:
        if self.lines:
            self.lines.sort()
            name, at, sparse = f"run-{self.piece:06d}-{len(self.made):04d}", 0, []
            for i, line in enumerate(self.lines):
                if i % SPARSE == 0:
                    sparse.append([line.decode(), at])
                at += len(line) + 1
            write_whole(self.folder, f"{name}.idx", json.dumps(sparse).encode())
            write_whole(self.folder, f"{name}.cdx", b"\n".join(self.lines) + b"\n")
            self.made.append((name, len(self.lines)))
            self.lines = []


def _archive_writer(folder: str, run_lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pyspark.TaskContext.get().partitionId()
        runs, members, size, files = _Runs(folder, piece, run_lines), [], 0, 0

        def close() -> None:
            nonlocal members, size, files
            if members:
                write_whole(folder, f"pages-{piece:06d}-{files:04d}.warc.gz", b"".join(members))
                members, size, files = [], 0, files + 1

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    member, stamp = warc_record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"], row["revisit"])
                    if size and size + len(member) > ARCHIVE_BYTES:
                        close()
                    runs.add(f"{url_key(row['url'] or '')} {stamp} pages-{piece:06d}-{files:04d}.warc.gz {size:012d} {len(member)}".encode())
                    members.append(member)
                    size += len(member)
        close()
        runs.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in runs.made], pa.string()), pa.array([n for _, n in runs.made], pa.int64())], names=["run", "lines"])

    return run


def _stream(folder: str, name: str, low: str, high: str | None) -> Iterator[bytes]:
    """Lines of a run from low on up to below high, read from the last sparse place before low."""
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{name}.idx") as src:
        sparse = json.loads(src.read())
    start = sparse[max(0, bisect.bisect_right([s[0] for s in sparse], low) - 1)][1]
    begin, end = low.encode(), high.encode() if high is not None else None
    with store.open_input_file(f"{path}/{name}.cdx") as src:
        src.seek(start)
        rest = b""
        while data := src.read(1 << 18):
            *lines, rest = (rest + data).split(b"\n")
            for line in lines:
                if end is not None and line >= end:
                    return
                if line >= begin:
                    yield line


def loser_tree(streams: list[Iterator[bytes]]) -> Iterator[bytes]:
    """All lines of sorted streams in order. Each inner node keeps the loser of its match, the root the winner."""
    width = len(streams)
    if not width:
        return
    heads = [next(s, None) for s in streams]
    losers = [-1] * width

    def wins(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a], a) < (heads[b], b)

    def play(leaf: int) -> int:
        winner, node = leaf, (leaf + width) // 2
        while node > 0:
            other = losers[node]
            if other < 0:
                losers[node] = winner
                return -1
            if wins(other, winner):
                losers[node], winner = winner, other
            node //= 2
        return winner

    winner = -1
    for leaf in range(width):
        winner = max(winner, play(leaf)) if winner < 0 else winner
    while heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(streams[winner], None)
        winner = play(winner)


def _merger(folder: str, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, sparse, at, n = [], [], 0, 0
                name = f"merged-{turn}-{row['part']:06d}-{row['team']:06d}"
                store, path = open_folder(folder)
                with store.open_output_stream(f"{path}/.{name}.{(tag := uuid.uuid4().hex)}") as sink:
                    for line in loser_tree([_stream(folder, r, row["low"], row["high"]) for r in sorted(row["runs"])]):
                        if n % SPARSE == 0:
                            sparse.append([line.decode(), at])
                        out.append(line)
                        at, n = at + len(line) + 1, n + 1
                        if len(out) == 4096:
                            sink.write(b"\n".join(out) + b"\n")
                            out = []
                    sink.write(b"\n".join(out) + b"\n" if out else b"")
                store.move(f"{path}/.{name}.{tag}", f"{path}/{name}.cdx")
                write_whole(folder, f"{name}.idx", json.dumps(sparse or [["", 0]]).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([n], pa.int64()), pa.array([row["part"]], pa.int32()), pa.array([row["low"]]), pa.array([row["high"]], pa.string())],
                    names=["run", "lines", "part", "low", "high"])

    return run


def _splitters(runs: DataFrame, folder: str, parts: int) -> list[str]:
    """Lines that cut the runs into about equal ranges, from at most SPLIT_SAMPLES sparse lines of at most as many runs."""
    if parts == 1:
        return []
    each = max(1, SPLIT_SAMPLES // max(1, runs.count()))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for name in batch.column("run").to_pylist():
                with store.open_input_file(f"{path}/{name}.idx") as src:
                    lines = [s[0] for s in json.loads(src.read())]
                yield pa.RecordBatch.from_arrays([pa.array(lines[::max(1, len(lines) // each)][:each])], names=["line"])

    lines = sorted(r["line"] for r in runs.limit(SPLIT_SAMPLES).select("run").mapInArrow(sample, "line string").collect())
    return sorted({lines[len(lines) * i // parts] for i in range(1, parts)} - {lines[0]})


def merge_runs(runs: DataFrame, folder: str, range_lines: int = RANGE_LINES, fan_in: int = FAN_IN) -> DataFrame:
    """(part, run, lines): one merged file per range, in order of part."""
    total = runs.agg(F.sum("lines")).first()[0] or 0
    cuts = _splitters(runs, folder, int(total // range_lines) + 1)
    edges = ["", *cuts]
    ranges = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(e).alias("low"), F.lit(h).cast("string").alias("high"))
                       for i, (e, h) in enumerate(zip(edges, [*cuts, None], strict=True))])
    schema = "run string, lines long, part int, low string, high string"
    state = runs.select("run", "lines", F.explode(ranges).alias("x")).select("run", "lines", "x.*")
    turn = 0
    while True:
        turn += 1
        # Teams of at most fan_in runs each: the row number within a range, counted over its runs' names.
        ranked = state.withColumn("team", ((F.row_number().over(pyspark.sql.Window.partitionBy("part").orderBy("run")) - 1) / fan_in).cast("int"))
        teams = ranked.groupBy("part", "team").agg(F.collect_list("run").alias("runs"), F.first("low").alias("low"), F.first("high").alias("high"))
        state = cut(teams.repartition(shuffle_width(runs.sparkSession), "part", "team").mapInArrow(_merger(folder, turn), schema))
        if state.groupBy("part").count().where("count > 1").isEmpty():
            return state.select("part", "run", "lines")


def write_archives(pages: DataFrame, folder: str, run_lines: int = RUN_LINES) -> DataFrame:
    """Write pages (page_id, url, html) and their capture runs; returns the list of runs."""
    pages = pages.select("page_id", "url", "html")
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.withColumn("digest", F.sha1(payload.cast("binary"))).withColumn("long_enough", F.octet_length(payload) >= MIN_REVISIT)
    latest = keyed.where("long_enough").groupBy("digest").agg(F.max("page_id").alias("refers_to")).withColumnRenamed("digest", "of_digest")
    rows = keyed.join(latest, F.col("long_enough") & (F.col("digest") == F.col("of_digest")), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull(), F.lit(False))
    rows = rows.select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))
    return cut(rows.mapInArrow(_archive_writer(folder, run_lines), "run string, lines long"))


def capture_history(merged: DataFrame, folder: str) -> DataFrame:
    """(part, line, archive, offset, length) of the merged index: all captures in order of part and line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines: list[list[bytes]] = []

                def out(row: dict = row) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([
                        pa.array([row["part"]] * len(lines), pa.int32()), pa.array([b" ".join(x[:2]).decode() for x in lines]),
                        pa.array([x[2].decode() for x in lines]), pa.array([int(x[3]) for x in lines]), pa.array([int(x[4]) for x in lines])],
                        names=["part", "line", "archive", "offset", "length"])

                for line in _stream(folder, row["run"], "", None):
                    lines.append(line.split(b" "))
                    if len(lines) == 8192:
                        yield out()
                        lines = []
                if lines:
                    yield out()

    spread = merged.where("lines > 0").repartition(shuffle_width(merged.sparkSession), "part")
    return spread.mapInArrow(read, "part int, line string, archive string, offset long, length long")


def read_archives(history: DataFrame, folder: str) -> DataFrame:
    """(record_id, page_id, record_type, refers_id, payload_bytes, payload_digest) of every capture, read from its archive."""

    def read(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        store, path = open_folder(folder)
        rows = []
        with store.open_input_file(f"{path}/{group.column('archive')[0].as_py()}") as src:
            for at, length in zip(group.column("offset").to_pylist(), group.column("length").to_pylist(), strict=True):
                src.seek(at)
                fields, payload = read_record(src.read(length))
                revisit = fields["WARC-Type"] == "revisit"
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex() if revisit else hashlib.sha1(payload).hexdigest()
                rows.append({
                    "record_id": fields["WARC-Record-ID"], "page_id": int(fields["Page-Id"]) if "Page-Id" in fields else None, "record_type": fields["WARC-Type"],
                    "refers_id": fields.get("WARC-Refers-To"), "payload_bytes": None if revisit else len(payload), "payload_digest": digest})
        kinds = [("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
        return pa.Table.from_pylist(rows, pa.schema(kinds))

    return history.select("archive", "offset", "length").groupBy("archive").applyInArrow(
        read, "record_id string, page_id long, record_type string, refers_id string, payload_bytes long, payload_digest string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of pages, read back from the archives.

    Other columns are not looked at. A null html is an empty payload, a null url an empty target. Of records with
    equal payloads of MIN_REVISIT bytes or more all rows with the largest page_id are responses, so repeated rows with
    that id are not revisits of themselves; a null id is the largest only where no row has one. An empty table writes
    nothing and gives an empty result.
    """
    folder = scratch_folder(pages.sparkSession, "warc")
    runs = write_archives(pages, folder)
    history = capture_history(merge_runs(runs, folder), folder)
    records = cut(read_archives(history, folder))
    firsts = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("of_record")).agg(
        F.min("page_id").alias("of_page"), F.min("payload_bytes").alias("of_bytes"))
    out = records.join(firsts, F.col("refers_id") == F.col("of_record"), "left")
    return out.select(
        "page_id", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("of_page").alias("refers_to"))


def archive_sql() -> str:
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
        SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d LEFT JOIN m ON m.payload_digest = d.payload_digest AND payload_bytes >= {MIN_REVISIT}"""
