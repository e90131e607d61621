"""Vendor requests as a Spark data source: every attempt of every request is a row, before anything is parsed.

Requests are a table (source, endpoint, symbol, params) that is written in files of bounded size, in the order of endpoint,
the place of the answer where that matters, and symbol; a file is a partition of the read.  So the driver sees file names only, and a lost executor repeats its files'
requests and no others.  In a task each request is retried by itself with the rules of ``landing``: a response worth another
try is followed by a growing pause and the next attempt, anything else ends the request.  What carries a request is a
transport, named by module and class, so HTTP and a folder of landed responses are read by the same code.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronopanel.sources.landing import pause_after, worth_retry
from chronopanel.sources.vault import SECRETS

ATTEMPTS = "source string, endpoint string, symbol string, params string, attempt int, status int, body string, error string, final boolean"
REQUESTS = ["source", "endpoint", "symbol", "params"]
_TYPES = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.bool_()]
_NAMES = [c.split()[0] for c in ATTEMPTS.split(", ")]
#: Vendor endpoints by name, as (base, path with the symbol's place).
ENDPOINTS = {
    "prices": ("https://financialmodelingprep.com", "/stable/historical-price-eod/dividend-adjusted"),
    "income_statement": ("https://financialmodelingprep.com", "/stable/income-statement"),
    "cash_flow_statement": ("https://financialmodelingprep.com", "/stable/cash-flow-statement"),
    "companyfacts": ("https://data.sec.gov", "/api/xbrl/companyfacts/CIK{symbol}.json"),
    "submissions": ("https://data.sec.gov", "/submissions/CIK{symbol}.json"),
    "archive_index": ("https://www.sec.gov", "/Archives/edgar/data/{symbol}/{accession}/index.json"),
    "archive_document": ("https://www.sec.gov", "/Archives/edgar/data/{symbol}/{accession}/{document}"),
}


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


class Http:
    """Requests over HTTP: the endpoint's path with places filled from the parameters, which make the query otherwise.

    Options: ``base`` in place of the endpoint's own, ``agent`` for the User-Agent header, ``key_name`` and ``key`` for a
    secret that goes into the query and never into a row, ``timeout`` seconds, ``gap`` seconds between a task's requests."""

    def __init__(self, options: dict[str, str]):
        self.options, self.last = options, 0.0

    def url(self, endpoint: str, symbol: str, params: dict) -> str:
        base, path = ENDPOINTS.get(endpoint, ("", f"/{endpoint}"))
        fields = {k: str(v) for k, v in {"symbol": symbol, **params}.items() if v is not None}
        placed = {k for k in fields if f"{{{k}}}" in path}
        query = sorted((k, v) for k, v in fields.items() if k not in placed)
        if self.options.get("key"):
            query.append((self.options.get("key_name", "apikey"), self.options["key"]))
        filled = path.format(**{k: urllib.parse.quote(fields[k], safe="") for k in placed})
        return self.options.get("base", base) + filled + (f"?{urllib.parse.urlencode(query)}" if query else "")

    def fetch(self, endpoint: str, symbol: str, params: dict, attempt: int) -> tuple[int, str]:
        time.sleep(max(0.0, self.last + float(self.options.get("gap", 0)) - time.monotonic()))
        self.last = time.monotonic()
        request = urllib.request.Request(self.url(endpoint, symbol, params), headers={"User-Agent": self.options.get("agent", "chronopanel"), "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 30))) as response:
                return response.status, response.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as failed:  # a response too
            return failed.code, failed.read().decode("utf-8", "replace")


class Landed:
    """Requests answered from responses that ``land_attempts`` wrote to ``folder``; one that isn't there is a 404.

    A bucket is held at a time, so requests are best planned by ``place_of`` their buckets: others read one almost each."""

    def __init__(self, options: dict[str, str]):
        self.fs, self.root = open_path(options["folder"])
        with self.fs.open_input_stream(f"{self.root}/_buckets") as f:
            self.buckets = int(f.read())
        self.held: tuple[tuple[str, int] | None, dict] = (None, {})

    def fetch(self, endpoint: str, symbol: str, params: dict, attempt: int) -> tuple[int, str]:
        place = (endpoint, bucket_of(symbol, self.buckets))
        if self.held[0] != place:  # one after another, if planned by place
            found = {}
            folder = f"{self.root}/responses/endpoint={endpoint}/bucket={place[1]}"
            for info in self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if info.path.endswith(".parquet"):
                    for row in pq.read_table(self.fs.open_input_file(info.path), columns=["symbol", "attempt", "status", "body"], partitioning=None).to_pylist():
                        found[row["symbol"], row["attempt"]] = (row["status"], row["body"])
            self.held = (place, found)
        answer = self.held[1].get((symbol, attempt), (404, ""))
        if answer[0] is None:
            raise ConnectionError(answer[1])
        return answer


def bucket_of(symbol: str, buckets: int) -> int:
    value = 0
    for b in symbol.encode():
        value = (value * 31 + b) % 1_000_003
    return value % buckets


def place_of(buckets: int) -> Column:
    """``bucket_of`` the column symbol."""
    bytes_of = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length("symbol"), F.lit(1))), lambda k: F.conv(F.hex(F.substring(F.col("symbol").cast("binary"), k, F.lit(1))), 16, 10).cast("long"))
    number = F.when(F.col("symbol") == "", 0).otherwise(F.aggregate(bytes_of, F.lit(0).cast("long"), lambda a, b: (a * 31 + b) % 1_000_003))
    return (number % buckets).cast("int")


def land_attempts(responses: DataFrame, folder: str, buckets: int) -> None:
    """Write responses (endpoint, symbol, attempt, status, body) for ``Landed``; a null status is a connection that failed.

    Symbols are dealt to ``buckets`` by their bytes, so a response is found by its name alone."""
    dealt = responses.withColumn("bucket", place_of(buckets))
    dealt.repartition("endpoint", "bucket").write.partitionBy("endpoint", "bucket").parquet(f"{folder}/responses")
    fs, root = open_path(folder)
    with fs.open_output_stream(f"{root}/_buckets") as f:
        f.write(str(buckets).encode())


def plan_requests(requests: DataFrame, path: str, per_partition: int = 500, place: Column | None = None) -> None:
    """Write requests in the order of endpoint, place and symbol, in files of at most ``per_partition``, each a task of the read."""
    order = ["endpoint", "__place", "symbol", "params"]
    placed = requests.select(*REQUESTS, (F.lit(0) if place is None else place).alias("__place"))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*REQUESTS)
    ordered.write.option("maxRecordsPerFile", per_partition).parquet(path)


class Requests(InputPartition):
    def __init__(self, path: str):
        self.path = path


class VendorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[Requests]:
        fs, root = open_path(self.options["requests"])
        files = fs.get_file_info(pafs.FileSelector(root))
        found = [Requests(f.path) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".parquet")]
        return found or [Requests("")]

    def attempts(self, transport, request: dict) -> Iterator[tuple]:
        """What each attempt of a request gave, the last one marked final; the last of ``tries`` is final whatever it gave."""
        tries, first, most = (float(self.options.get(k, d)) for k, d in (("tries", 3), ("first_pause", 0.5), ("most_pause", 30)))
        params = json.loads(request["params"] or "{}")
        for attempt in range(1, int(tries) + 1):
            status, body, error = None, None, None
            try:
                status, body = transport.fetch(request["endpoint"], request["symbol"], params, attempt)
            except OSError as failed:  # no response: timeouts and connections that break
                error = f"{type(failed).__name__}: {failed}"
            final = attempt >= tries or not (status is None or worth_retry(status))
            yield (*(request[c] for c in REQUESTS), attempt, status, body, error, final)
            if final:
                return
            time.sleep(pause_after(attempt, first, most))

    def read(self, partition: Requests) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        module, _, name = self.options.get("transport", f"{__name__}:Http").partition(":")
        transport = getattr(importlib.import_module(module), name)(self.options)
        fs, _ = open_path(self.options["requests"])
        rows, size = [], 0
        for batch in pq.ParquetFile(fs.open_input_file(partition.path)).iter_batches(columns=REQUESTS):
            for request in batch.to_pylist():
                for row in self.attempts(transport, request):
                    rows.append(row)
                    size += len(row[6] or "")
                    if size >= 4 << 20:  # bodies travel in batches of a few megabytes
                        yield self.batch(rows)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


class VendorSource(DataSource):
    """``spark.read.format("vendor")``; options: requests (a path of ``plan_requests``), transport (``module:Class``), tries,
    first_pause, most_pause, and those of the transport."""

    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return ATTEMPTS

    def reader(self, schema) -> VendorReader:
        return VendorReader(self.options)


def fetch(spark: SparkSession, requests: str, transport: str = f"{__name__}:Http", **options: str) -> DataFrame:
    """Every attempt (ATTEMPTS) of the requests planned at a path."""
    spark.dataSource.register(VendorSource)
    reader = spark.read.format("vendor").option("requests", requests).option("transport", transport)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def checked_requests(requests: DataFrame) -> DataFrame:
    """``requests``, or an error for parameters that aren't a JSON object or name a secret."""
    names = F.json_object_keys("params")
    secret = F.exists(names, lambda n: F.replace(F.lower(F.trim(n)), F.lit("_"), F.lit("-")).isin(*SECRETS))
    fault = F.when(F.col("params").isNotNull() & names.isNull(), "params are no object: ").when(secret, "a secret among the params: ")
    ok = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("endpoint"), F.lit("/"), F.col("symbol"))).cast("boolean")).otherwise(F.lit(True))
    return requests.where(ok)


def responses(attempts: DataFrame) -> DataFrame:
    """The bodies that can be parsed: final attempts with a status of success."""
    return attempts.where("final and status between 200 and 299").select(*REQUESTS, "attempt", "body")
