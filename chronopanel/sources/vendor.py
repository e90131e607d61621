"""Vendor payloads as columns: JSON to rows, HTML to text, candidate filters.  No request is made from here; payloads
are landed files or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEGACY_PRICES = "struct<symbol:string,historical:array<struct<date:string,open:double,high:double,low:double,close:double,adjClose:double,volume:double>>>"
STABLE_PRICES = "array<struct<symbol:string,date:string,adjOpen:double,adjHigh:double,adjLow:double,adjClose:double,volume:double>>"
#: Vendor statement fields and the metric each becomes.
INCOME_METRICS = {"revenue": "revenue", "grossProfit": "gross_profit", "operatingIncome": "operating_income", "netIncome": "net_income", "weightedAverageShsOutDil": "diluted_weighted_average_shares"}
CASH_FLOW_METRICS = {"netCashProvidedByOperatingActivities": "net_cash_from_operations", "capitalExpenditure": "capital_expenditure", "freeCashFlow": "free_cash_flow"}
ITEM_202 = r"(^|[,\s])2\.02([,\s]|$)"
#: Words of quarters in releases.
QUARTERS = (("first", "Q1"), ("second", "Q2"), ("third", "Q3"), ("fourth", "Q4"))
#: Forms of identifiers.
GRAMMARS = {"accession": r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$", "cik": r"^[0-9]{10}$", "ticker": r"^[A-Z][A-Z0-9.]{0,9}$", "hypothesis_key": r"^[a-z0-9][a-z0-9_-]{0,127}$"}


def legacy_prices(payloads: DataFrame, body: str) -> DataFrame:
    """Rows of ``{"symbol", "historical": [...]}`` payloads; order is left to what reads them."""
    rows = payloads.select(F.from_json(body, LEGACY_PRICES).alias("p")).select("p.symbol", F.explode("p.historical").alias("h"))
    return rows.select("symbol", F.to_date("h.date").alias("date"), "h.open", "h.high", "h.low", "h.close", F.col("h.adjClose").alias("adj_close"), F.col("h.volume").cast("bigint").alias("volume"))


def stable_prices(payloads: DataFrame, body: str) -> DataFrame:
    """Rows of array payloads with adjusted columns only; close is the adjusted close."""
    rows = payloads.select(F.explode(F.from_json(body, STABLE_PRICES)).alias("h"))
    return rows.select(
        "h.symbol", F.to_date("h.date").alias("date"), F.col("h.adjOpen").alias("open"), F.col("h.adjHigh").alias("high"), F.col("h.adjLow").alias("low"),
        F.col("h.adjClose").alias("close"), F.col("h.adjClose").alias("adj_close"), F.col("h.volume").cast("bigint").alias("volume"),
    )


def price_faults(prices: DataFrame) -> DataFrame:
    """Rows that break the price rules, with the first rule they break."""
    fault = (
        F.when(F.col("date").isNull(), "date").when(F.least("open", "high", "low", "close", "adj_close") <= 0, "not_positive")
        .when((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close")), "range").when(F.col("volume") < 0, "volume")
    )
    return prices.withColumn("fault", fault).where("fault is not null")


def of_symbol(found: Column, expected: Column) -> Column:
    """The symbol that a payload gives, or an error where another was asked for; case and outer spaces don't count."""
    same = F.upper(F.trim(found)).eqNullSafe(F.upper(F.trim(expected)))
    return F.when(same, found).otherwise(F.raise_error(F.concat(F.lit("asked for "), F.coalesce(expected, F.lit("nothing")), F.lit(", got "), F.coalesce(found, F.lit("nothing")))).cast("string"))


def statements(payloads: DataFrame, body: str, metrics: dict[str, str], since_year: int, expected: str | None = None) -> DataFrame:
    """Long metric rows of statement payloads; naive acceptance times are New York wall clock.

    ``expected`` names the column of the symbol that was asked for; a payload with another one is an error."""
    fields = ",".join(f"{f}:double" for f in metrics)
    schema = f"array<struct<symbol:string,date:string,calendarYear:string,fiscalYear:string,period:string,acceptedDate:string,{fields}>>"
    asked = F.col(expected) if expected else F.lit(None)
    rows = payloads.select(asked.alias("__expected"), F.explode(F.from_json(body, schema)).alias("s")).select("__expected", "s.*")
    if expected:
        rows = rows.withColumn("symbol", of_symbol(F.col("symbol"), F.col("__expected")))
    year = F.coalesce("fiscalYear", "calendarYear").cast("int")
    keyed = rows.select(
        "symbol", F.to_date("date").alias("period_end"), year.alias("fiscal_year"), F.col("period").alias("fiscal_period"),
        F.to_utc_timestamp(F.to_timestamp("acceptedDate"), "America/New_York").alias("accepted_at"), *[F.col(f).alias(m) for f, m in metrics.items()],
    ).where(F.col("fiscal_year") >= since_year)
    return keyed.unpivot(["symbol", "period_end", "fiscal_year", "fiscal_period", "accepted_at"], list(metrics.values()), "metric_name", "metric_value").where("metric_value is not null")


def companyfacts(payloads: DataFrame, body: str, tags: dict[str, str], unit: str = "USD", forms: tuple[str, ...] = ("10-Q", "10-K", "10-Q/A", "10-K/A")) -> DataFrame:
    """(cik, metric_name, fiscal_year, fiscal_period, period_start, period_end, metric_value, accession, form, filed) of company facts.

    tags: metric by tag of the general taxonomy; facts in other units or from other forms are left out.  A payload without
    facts is an error, a tag that it lacks is not.  A value that is told again in a later filing is a row of that filing."""
    fact = "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>"
    schema = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<units:map<string,{fact}>>>>>"
    parsed = payloads.select(F.from_json(body, schema).alias("p"))
    facts = F.when(F.col("p.facts").isNull(), F.raise_error(F.concat(F.lit("no facts of "), F.coalesce("p.cik", F.lit("nobody")))).cast(f"map<string,map<string,struct<units:map<string,{fact}>>>>")).otherwise(F.col("p.facts"))
    found = parsed.select(F.lpad("p.cik", 10, "0").alias("cik"), facts["us-gaap"].alias("gaap"))
    named = found.select("cik", F.explode(F.create_map(*[x for tag, name in tags.items() for x in (F.lit(name), F.col("gaap")[tag]["units"][unit])])).alias("metric_name", "facts"))
    rows = named.select("cik", "metric_name", F.explode("facts").alias("f")).where(F.col("f.form").isin(*forms) & F.col("f.val").isNotNull())
    return rows.select(
        "cik", "metric_name", F.col("f.fy").alias("fiscal_year"), F.col("f.fp").alias("fiscal_period"), F.to_date("f.start").alias("period_start"), F.to_date("f.end").alias("period_end"),
        F.col("f.val").alias("metric_value"), F.col("f.accn").alias("accession"), "f.form", F.to_date("f.filed").alias("filed"))


def submissions(payloads: DataFrame, body: str) -> DataFrame:
    """(cik, accession, form, items, filing_date, accepted, primary_document): the parallel arrays of recent filings as rows."""
    names = {"accessionNumber": "accession", "form": "form", "items": "items", "filingDate": "filing_date", "acceptanceDateTime": "accepted", "primaryDocument": "primary_document"}
    schema = "struct<cik:string,filings:struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in names) + ">>>"
    rows = payloads.select(F.from_json(body, schema).alias("p")).select(F.lpad("p.cik", 10, "0").alias("cik"), "p.filings.recent.*")
    out = zip_columns(rows, list(names)).withColumnsRenamed(names)
    return out.withColumn("filing_date", F.to_date("filing_date"))


def zip_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Parallel arrays as rows; unequal lengths are an error, where arrays_zip alone would pad."""
    sizes = F.array_distinct(F.array(*[F.size(c) for c in columns]))
    checked = F.when(F.size(sizes) == 1, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("parallel arrays differ in length")))
    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.inline(checked))


def earnings_candidates(filings: DataFrame, since: str) -> DataFrame:
    """8-K filings with item 2.02 on or after a date.  ``accepted`` ends in Z but is New York time; ``accepted_at`` descending is
    the order in which they are taken."""
    rows = filings.where(F.col("form").isin("8-K", "8-K/A") & F.col("items").rlike(ITEM_202) & (F.col("filing_date") >= F.lit(since).cast("date")))
    accepted = F.to_utc_timestamp(F.to_timestamp(F.regexp_replace("accepted", "Z$", "")), "America/New_York")
    return rows.withColumn("accepted_at", accepted)


def archive_documents(payloads: DataFrame, body: str) -> DataFrame:
    """(accession, name, size, modified) of archive index payloads; a payload without a directory is an error."""
    schema = "struct<directory:struct<item:array<struct<name:string,size:string,`last-modified`:string>>>>"
    parsed = payloads.select("accession", F.from_json(body, schema).alias("p"))
    items = F.when(F.col("p.directory.item").isNull(), F.raise_error(F.concat(F.lit("no directory in "), "accession"))).otherwise(F.col("p.directory.item"))
    rows = parsed.select("accession", F.explode(items).alias("d"))
    return rows.select("accession", "d.name", F.try_to_number(F.nullif(F.col("d.size"), F.lit("")), F.lit("999999999999")).cast("bigint").alias("size"), F.try_to_timestamp(F.col("d.last-modified")).alias("modified"))


def earnings_exhibits(files: DataFrame) -> DataFrame:
    """(accession, exhibit): the lowest html name that says exhibit 99 and isn't the primary document, whatever its case."""
    low = F.lower("name")
    compact = F.translate(low, "-_", "")
    html = low.endswith(".htm") | low.endswith(".html")
    named = html & (low != F.lower("primary_document")) & (compact.contains("ex99") | compact.contains("exhibit99"))
    return files.where(named).groupBy("accession").agg(F.min("name").alias("exhibit"))


#: Names of the characters from U+00A0 to U+00FF, in order, and of those that markup needs.
LATIN_NAMES = (
    "nbsp iexcl cent pound curren yen brvbar sect uml copy ordf laquo not shy reg macr deg plusmn sup2 sup3 acute micro para middot cedil sup1 ordm raquo frac14 frac12 frac34 iquest "
    "Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml ETH Ntilde Ograve Oacute Ocirc Otilde Ouml times Oslash Ugrave Uacute Ucirc Uuml Yacute THORN szlig "
    "agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml eth ntilde ograve oacute ocirc otilde ouml divide oslash ugrave uacute ucirc uuml yacute thorn yuml"
).split()
MARKUP_NAMES = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39}
_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescaped(text: Column) -> Column:
    """Character references decoded: by number, and by the names above; others, and numbers that are no character, stay."""
    codes = F.create_map(*[F.lit(x) for name, code in [*MARKUP_NAMES.items(), *zip(LATIN_NAMES, range(160, 256))] for x in (name, code)])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, _REFERENCE, 1)
        number = F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 8).cast("int")).when(name.startswith("#"), F.conv(F.substring(name, 3, 8), 16, 10).cast("int")).otherwise(codes[name])
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when((name != "") & F.coalesce(valid, F.lit(False)), F.concat(character, F.substr(piece, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.concat(pieces[0], F.array_join(rest, ""))


def html_title(html: Column) -> Column:
    """The title without inner tags, entities decoded, spaces collapsed; null where there is none."""
    inner = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", " ")
    return F.nullif(F.trim(F.regexp_replace(unescaped(inner), r"\s+", " ")), F.lit(""))


def html_text(html: Column | str) -> Column:
    """Text of a page: no comments, scripts, styles or tags, references decoded, white space collapsed.

    What stands between two tags is a word of its own; a script that isn't closed hides the rest, a tag that isn't stays."""
    text = F.col(html) if isinstance(html, str) else html
    for hidden in ("<!--.*?-->", *(f"<{tag}\\b[^>]*>.*?(</{tag}\\s*>|$)" for tag in ("script", "style")), "<[^>]+>"):
        text = F.regexp_replace(text, f"(?is){hidden}", " ")
    return F.trim(F.regexp_replace(unescaped(text), r"[\s\u00A0]+", " "))


def earnings_like(text: Column) -> Column:
    low = F.lower(text)
    return (low.contains("financial results") | low.contains("earnings")) & (low.contains("quarter") | low.contains("fiscal year"))


def fiscal_fields(text: Column) -> tuple[Column, Column, Column]:
    """(fiscal_year, fiscal_period, period_end) named in a release; a year that isn't named is the period end's."""
    low = F.lower(text)
    period = F.when(low.rlike(r"\bfiscal\s+year\s+ended\b"), "FY")
    for word, name in reversed(QUARTERS):
        period = F.when(low.rlike(rf"\b{word}\s+quarter\b"), name).otherwise(period)
    ended = F.regexp_extract(F.regexp_replace(text, r"\s+", " "), r"(?:quarter|fiscal year|year) ended ([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    end = F.try_to_timestamp(F.nullif(ended, F.lit("")), F.lit("MMMM d, yyyy")).cast("date")
    year = F.coalesce(F.nullif(F.regexp_extract(low, r"\bfiscal\s+(\d{4})\b", 1), F.lit("")).cast("int"), F.year(end))
    return year, period, end


def release_evidence(rows: DataFrame, body: str) -> DataFrame:
    """``rows`` with fiscal_year, fiscal_period, period_end, confidence, excerpt and ``fault``: why a release tells nothing."""
    text = F.trim(F.regexp_replace(F.col(body), r"\s+", " "))
    year, period, end = fiscal_fields(text)
    fault = F.when(text == "", "empty").when(~earnings_like(text), "not_earnings").when(end.isNull(), "no_period_end").when(period.isNull(), "no_quarter")
    ok = fault.isNull()
    return rows.select(
        *[c for c in rows.columns if c != body], F.when(ok, year).alias("fiscal_year"), F.when(ok, period).alias("fiscal_period"), F.when(ok, end).alias("period_end"),
        F.when(ok, F.when(period == "FY", "medium").otherwise("high")).alias("confidence"), F.when(ok, F.left(text, F.lit(500))).alias("excerpt"), fault.alias("fault"))


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """A calendar file with exactly the expected header; a bad value fails the read."""
    schema = "date date, is_session boolean, session_close timestamp, is_early_close boolean"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
