"""Reading landed files: trade CSV and JSON, rate JSON, release pages, dimension tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.functions import expr as X
from harborline.operators.relational import latest_by

#: The columns of the bulk file in order.
BULK_COLUMNS = (
    "REPORTER", "PARTNER", "TRADE_TYPE", "PRODUCT_NC", "PRODUCT_SITC", "PRODUCT_CPA21", "PRODUCT_CPA22", "PRODUCT_BEC", "PRODUCT_BEC5",
    "PRODUCT_SECTION", "FLOW", "STAT_PROCEDURE", "SUPPL_UNIT", "VALUE_EUR", "VALUE_NAC", "QUANTITY_KG", "QUANTITY_SUPPL_UNIT",
)


def read_bulk_trade(spark: SparkSession, path: str, month_idx: int) -> DataFrame:
    """Raw EU rows: codes padded to 8 characters, measures as exact decimals; rows without a readable flow go."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in BULK_COLUMNS])
    raw = spark.read.csv(path, schema=schema, header=True)
    text = [F.col(c).alias(c.lower()) for c in BULK_COLUMNS if c not in ("PRODUCT_NC", "FLOW") and not c.startswith(("VALUE", "QUANTITY"))]
    number = lambda c, t: F.expr(f"try_cast(trim({c}) AS {t})").alias(c.lower())
    out = raw.select(
        F.lit(month_idx).alias("month_idx"), *text, F.lpad("PRODUCT_NC", 8, "0").alias("product_nc"), number("FLOW", "INT"),
        number("VALUE_EUR", "DECIMAL(18,2)"), number("VALUE_NAC", "DECIMAL(18,2)"), number("QUANTITY_KG", "DECIMAL(20,3)"), number("QUANTITY_SUPPL_UNIT", "DECIMAL(20,3)"),
    )
    return out.where("flow is not null")


def filter_trade(df: DataFrame, partners: list[str] | None = None, reporters: list[str] | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """Each filter is optional; all that are given hold."""
    if partners is not None:
        df = df.where(F.col("partner").isin(*partners))
    if reporters is not None:
        df = df.where(F.col("reporter").isin(*reporters))
    if prefixes is not None:
        df = df.where(X.starts_with_any("product_nc", prefixes))
    return df


def read_uk_trade(spark: SparkSession, path: str, country_map: DataFrame, rates: DataFrame, one_a_line: bool = False) -> DataFrame:
    """Raw UK rows from JSON pages of {value: [{MonthId, CountryId, FlowTypeId, SuppressionIndex, Value, NetMass, Commodity: {…}}]}.

    Unknown countries go; flow types 1 and 3 are imports, 2 and 4 exports, others go; the month's rate converts.
    country_map: country_id, partner; rates: month_idx, rate.  A file is a page, or has one page a line.
    """
    commodity = "STRUCT<Hs2Code: STRING, Hs4Code: STRING, Hs6Code: STRING, Cn8Code: STRING>"
    row = f"STRUCT<MonthId: INT, CountryId: INT, FlowTypeId: INT, SuppressionIndex: INT, PortId: INT, Value: DECIMAL(18,2), NetMass: DECIMAL(20,3), SuppUnit: DECIMAL(20,3), Commodity: {commodity}>"
    pages = spark.read.schema(f"value ARRAY<{row}>").json(path, multiLine=not one_a_line)
    r = pages.select(F.explode("value").alias("r")).select("r.*")
    flow = F.when(F.col("FlowTypeId").isin(1, 3), 1).when(F.col("FlowTypeId").isin(2, 4), 2)
    r = r.select(
        (F.floor(F.col("MonthId") / 100) * 12 + F.col("MonthId") % 100 - 1).cast("int").alias("month_idx"), F.col("CountryId").alias("country_id"), F.lpad("Commodity.Cn8Code", 8, "0").alias("product_nc"),
        F.col("Commodity.Hs6Code").alias("product_hs6"), F.col("FlowTypeId").alias("flow_type_id"), flow.alias("flow"), F.coalesce("SuppressionIndex", F.lit(0)).alias("suppression_index"),
        F.col("PortId").alias("port_id"), F.col("Value").alias("value_gbp"), F.col("NetMass").alias("net_mass_kg"),
    ).where("flow is not null")
    r = r.join(country_map, "country_id").join(rates, "month_idx", "left")
    return r.withColumn("value_eur", F.col("value_gbp") * F.col("rate")).drop("rate", "country_id")


def read_fx_json(spark: SparkSession, path: str, currency: str) -> DataFrame:
    """currency_from, month_idx, rate (inverted: units of EUR for one unit) of one rate document; zero and null go."""
    shape = "dataSets ARRAY<STRUCT<series: MAP<STRING, STRUCT<observations: MAP<STRING, ARRAY<DOUBLE>>>>>>, structure STRUCT<dimensions: STRUCT<observation: ARRAY<STRUCT<values: ARRAY<STRUCT<id: STRING>>>>>>"
    doc = spark.read.schema(shape).json(path, multiLine=True)
    months = doc.select(F.explode("dataSets").alias("d"), F.col("structure.dimensions.observation")[0]["values"].alias("ids"))
    rows = months.select(F.explode("d.series").alias("k", "s"), "ids").select(F.explode("s.observations").alias("at", "v"), "ids")
    month = F.get("ids", F.col("at").cast("int"))["id"]
    idx = F.split(month, "-")[0].cast("int") * 12 + F.split(month, "-")[1].cast("int") - 1
    return rows.select(F.lit(currency).alias("currency_from"), F.lit("EUR").alias("currency_to"), idx.alias("rate_idx"), F.get("v", F.lit(0)).alias("x")).where("x <> 0").select("currency_from", "currency_to", "rate_idx", (1 / F.col("x")).alias("rate"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, html (binary), content hash and modification time of stored pages."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), F.col("content").alias("html"), F.sha2("content", 256).alias("content_sha256"), F.col("modificationTime").alias("fetched_at"))


def read_lookup(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def unprocessed(inputs: DataFrame, run_log: DataFrame, key: str = "url") -> DataFrame:
    """Inputs whose latest run did not end in success or without a parser; failed ones come again."""
    done = latest_by(run_log, [key], F.desc("finished_at")).where(F.col("status").isin("success", "no_parser"))
    return inputs.join(done.select(key), key, "left_anti")


class _Page(HTMLParser):
    """Title, publication date, unit and the rows of cells of a release page."""

    def __init__(self) -> None:
        super().__init__()
        self.texts = {"title": "", "atcl-ttl": "", "atcl-date": ""}
        self.unit, self.rows, self._row, self._wide = None, [], None, False
        self._open: list[list] = []  # [tag, name of the text it feeds, its text]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        named = next((n for n in (a.get("class") or "").split() if n in self.texts), None)
        if tag == "tr":
            self._row, self._wide = [], False
        elif tag in ("td", "th", "span", "title") or named:
            self._open.append([tag, "title" if tag == "title" else named, ""])
            self._wide |= tag == "td" and bool(a.get("colspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr" and self._row is not None:
            self.rows.append((self._row, self._wide))
            self._row = None
        elif self._open and self._open[-1][0] == tag:
            _, name, text = self._open.pop()
            if name and not self.texts[name]:
                self.texts[name] = text.strip()
            if self.unit is None and text.strip().startswith("Unit:"):
                self.unit = text.strip()[5:].strip()
            if tag in ("td", "th") and self._row is not None:
                self._row.append(text)

    def handle_data(self, data: str) -> None:
        for x in self._open:
            x[2] += data


def page_cells(pages: DataFrame) -> DataFrame:
    """url, title, published, unit, row, cells, wide (a cell spans columns), error: a row per table row; an unreadable page or one
    without rows is one row with an error."""
    names = ["url", "title", "published", "unit", "row", "cells", "wide", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                try:
                    p = _Page()
                    p.feed(html.decode("utf-8") if isinstance(html, bytes) else html)
                    head = (url, p.texts["atcl-ttl"] or p.texts["title"], p.texts["atcl-date"], p.unit)
                    out += [(*head, i, r, wide, None) for i, (r, wide) in enumerate(p.rows)] or [(*head, None, None, None, "no rows")]
                except (ValueError, AttributeError, TypeError) as e:
                    out.append((url, None, None, None, None, None, None, str(e)))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return pages.select("url", "html").mapInArrow(run, "url string, title string, published string, unit string, row int, cells array<string>, wide boolean, error string")


#: Months, shapes of release titles (dated, with January and February as one; or without a date), the unit of each currency.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTHS = tuple(m[:3] for m in MONTH_NAMES)
_MONTH = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTH_NAMES)
_HEAD = r"^\s*(?:\((\d+)\)\s*)?(.+?)"
_TAIL = r"\((?:Only[^,()]*,\s*)?(?:in\s*)?(CNY|USD|RMB)\)\s*"
DATED = rf"{_HEAD},\s*({_MONTH})\.?\s*(?:[-\u2013\u2014]\s*(Feb(?:ruary)?)\.?\s*)?,?\s*(\d{{4}})\s*(?:{_TAIL})?$"
UNDATED = rf"{_HEAD}\s*{_TAIL}$"
UNITS = {"CNY": "CNY 100 Million", "USD": "USD1 Million"}


def title_parts(title: Column, expected_currency: Column, expected_idx: Column) -> Column:
    """struct(section, description, month_idx, combined, currency, reason) of a release title.

    The expected currency and month stand in where the title has none; the description overrules a wrong section number.
    """
    dated = title.rlike(DATED)
    part = lambda i, j: F.when(dated, F.regexp_extract(title, DATED, i)).when(title.rlike(UNDATED), F.regexp_extract(title, UNDATED, j) if j else F.lit(""))
    section, description, currency = part(1, 1), part(2, 2), part(6, 3)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(part(3, 0), 1, 3))
    combined = F.coalesce(part(4, 0) != "", F.lit(False))
    said = F.lower(description)
    told = F.when(said.rlike("by (?:major )?country|by region"), 4).when(said.contains("by trade mode"), 2)
    currency = F.when(F.coalesce(currency, F.lit("")) == "", expected_currency).otherwise(currency)
    idx = F.when(dated, (part(5, 0).cast("int") * 12 + F.when(combined, 1).otherwise(month - 1)).cast("int")).otherwise(expected_idx)
    reason = (
        F.when(description.isNull() | (combined & (month != 1)), "title not recognised").when(idx.isNull(), "no period").when(currency.isNull(), "no currency")
    )
    return F.struct(
        F.coalesce(told, F.when(section != "", section.cast("int")), F.lit(1)).alias("section"), F.trim(description).alias("description"), idx.cast("int").alias("month_idx"),
        combined.alias("combined"), F.when(currency == "RMB", "CNY").otherwise(currency).alias("currency"), reason.alias("reason"),
    )


def parse_release_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, errors) of release pages (url, html; and, where known, expected_currency and expected_idx).

    Rows of 10 cells: label, then monthly and cumulative values of total, export and import (changes ignored); on a page of January
    and February as one, rows of 7 cells: label and the sums of the three.  A page whose unit contradicts its
    currency, and one without any observation, goes to errors with the reason.
    """
    has = lambda c, t: F.col(c) if c in pages.columns else F.lit(None).cast(t)
    known = pages.select("url", has("expected_currency", "string").alias("expected_currency"), has("expected_idx", "int").alias("expected_idx"))
    c = page_cells(pages).join(known, "url").withColumn("t", title_parts(F.col("title"), F.col("expected_currency"), F.col("expected_idx")))
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    canonical = units[F.col("t.currency")]
    c = c.withColumn("reason", F.coalesce("error", "t.reason", F.when(F.col("unit") != canonical, "unit contradicts currency"))).withColumn("unit", F.coalesce(canonical, "unit"))
    published = F.coalesce(F.to_date(F.expr("try_to_timestamp(published, 'yyyy/MM/dd')")), F.to_date(F.expr("try_to_timestamp(published, 'dd/MM/yyyy')")))
    flows = ("total", "export", "import")
    cell = lambda k, f, i: F.struct(F.lit(k).alias("period_kind"), F.lit(f).alias("flow"), F.get("cells", F.lit(i)).alias("text"))
    monthly = F.array(*(cell(k, f, 1 + 2 * i + j) for i, f in enumerate(flows) for j, k in enumerate(("monthly", "ytd"))))
    chunk = F.array(*(cell("cumulative_jan_feb", f, 1 + i) for i, f in enumerate(flows)))
    rows = c.where(F.col("reason").isNull() & ~F.col("wide") & (F.size("cells") == F.when(F.col("t.combined"), 7).otherwise(10)))
    rows = rows.select("url", "t.section", "t.currency", "t.month_idx", "unit", published.alias("published"), X.partner_label(F.get("cells", F.lit(0))).alias("p"), F.when(F.col("t.combined"), chunk).otherwise(monthly).alias("v"))
    # a row with any cell that is no number is a heading
    rows = rows.where((F.col("p.label") != "") & ~F.exists("v", lambda v: X.number_rejected(v["text"]))).withColumn("v", F.explode("v"))
    obs = rows.select(
        "url", "section", "currency", "month_idx", "unit", "published", F.col("p.label").alias("label"), F.col("p.indent").alias("indent"), F.col("p.is_subset").alias("is_subset"),
        F.col("v.period_kind").alias("period_kind"), F.col("v.flow").alias("flow"), X.parse_number("v.text").alias("value_amount"),
    ).where("value_amount is not null")
    reasons = c.groupBy("url").agg(F.min("reason").alias("reason"))
    errors = split_empty(pages, obs).drop("error").join(reasons, "url", "left").select("url", F.coalesce("reason", F.lit("no observations")).alias("error"))
    return obs, errors


def split_empty(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """Pages without a parsed row, as errors."""
    return pages.select("url").join(parsed.select("url").distinct(), "url", "left_anti").withColumn("error", F.lit("no observations"))


def to_observations(raw: DataFrame, raw_id: Column | str = "raw_id") -> DataFrame:
    """Cells of raw EU rows: exact sums, the unit of the lowest id, sorted lineage ids."""
    keys = ["month_idx", "reporter", "partner", "product_nc", "flow"]
    s = raw.groupBy(*keys).agg(
        F.sum("value_eur").alias("value_amount"), F.sum("quantity_kg").alias("kg"), F.sum("quantity_suppl_unit").alias("suppl"),
        F.min_by("suppl_unit", X.col(raw_id)).alias("unit"), F.array_sort(F.collect_list(X.col(raw_id))).alias("raw_row_ids"), F.count("*").alias("n_raw"),
    )
    return s.withColumn("quantity", F.when(F.coalesce("suppl", F.lit(0)) != 0, F.col("suppl")).otherwise(F.col("kg"))).withColumn("quantity_unit", F.when(F.coalesce("suppl", F.lit(0)) != 0, F.col("unit")).otherwise("kg")).drop("suppl", "unit")


def to_observations_uk(raw: DataFrame) -> DataFrame:
    """Cells of raw UK rows: suppressed rows are left out of sums but counted and listed."""
    open_ = F.col("suppression_index") == 0
    return raw.groupBy("month_idx", "reporter", "partner", "product_nc", "flow").agg(
        F.sum(F.when(open_, F.col("value_eur"))).alias("value_amount"), F.sum(F.when(open_, F.col("quantity_kg"))).alias("kg"),
        F.count("*").alias("n_raw"), F.count_if(~open_).alias("n_suppressed"), F.array_sort(F.collect_list(F.when(~open_, F.col("raw_id")))).alias("suppressed_ids"),
    )
