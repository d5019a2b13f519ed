"""Inputs derived from the driver's tables: one SQL text for both engines, but for a few marked words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_pad = "lpad(CAST({} AS STRING), {}, '0')"
_amount = "concat(CAST(CAST((c - c % 100) / 100 AS BIGINT) AS STRING), ',', lpad(CAST(c % 100 AS STRING), 2, '0'))"
_d, _m, _y = (f"lpad(CAST({p}(o_orderdate) AS STRING), {n}, '0')" for p, n in (("day", 2), ("month", 2), ("year", 4)))

#: text of an invoice for each order; conditions over the key give hits and misses.
INVOICES = f"""SELECT k AS doc_id, concat_ws(chr(10), 'Finanzamt Musterstadt',
 CASE WHEN k % 3 <> 2 THEN 'Für Herrn Muster' END, CASE WHEN k % 4 = 0 THEN concat('Rechnung Nr. ', CAST(k + 100000 AS STRING)) END,
 CASE WHEN k % 2 = 0 THEN concat('Steuernummer ', {_pad.format('k % 1000', 3)}, '/', {_pad.format('k % 10000', 4)}, '/', {_pad.format('7 * k % 10000', 4)}) END,
 concat('Datum: ', CASE k % 5 WHEN 0 THEN concat({_d}, '-', {_m}, '-', {_y}) WHEN 1 THEN concat({_d}, '/', {_m}, '/', {_y}) WHEN 2 THEN concat({_y}, '-', {_m}, '-', {_d})
  WHEN 3 THEN concat({_d}, '.', {_m}, '.', {_y}) ELSE concat(CAST(day(o_orderdate) AS STRING), ' ', @month, ' ', {_y}) END),
 CASE WHEN k % 2 = 1 THEN concat('Summe: ', {_amount}) END, CASE WHEN k % 3 = 0 THEN concat({_amount}, ' €') END,
 CASE WHEN k % 3 = 1 THEN concat('Ref AB/', {_pad.format('k % 1000', 3)}, '/2024') END, CASE WHEN k % 5 = 2 THEN concat('Akte 2024.', {_pad.format('k % 100', 2)}, '.', {_pad.format('k % 1000', 3)}) END,
 CASE WHEN k % 3 <> 1 THEN concat('Tel +49 171 ', {_pad.format('k % 1000', 3)}, ' ', {_pad.format('3 * k % 1000', 3)}) END,
 CASE WHEN k % 4 = 0 THEN concat('Mob +316', {_pad.format('k', 8)}) WHEN k % 4 = 1 THEN concat('Mob 06', {_pad.format('k', 8)}) END,
 CASE WHEN k % 17 <> 0 THEN CASE WHEN k % 11 = 0 THEN 'info@example.com' ELSE concat('kontakt', CAST(k AS STRING), '@mail', CAST(k % 7 AS STRING), '.example.org') END END,
 CASE k % 7 WHEN 0 THEN concat('Rechnungsbetrag: ', {_amount}) WHEN 1 THEN concat('Belegnummer: B', CAST(k AS STRING)) WHEN 2 THEN concat('Factuurnr. F', CAST(k AS STRING)) WHEN 6 THEN concat('Kenmerk: REF-', CAST(k AS STRING), '-2024') WHEN 3 THEN concat('Nr ', {_pad.format('k % 1000', 3)}, '/', {_pad.format('7 * k % 1000', 3)}) WHEN 4 THEN concat('IdNr 92 047 135 ', {_pad.format('k % 1000', 3)}) WHEN 5 THEN concat('ABC/DE/24/', {_pad.format('k % 1000', 3)}, 'R') END,
 CASE k % 5 WHEN 0 THEN concat('Absender: Firma ', CAST(k AS STRING)) WHEN 1 THEN concat('An: Kunde ', CAST(k AS STRING)) END, CASE WHEN k % 2 = 0 THEN 'Hauptstr 12, 10115 Berlin' END,
 CASE WHEN k % 13 = 0 THEN concat_ws(chr(10), 'Belastingdienst', 'Postbus 2536', '6401 DA HEERLEN') END, CASE WHEN k % 3 = 0 THEN concat_ws(chr(10), 'Jan Jansen', 'Kerkstraat 12', '1234 AB Amsterdam') END) AS text
FROM (SELECT o_orderkey AS k, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)"""

PAGES = """SELECT doc_id, page_no, concat('/in/', kind, '/doc', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('_page', CAST(page_no AS STRING)) END, '.jpg') AS path, mt
FROM (SELECT o_orderkey AS doc_id, CAST(p AS BIGINT) AS page_no, o_orderdate AS mt, CASE o_orderkey % 4 WHEN 0 THEN 'rechnung' WHEN 1 THEN 'steuer' WHEN 2 THEN 'brief' ELSE 'other' END AS kind
 FROM orders CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE p <= 1 + o_orderkey % 3)"""

BOXES = """SELECT image_id, ord, x1, y1, x2, y2, field, concat(field, ' ', CAST(ord AS STRING)) AS value, confidence FROM (SELECT l_orderkey AS image_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS ord,
 l_partkey % 200 AS x1, l_suppkey % 100 AS y1, l_partkey % 200 + 80 + CAST(l_quantity AS BIGINT) AS x2, l_suppkey % 100 + 40 + 5 * CAST(l_linenumber AS BIGINT) AS y2,
 CASE l_partkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Date' WHEN 2 THEN 'Email' ELSE 'Phone' END AS field, 50 + l_suppkey % 50 AS confidence FROM lineitem)"""

CURATION = f"""SELECT user_id AS doc_id, event_id AS ordinal, CASE event_type WHEN 'error' THEN ' ' WHEN 'click' THEN concat({_y}, '-', {_m}, '-', {_d}) WHEN 'view' THEN 'AB/123/2024'
 WHEN 'signup' THEN concat('user', CAST(user_id AS STRING), '@mail.example.org') ELSE concat('text ', CAST(event_id AS STRING)) END AS value FROM events""".replace("o_orderdate", "ts")

REVIEWS = """SELECT doc_id AS entry_id, doc_id, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence, quality = 0 OR toxic = 1 AS needs_review FROM labels"""


def spread(table: DataFrame, *by: str) -> DataFrame:
    """A table's rows dealt over the shuffle's partitions, by columns or evenly: work on rows that is much dearer than reading
    them would else have as many tasks as the file has row groups, which may be one."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def duck(sql: str) -> str:
    return f"({sql.replace('@month', 'monthname(o_orderdate)')})"


def over(spark: SparkSession, table: DataFrame, sql: str, name: str) -> DataFrame:
    """A derived input over a given table, which may be a stream."""
    return spark.sql(sql.replace("@month", "date_format(o_orderdate, 'MMMM')").replace(f"FROM {name}", "FROM {t}"), t=table)


def view(spark: SparkSession, sf_dir: str, sql: str, by: str | None = None) -> DataFrame:
    """A derived input as a DataFrame, its table read from Parquet and, if a column of it is named, dealt by that: views that
    are dealt by one column of a table are joined by it where they lie."""
    for name in ("orders", "lineitem", "events", "labels"):
        if f"FROM {name}" in sql:
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if sql == BOXES:
                # dealt by image before the view's columns are made: they are not exchanged beside those they come from, and
                # what groups boxes by image needs no other exchange
                rows = rows.repartition("l_orderkey")
            if by:
                return over(spark, spread(rows.select("o_orderkey", "o_orderdate", "o_totalprice") if name == "orders" else rows, by), sql, name)
            # what is made of an invoice's text is dear, and a row of orders is short
            return over(spark, spread(rows.select("o_orderkey", "o_orderdate", "o_totalprice")) if sql == INVOICES else rows, sql, name)
    raise ValueError("the view names no table")
