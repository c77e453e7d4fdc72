"""Order messages, quotes and snapshots derived from the given tables, as SQL that other engines read too, and as files of records.

Messages are numbered by day, raw ones over the whole table; here by a range sort, in the SQL by windows, of which each would need a day or the table in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import parts, with_index
from tidemark.sources import fixedrec

GROUP = ["ticker_id", "day_id"]
ROW_GROUP = 4_000_000  # bytes of a row group of a piece of a feed, so that several tasks read it
_ORDER = "l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice"

MBO = f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
   CAST(l_orderkey % 5 AS INT) AS ticker_id, CAST(FLOOR(l_orderkey/5) % 4 AS INT) AS day_id,
   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS BIGINT) AS k,
   CAST(row_number() OVER (PARTITION BY l_orderkey%5, FLOOR(l_orderkey/5)%4 ORDER BY {_ORDER}) AS BIGINT) AS seq,
   CAST(FLOOR(l_orderkey/20) + CASE WHEN l_partkey%23=0 THEN 1 ELSE 0 END AS BIGINT)%2 AS s,
   count(*) OVER (PARTITION BY l_orderkey%5, FLOOR(l_orderkey/5)%4) AS n FROM lineitem)
SELECT ticker_id, day_id, seq,
 CAST(1767623100000000 + day_id*86400000000 + FLOOR(24000000000.0*(seq-1)/n) AS BIGINT) AS ts_us,
 CAST(CASE WHEN k=1 OR l_linenumber<=2 THEN 1 WHEN l_linenumber IN (3,4) THEN 2 WHEN l_linenumber=5 THEN 4 WHEN l_linenumber=6 THEN 3 ELSE 2 END AS INT) AS event_type,
 l_orderkey AS order_id, CAST(l_quantity*10 AS INT) AS size,
 CAST(CASE WHEN l_partkey%97=0 THEN 0 WHEN l_partkey%89=0 THEN 10000000
   WHEN s=0 THEN 9990-l_partkey%40 ELSE 10010+l_partkey%40 END AS BIGINT) AS price,
 CAST(CASE WHEN s=0 THEN 1 ELSE -1 END AS INT) AS direction FROM b"""

TRUTH = f"""SELECT ticker_id, day_id, seq AS tseq,
 ts_us, CAST(9990-CASE WHEN seq%5=0 THEN 1 ELSE 0 END AS BIGINT) AS bid_px, 100 AS bid_sz,
 CAST(10010+CASE WHEN seq%8=0 THEN 1 ELSE 0 END AS BIGINT) AS ask_px, 100 AS ask_sz
FROM ({MBO}) mbo WHERE seq>100 AND seq%7=0"""

TRUTH_ZERO = f"SELECT ticker_id, day_id, tseq, ts_us, CASE WHEN tseq%35=0 THEN 0 ELSE bid_px END AS bid_px, bid_sz, CASE WHEN tseq%91=0 THEN 0 ELSE ask_px END AS ask_px, ask_sz FROM ({TRUTH}) truth"
TRUTH_GAP = f"SELECT * FROM ({TRUTH}) truth WHERE day_id <> 2"

_SNAP = """SELECT CAST(user_id%2 AS INT) AS ticker_id, CAST(FLOOR({US}/86400000000) AS INT) AS day_id, event_id AS seq, {US} AS ts_us,
 1000000+CAST(ROUND(value*10) AS BIGINT) AS b0, 1000001+CAST(ROUND(value*10) AS BIGINT)+event_id%3 AS a0 FROM events"""
_SPARK_US, _DUCK_US = "unix_micros(CAST(ts AS TIMESTAMP))", "epoch_us(ts)"

RAW = """SELECT CAST(1767623100000000000 + CAST({seq} AS BIGINT)*1000003 AS BIGINT) AS ts_event,
 CAST({seq} AS BIGINT) AS seq,
 CAST(CASE l_orderkey%6 WHEN 0 THEN 11667 WHEN 1 THEN 15144 WHEN 2 THEN 16244 WHEN 3 THEN 12716 WHEN 4 THEN 773 ELSE 999 END AS INT) AS instrument_id,
 CASE l_partkey%9 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'C' WHEN 3 THEN 'F' WHEN 4 THEN 'T' WHEN 5 THEN 'D' WHEN 6 THEN 'R' WHEN 7 THEN 'X' ELSE 'A' END AS action,
 CASE WHEN l_linestatus='O' THEN 'B' WHEN l_returnflag='N' THEN 'N' ELSE 'A' END AS side,
 CASE WHEN l_suppkey%50=0 THEN 9223372036854775807 WHEN l_suppkey%51=0 THEN CAST(-5 AS BIGINT) ELSE CAST(ROUND(l_extendedprice*100) AS BIGINT)*1000 + l_partkey%1000 END AS price,
 CAST(l_quantity AS INT) AS size, l_orderkey AS order_id FROM {{lineitem}}"""
MBO_RAW = RAW.format(seq=f"row_number() OVER (ORDER BY {_ORDER})").replace("{lineitem}", "lineitem")

MBP_RAW = f"""SELECT ts_event, seq, instrument_id, price AS bid_px, size AS bid_sz,
 CASE WHEN seq%11=0 THEN 9223372036854775807 WHEN seq%13=0 THEN price-100000 ELSE price+200000+(seq%3)*100000 END AS ask_px, size+1 AS ask_sz
FROM ({MBO_RAW}) raw WHERE price < 9000000000000000000"""

PREDS = """SELECT vec_id, CAST(label%3 AS INT) AS label, CAST(CASE WHEN vec_id%4=0 THEN vec_id%3 ELSE label%3 END AS INT) AS pred, CAST(vec_id%5 AS INT) AS day_id FROM embeddings"""

INSTRUMENTS = "SELECT * FROM (VALUES (0,'nvda',11667),(1,'spy',15144),(2,'tsla',16244),(3,'pltr',12716),(4,'amd',773)) AS t(ticker_id,ticker,instrument_id)"
CALENDAR = "SELECT * FROM (VALUES (0,'train'),(1,'train'),(2,'valid'),(3,'test'),(4,'test')) AS t(day_id,split)"

ORACLE = {
    "mbo": MBO, "truth": TRUTH, "truth_zero": TRUTH_ZERO, "truth_gap": TRUTH_GAP, "snap_all": _SNAP.format(US=_DUCK_US), "mbo_raw": MBO_RAW, "mbp_raw": MBP_RAW, "preds": PREDS,
    "instruments": INSTRUMENTS, "calendar": CALENDAR,
    "snap": f"SELECT * FROM ({_SNAP.format(US=_DUCK_US)}) WHERE (CAST(FLOOR(ts_us/1000000) AS BIGINT)-18000)%86400 >= 34200 AND (CAST(FLOOR(ts_us/1000000) AS BIGINT)-18000)%86400 < 57600",
}
#: Spark divides these numbers as decimals, rounded to six places, other engines as doubles, which a day of many messages tells apart.
_DECIMAL, _DOUBLE = "24000000000.0", "24000000000D"
_LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
_SOURCE = {"mbo": "lineitem", "truth": "lineitem", "truth_zero": "lineitem", "truth_gap": "lineitem", "snap_all": "events", "mbo_raw": "lineitem", "mbp_raw": "lineitem", "preds": "embeddings"}


def _messages(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``mbo`` from lines: places in the whole order, less that of the day's first; a day is spread over tasks."""
    n, order = lines.count(), _ORDER.split(",")
    days = {"ticker_id": F.expr("CAST(l_orderkey % 5 AS INT)"), "day_id": F.expr("CAST(FLOOR(l_orderkey/5) % 4 AS INT)")}
    rows = with_index(lines.select(*_LINES).withColumns(days), [*GROUP, *order], "__place", n)
    whole = rows.groupBy(*GROUP).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("n")).withColumnsRenamed({c: f"__{c}" for c in GROUP})
    rows = rows.join(F.broadcast(whole), F.col("ticker_id").eqNullSafe(F.col("__ticker_id")) & F.col("day_id").eqNullSafe(F.col("__day_id")))  # one row a group
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("__place")).cast("long")
    s = F.expr("CAST(FLOOR(l_orderkey/20) + CASE WHEN l_partkey%23=0 THEN 1 ELSE 0 END AS BIGINT)%2")
    b = rows.repartition(*parts(rows, n), "l_orderkey").select(*GROUP, *_LINES, "n", k.alias("k"), (F.col("__place") - F.col("__first") + 1).alias("seq"), s.alias("s"))
    return spark.sql(MBO.partition(" FROM lineitem)\n")[2].replace("FROM b", "FROM {b}").replace(_DECIMAL, _DOUBLE), b=b)


def fixture(spark: SparkSession, sf_dir: str, name: str, mbo: DataFrame | None = None) -> DataFrame:
    """A fixture as a DataFrame; quotes may be derived from messages ``mbo`` that are there already."""
    sql = _SNAP.format(US=_SPARK_US) if name == "snap_all" else ORACLE[name]
    if mbo is not None:
        return spark.sql(sql.replace(f"({MBO}) mbo", "{mbo}"), mbo=mbo)
    if name not in _SOURCE:
        return spark.sql(sql)
    if name in ("mbo_raw", "mbp_raw"):
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        raw = with_index(lines.select(*_LINES, "l_linestatus", "l_returnflag"), _ORDER.split(","), "__place", lines.count())
        raw = spark.sql(RAW.format(seq="(__place + 1)"), lineitem=raw)
        return raw if name == "mbo_raw" else spark.sql(sql.replace(f"({MBO_RAW}) raw", "{raw}"), raw=raw)
    source = _SOURCE[name]
    if source == "lineitem":
        messages = _messages(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        return messages if name == "mbo" else fixture(spark, sf_dir, name, messages)
    return spark.sql(sql.replace(f"FROM {source}", "FROM {given}"), given=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def levels(snaps: DataFrame) -> DataFrame:
    """Ten levels around the best prices b0 and a0: arrays bid_px, bid_sz, ask_px, ask_sz."""
    made = {
        "bid_px": "transform(sequence(0, 9), i -> b0 - i)", "bid_sz": "transform(sequence(0, 9), i -> 100 + (seq*7 + i*13) % 500)",
        "ask_px": "transform(sequence(0, 9), i -> a0 + i)", "ask_sz": "transform(sequence(0, 9), i -> 100 + (seq*11 + i*17) % 500)",
    }
    return snaps.selectExpr("ticker_id", "day_id", "seq", "ts_us", *[f"{sql} AS {name}" for name, sql in made.items()])


def feed_folder(messages: DataFrame, folder: str) -> str:
    """Messages of a table as files of order records, one a group, in ``folder``."""
    fixedrec.write_records(messages, folder, "orders", GROUP, "mbo_{}_{}.bin")
    return folder


def quote_folder(quotes: DataFrame, folder: str) -> str:
    """Quotes of a table as files of quote records, one a group, in ``folder``."""
    fixedrec.write_records(quotes.withColumnRenamed("tseq", "seq"), folder, "truth", GROUP, "truth_{}_{}.bin")
    return folder


def keyed(records: DataFrame) -> DataFrame:
    """Records with the group that their file's name says, instead of the name."""
    part = lambda i: F.regexp_extract("file", r"_(\d+)_(\d+)\.bin$", i).cast("int")
    return records.withColumns({"ticker_id": part(1), "day_id": part(2)}).drop("file")


def arrivals(messages: DataFrame, aside: str, folder: str, rows: int) -> list[Callable[[], None]]:
    """Steps that bring messages into ``folder`` in order, each a file of at most ``rows`` seqs of every group; all are written ``aside`` first, by one job."""
    spark = messages.sparkSession
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    former = spark.conf.get(writers)
    spark.conf.set(writers, "16")  # a task that has few pieces need not sort its rows by piece
    try:
        messages.withColumn("piece", F.floor((F.col("seq") - 1) / rows)).repartition("piece").write.partitionBy("piece").option("parquet.block.size", ROW_GROUP).parquet(aside)
    finally:
        spark.conf.set(writers, former)
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(folder))
    found = [x.getPath() for x in store.globStatus(path(f"{aside}/piece=*/*.parquet"))]

    def bring(file) -> None:
        if not store.rename(file, path(f"{folder}/{file.getParent().getParent().getName()}-{file.getParent().getName()}-{file.getName()}")):
            raise OSError(f"{file} could not be moved")

    return [partial(bring, x) for x in sorted(found, key=lambda x: int(x.getParent().getName().removeprefix("piece=")))]
