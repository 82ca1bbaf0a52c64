"""SQL scripts as a table: from text, files, a folder or an archive; and a small corpus of our own."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "script string, sql_text string"


def from_text(spark: SparkSession, scripts: dict[str, str]) -> DataFrame:
    """Scripts given by name; blank text is refused."""
    blank = sorted(name for name, text in scripts.items() if not text or not text.strip())
    if blank:
        raise ValueError(f"empty scripts: {', '.join(blank)}")
    return spark.createDataFrame(sorted(scripts.items()), SCHEMA)


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """All .sql, .ddl and .schema files below a folder of any file system that Spark reads; bytes that are not UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace("path", r"^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.filter(F.lower("path").rlike(r"\.(sql|ddl|schema)$")).select(name.alias("script"), F.make_valid_utf8(F.col("content").cast("string")).alias("sql_text"))


def from_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Two files at least, named by their base names; bytes that are not UTF-8 become U+FFFD. Names that repeat are an error."""
    names = [path.rstrip("/").rsplit("/", 1)[-1] for path in paths]
    if len(paths) < 2 or len({*names}) < len(names):
        raise ValueError("two files at least, of different names")
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("script"), F.make_valid_utf8(F.col("content").cast("string")).alias("sql_text"))


def from_archive(spark: SparkSession, path: str) -> DataFrame:
    """Scripts of zip files (a file or a folder of them, on any file system that Spark reads), unpacked on the executors; folders, __MACOSX and names that climb out of the archive are left."""
    from lodestream.sources.package import ship

    ship(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for info in archive.infolist():
                        parts = PurePosixPath(info.filename).parts
                        if info.is_dir() or "__MACOSX" in parts or ".." in parts or info.filename.startswith("/"):
                            continue
                        if info.filename.lower().endswith((".sql", ".ddl", ".schema")):
                            yield pa.record_batch([pa.array([info.filename]), pa.array([archive.read(info).decode("utf-8", "replace")])], names=["script", "sql_text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, SCHEMA)


def tree(scripts: DataFrame) -> DataFrame:
    """(path, name, kind, depth, place): the folders and files of scripts (script), in the order in which a tree shows them: in each folder its folders first, then files, each by name without case."""
    parts = F.split("script", "/")
    files = scripts.select(F.col("script").alias("path"), F.lit("file").alias("kind"))
    folders = scripts.filter("script LIKE '%/%'").select(parts.alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.array_join(F.slice("p", F.lit(1), k), "/"))).alias("path")).distinct().withColumn("kind", F.lit("folder"))
    rows = files.union(folders.select("path", "kind")).withColumn("p", F.split("path", "/"))
    # a file's last part sorts after the folders beside it
    key = F.transform("p", lambda x, k: F.concat(F.when((k == F.size("p") - 1) & (F.col("kind") == "file"), "1").otherwise("0"), F.lower(x)))
    from pyspark.sql import Window

    return rows.select("path", F.element_at("p", -1).alias("name"), "kind", (F.size("p") - 1).alias("depth"), F.row_number().over(Window.orderBy(key, "path")).alias("place"))


def template_variables(scripts: DataFrame) -> DataFrame:
    """(script, variable, n, warning): names in ${...} that a script leaves open, with how often; each is a warning, as its value is not known."""
    found = scripts.select("script", F.explode(F.regexp_extract_all("sql_text", F.lit(r"\$\{([^}]*)\}"), F.lit(1))).alias("variable"))
    return found.groupBy("script", "variable").agg(F.count("*").alias("n")).withColumn("warning", F.format_string("template variable %s is not replaced", "variable"))


def output_columns(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, data_type, column_name, explanation) of a CSV with or without a header; rows of fewer than three cells are left out, blanks trimmed."""
    names = ["table_name", "data_type", "column_name", "explanation"]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path).select(*(F.trim(n).alias(n) for n in names))
    header = F.lower("table_name") == "table_name"
    return rows.filter(F.col("column_name").isNotNull() & ~header)


#: A corpus over the star tables: a chain of steps, and one script for each kind of statement.
CORPUS = {
    "a_load.sql": """-- stage orders of the last years
INSERT INTO stg_orders (order_id, cust_id, amount, day, status)
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, CAST(o.o_orderdate AS DATE), o.o_orderstatus
FROM raw.orders o
WHERE o.o_orderstatus <> 'P' AND o.o_totalprice > 0;
""",
    "b_customers.sql": """INSERT INTO stg_customers (cust_id, name, segment, nation)
SELECT c.c_custkey, UPPER(c.c_name), c.c_mktsegment, n.n_name
FROM raw.customer c
JOIN raw.nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN blocked b ON b.cust_id = c.c_custkey
WHERE b.cust_id IS NULL;
""",
    "c_join.sql": """WITH totals AS (
  SELECT cust_id, SUM(amount) AS total, COUNT(*) AS n
  FROM stg_orders
  GROUP BY cust_id
  HAVING COUNT(*) > 1
), ranked AS (
  SELECT t.cust_id, t.total, RANK() OVER (ORDER BY t.total DESC) AS place
  FROM totals t
)
INSERT INTO sales (cust_id, name, segment, total, place, band)
SELECT c.cust_id, c.name, c.segment, COALESCE(r.total, 0) AS total, r.place,
       CASE WHEN r.total > 100000 THEN 'high' ELSE 'low' END AS band
FROM stg_customers c
LEFT JOIN ranked r ON r.cust_id = c.cust_id;
""",
    "d_summary.sql": """INSERT OVERWRITE TABLE summary PARTITION (day_part = 'all')
SELECT segment, AVG(total) AS mean_total, MAX(place) AS worst
FROM sales
WHERE band = 'high' AND cust_id IN (SELECT k.cust_id FROM kept k WHERE k.ok = 1)
GROUP BY segment;
UPDATE summary SET mean_total = mean_total * 1.1 WHERE segment = 'BUILDING';
""",
    "e_report.sql": """SELECT s.segment, s.mean_total, (SELECT MAX(x.mean_total) FROM summary x) AS best
FROM summary s
WHERE EXISTS (SELECT 1 FROM sales q WHERE q.segment = s.segment AND q.total > 10)
ORDER BY s.mean_total DESC
LIMIT 5;
""",
    "f_merge.sql": """MERGE INTO sales t USING (SELECT cust_id, amount FROM stg_orders WHERE status = 'F') u
ON t.cust_id = u.cust_id
WHEN MATCHED THEN UPDATE SET t.total = t.total + u.amount
WHEN NOT MATCHED THEN INSERT (cust_id, total) VALUES (u.cust_id, u.amount);
DELETE FROM stg_orders WHERE status = 'X';
""",
    "g_union.sql": """CREATE TABLE people AS
SELECT cust_id AS id, name FROM stg_customers
UNION ALL
SELECT s_suppkey, s_name FROM raw.supplier
UNION ALL
SELECT v.id, v.name FROM (VALUES (0, 'none')) v(id, name);
CREATE VIEW people_view AS SELECT p.id, LENGTH(p.name) AS n FROM people p;
""",
    "h_hive.sql": """SET hive.exec.dynamic.partition = true;
FROM stg_orders s
INSERT INTO TABLE open_orders SELECT s.order_id, s.amount WHERE s.status = 'O'
INSERT INTO TABLE done_orders SELECT s.order_id, s.day WHERE s.status = 'F';
""",
    "i_tables.ddl": """CREATE TABLE stg_orders (order_id BIGINT, cust_id BIGINT, amount DECIMAL(18,2), day DATE, status CHAR(1));
CREATE TABLE stg_customers (cust_id BIGINT, name VARCHAR(40), segment VARCHAR(10), nation VARCHAR(25), PRIMARY KEY (cust_id));
CREATE TABLE kept (cust_id BIGINT, ok INT);
""",
    "j_ambiguous.sql": """SELECT name, amount, status, cust_id, LEVEL
FROM stg_orders, stg_customers
WHERE segment = 'AUTO' AND mystery = 1;
""",
    "k_window.sql": """SELECT o.cust_id, ROW_NUMBER() OVER (PARTITION BY o.cust_id ORDER BY o.day) AS k,
  o.amount - LAG(o.amount, 1, 0) OVER (PARTITION BY o.cust_id ORDER BY o.day) AS step
FROM stg_orders o
QUALIFY k <= 3;
""",
    "l_broken.sql": """SELECT FROM WHERE;
INSERT INTO logs (msg) VALUES ('kept');
WITH x (SELECT 1) SELECT 2;
""",
}


def corpus(spark: SparkSession) -> DataFrame:
    return from_text(spark, CORPUS)
