"""Collecting: inventory, selection, duplicates, names, manifest, copies; names of files; lines of files."""

from pyspark.sql import functions as F

from logquarry.functions import identifiers as ids
from logquarry.functions import names
from logquarry.operators import collecting
from logquarry.plans import tables
from logquarry.sources import lines, rendered


def _files(spark, sf_dir):
    files = rendered.documents_as_files(spark, sf_dir)
    return files.select("file_id", "name", "content", "size", names.log_type(F.col("name")).alias("log_type"), names.date_from_name(F.col("name")).alias("day"), collecting.content_hash(F.col("content")).alias("sha256"))


def file_matrix(spark, sf_dir):
    return collecting.matrix(_files(spark, sf_dir)).select("log_type", F.col("day").cast("string").alias("day"), "all_types", "all_days", "files", "bytes")


def collect_select(spark, sf_dir):
    return collecting.selected(_files(spark, sf_dir), ["2024-01-03", "2024-01-17"], ["src1*", "SRC2"]).select("file_id", "log_type", F.col("day").cast("string").alias("day"))


def collect_pairs(spark, sf_dir):
    pairs = spark.createDataFrame([("src3", "2024-01-04"), ("src4", "2024-01-05"), ("src5", "2024-01-20")], "log_type string, day string").withColumn("day", F.col("day").cast("date"))
    return collecting.selected(_files(spark, sf_dir), pairs=pairs).select("file_id", "log_type", F.col("day").cast("string").alias("day"))


def collect_dedupe(spark, sf_dir):
    return collecting.without_duplicates(_files(spark, sf_dir), "file_id").select("file_id", "first", "duplicate")


def collect_names(spark, sf_dir):
    return collecting.output_names(_files(spark, sf_dir), "file_id").select("file_id", "output_name")


def manifest(spark, sf_dir):
    none = F.lit(None).cast("string")
    files = _files(spark, sf_dir).select("file_id", "log_type", "day", "name", "size", "sha256", F.lit("file").alias("source_kind"), F.col("name").alias("source_name"), none.alias("entry"), none.alias("error"))
    return collecting.manifest(files, "file_id")


def growing_copies(spark, sf_dir):
    """Every file, and its first 600 and 900 bytes where it is longer."""
    files = rendered.documents_as_files(spark, sf_dir).select("file_id", F.encode("content", "utf-8").alias("content"), "size")
    cut = lambda n, k: files.where(F.col("size") > n).select((F.col("file_id") + k * 1_000_000_000).alias("file_id"), F.substring("content", 1, n).alias("content"), F.lit(n).cast("long").alias("size"))
    return collecting.growing_copies(files.union(cut(600, 1)).union(cut(900, 2)))


def file_names(spark, sf_dir):
    docs = rendered.documents_as_files(spark, sf_dir)
    shapes = F.array(F.col("name"), F.regexp_replace("name", r"-(\d{4})-(\d\d)-(\d\d)", "_$1$2$3 part"), F.concat(F.lit("logs\\old/"), F.col("name")), F.lit("2024-02-31.log"), F.lit("plain.TXT"))
    rows = docs.select("file_id", F.posexplode(shapes).alias("shape", "n"))
    return rows.select("file_id", "shape", names.date_from_name(F.col("n")).cast("string").alias("day"), names.log_type(F.col("n")).alias("log_type"), names.source_kind(F.col("n")).alias("kind"), names.extension(F.col("n")).alias("suffix"))


def document_lines(spark, sf_dir):
    rows = tables.document_lines(spark, sf_dir)
    return rows.groupBy("source_id").agg(F.max("line_no").cast("long").alias("lines"), F.sum(F.length("text")).alias("chars"))


def context_window(spark, sf_dir):
    rows = tables.document_lines(spark, sf_dir)
    asked = rows.where("line_no % 17 = 0").select(F.concat_ws(":", "source_id", "line_no").alias("event_id"), "source_id", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))
    return lines.context_window(rows, asked).groupBy("event_id").agg(F.count("*").alias("n"), F.min("line_no").cast("long").alias("first"), F.max("line_no").cast("long").alias("last"))


def asof_mark(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    marks = rows.where("turn % 4 = 0").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("line_no"), F.length("text").alias("size"))
    asked = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("source_id"), F.col("turn").alias("line_start"))
    return lines.last_mark(asked, marks).select("event_id", "line_no", "size")


def address_checks(spark, sf_dir):
    """Private nets and reversed names of addresses made from customer keys."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    key = F.col("c_custkey")
    first = F.element_at(F.array(*map(F.lit, (10, 172, 192, 169, 127, 8))), (key % 6 + 1).cast("int"))
    ip = F.concat_ws(".", first.cast("string"), (key % 256).cast("string"), F.floor(key / 256).cast("string"), (key % 9).cast("string"))
    ptr = F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit(".in-addr.arpa"))
    return rows.select("c_custkey", ids.is_private_ipv4(ip).alias("private"), ids.reversed_ptr(ptr).alias("back"))


def iban_phone_checks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    body = F.lpad(F.col("s_suppkey").cast("string"), 18, "3")
    iban = F.concat(F.lit("DE"), F.lpad((F.col("s_suppkey") % 97 + 2).cast("string"), 2, "0"), body)
    phone = F.concat(F.lit("+49 "), F.rpad(F.col("s_suppkey").cast("string"), (F.col("s_suppkey") % 14 + 1).cast("int"), F.lit("7")))
    return rows.select("s_suppkey", ids.mod97(iban).alias("iban_ok"), ids.phone_digits_ok(phone).alias("phone_ok"))


QUERIES = {f.__name__: f for f in (file_matrix, collect_select, collect_pairs, collect_dedupe, collect_names, manifest, growing_copies, file_names, document_lines, context_window, asof_mark, address_checks, iban_phone_checks)}

_F = "f AS (SELECT doc_id AS file_id, source || '-2024-01-' || printf('%02d', 1 + doc_id % 28) || '.log' AS name, source AS log_type, '2024-01-' || printf('%02d', 1 + doc_id % 28) AS day, octet_length(encode(text)) AS size, upper(sha256(text)) AS sha256 FROM documents)"
ORACLES = {
    "file_matrix": f"WITH {_F} SELECT log_type, day, GROUPING(log_type) AS all_types, GROUPING(day) AS all_days, COUNT(*) AS files, CAST(SUM(size) AS BIGINT) AS bytes FROM f GROUP BY CUBE (log_type, day)",
    "collect_select": f"WITH {_F} SELECT file_id, log_type, day FROM f WHERE day IN ('2024-01-03', '2024-01-17') AND (log_type LIKE 'src1%' OR log_type = 'src2')",
    "collect_pairs": f"WITH {_F} SELECT file_id, log_type, day FROM f WHERE (log_type, day) IN (('src3', '2024-01-04'), ('src4', '2024-01-05'), ('src5', '2024-01-20'))",
    "collect_dedupe": f'WITH {_F} SELECT file_id, min(file_id) OVER (PARTITION BY sha256) AS "first", file_id <> min(file_id) OVER (PARTITION BY sha256) AS duplicate FROM f',
    "collect_names": f"WITH {_F}, n AS (SELECT file_id, name, row_number() OVER (PARTITION BY name ORDER BY file_id) AS k FROM f) SELECT file_id, CASE WHEN k = 1 THEN name ELSE replace(name, '.log', '__' || k || '.log') END AS output_name FROM n",
    "manifest": f"""WITH {_F}, d AS (SELECT *, min(file_id) OVER (PARTITION BY sha256) AS first FROM f),
n AS (SELECT file_id AS first, name, row_number() OVER (PARTITION BY name ORDER BY file_id) AS k FROM d WHERE file_id = first),
o AS (SELECT first, CASE WHEN k = 1 THEN name ELSE replace(name, '.log', '__' || k || '.log') END AS out FROM n)
SELECT CASE WHEN file_id = d.first THEN 'Selected' ELSE 'Duplicate' END AS "Status", day AS "Date", log_type AS "LogType", out AS "OutputName", name AS "OriginalName", 'file' AS "SourceKind", name AS "SourceName", '' AS "ArchiveEntry",
CAST(size AS VARCHAR) AS "Bytes", sha256 AS "SHA256", '' AS "Error" FROM d JOIN o ON d.first = o.first""",
    "growing_copies": """WITH f AS (SELECT doc_id AS file_id, hex(encode(text)) AS h FROM documents),
e AS (SELECT * FROM f UNION ALL SELECT file_id + 1000000000, left(h, 1200) FROM f WHERE length(h) > 1200 UNION ALL SELECT file_id + 2000000000, left(h, 1800) FROM f WHERE length(h) > 1800),
k AS (SELECT *, left(h, 1024) AS key, CAST(length(h) AS HUGEINT) AS n FROM e WHERE length(h) >= 1024)
SELECT s.file_id, CAST(max(l.n * 100000000000 + l.file_id) % 100000000000 AS BIGINT) AS longest FROM k s JOIN k l ON s.key = l.key AND l.n > s.n AND starts_with(l.h, s.h) GROUP BY s.file_id""",
    "file_names": f"""WITH {_F} SELECT file_id, 0 AS shape, day, log_type, log_type AS kind, '.log' AS suffix FROM f
UNION ALL SELECT file_id, 1, day, log_type, log_type || ' part', '.log' FROM f UNION ALL SELECT file_id, 2, day, log_type, log_type, '.log' FROM f
UNION ALL SELECT file_id, 3, NULL, 'Unspecified', 'Log', '.log' FROM f UNION ALL SELECT file_id, 4, NULL, 'plain', 'plain', '.txt' FROM f""",
    "document_lines": f"WITH {tables.LINES_SQL} SELECT source_id, max(line_no) AS lines, CAST(SUM(length(text)) AS BIGINT) AS chars FROM dl GROUP BY 1",
    "context_window": f"""WITH {tables.LINES_SQL}, a AS (SELECT source_id, line_no AS mid FROM dl WHERE line_no % 17 = 0)
SELECT a.source_id || ':' || mid AS event_id, COUNT(*) AS n, min(line_no) AS "first", max(line_no) AS "last" FROM a JOIN dl ON a.source_id = dl.source_id AND line_no BETWEEN mid - 6 AND mid + 6 GROUP BY 1""",
    "asof_mark": """WITH m AS (SELECT conv_id, turn AS line_no, length(text) AS size FROM conversations WHERE turn % 4 = 0)
SELECT c.conv_id * 1000 + c.turn AS event_id, m.line_no, m.size FROM conversations c ASOF JOIN m ON c.conv_id = m.conv_id AND c.turn >= m.line_no""",
    "address_checks": """WITH k AS (SELECT c_custkey, [10, 172, 192, 169, 127, 8][c_custkey % 6 + 1] AS a, c_custkey % 256 AS b, c_custkey // 256 AS c, c_custkey % 9 AS d FROM customer)
SELECT c_custkey, a IN (10, 127) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) AS private, a || '.' || b || '.' || c || '.' || d AS back FROM k""",
    "iban_phone_checks": """WITH k AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 18, '3') AS body, lpad(CAST(s_suppkey % 97 + 2 AS VARCHAR), 2, '0') AS chk FROM supplier)
SELECT s_suppkey, CAST(body || '1314' || chk AS HUGEINT) % 97 = 1 AS iban_ok, s_suppkey % 14 + 1 + 2 BETWEEN 7 AND 15 AS phone_ok FROM k""",
}
