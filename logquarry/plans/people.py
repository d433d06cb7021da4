"""Names learned from mails, names masked in them, and exports that know the accounts and devices of their events.

A customer's mail is rendered from its nation, made a name of one or two words, and market segment: a greeting, a list of managing directors, and a closing with the
name on the line below.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators import exporting, learning, masking
from logquarry.plans import tables
from logquarry.session import settled


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_id`` (the customer), ``line_no`` and ``text``."""
    key, word = F.col("n_nationkey"), F.initcap(F.translate(F.lower("n_name"), "_0123456789", "abcdefghijk"))
    name = F.when(key == 7, "Germany").when(key % 5 == 0, F.concat(word, F.lit(" Land"))).otherwise(word)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(key.alias("c_nationkey"), name.alias("nation"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, "c_nationkey").withColumn("segment", F.initcap(F.lower("c_mktsegment")))
    text = [F.concat(F.lit("Hallo "), "nation", F.lit("!")), F.concat(F.lit("Geschäftsführer: "), "nation", F.lit(" und Otto "), "segment"), F.lit("Mit freundlichen Grüßen"), F.concat(F.lit("Eva "), "segment")]
    return rows.select(F.col("c_custkey").cast("string").alias("source_id"), F.posexplode(F.array(*text)).alias("n", "text")).select("source_id", (F.col("n") + 1).cast("long").alias("line_no"), "text")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each mail says about people."""
    return learning.learn(learning.blocks(mails(spark, sf_dir))).where("category = 'Person'").select("source_id", "part", "value")


def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails without the names that any of them gives away."""
    lines = mails(spark, sf_dir)
    learned = learning.learn(learning.blocks(lines)).select("category", "value").distinct()
    return masking.redacted(masking.segmented(lines, masking.Options(), learned))


def person_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of each person, numbered in the order of customers and of what counts first in a mail."""
    learned = learning.learn(learning.blocks(mails(spark, sf_dir)).withColumn("source_id", F.lpad("source_id", 12, "0")))
    return learning.person_numbers(settled(learned)).select("key", "token")


def export_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events exported with their accounts, devices and addresses known; the first two have no shape."""
    rows = tables.events(spark, sf_dir)
    account, device = F.concat(F.lit("acct"), F.col("user_id").cast("string")), F.concat(F.lit("dev"), (F.col("user_id") % 97).cast("string"))
    told = rows.select("event_id", "source_id", "line_start", "ts_ms", F.concat("event_type", F.lit(" by "), account, F.lit("&id_"), device, F.lit("_ from "), "ip").alias("text"))
    kinds = [F.struct(F.lit(k).alias("kind"), v.alias("value"), F.lit(False).alias("generic")) for k, v in (("account", account), ("device", device), ("ipv4", F.col("ip")))]
    known = rows.select(F.inline(F.array(*kinds))).distinct()
    done = exporting.export(told, F.lit(0), masking.Options(personal=False), identifiers=known)
    return done.lines.where("line_no > 0").select("event_id", "line_no", "masked")


QUERIES = {f.__name__: f for f in (people, mask_names, person_numbers, export_masked)}

# Germany is a word that is no name, so a list that begins with it ends there.
_MAILS = """
m AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN n_nationkey = 7 THEN 'Germany' ELSE upper(n_name[1]) || translate(lower(n_name[2:]), '_0123456789', 'abcdefghijk') || CASE WHEN n_nationkey % 5 = 0 THEN ' Land' ELSE '' END END AS nation,
             upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT *, nation = 'Germany' AS stop, contains(nation, ' ') AS two FROM m),
f AS (SELECT id, source_id, 1 AS rule, 0 AS pos, CASE WHEN two THEN 'full' ELSE 'first' END AS part, nation AS value FROM c WHERE NOT stop
  UNION ALL SELECT id, source_id, 2, 0, 'full', 'Eva ' || segment FROM c
  UNION ALL SELECT id, source_id, 3, 0, 'full', CASE WHEN two THEN nation ELSE 'Otto ' || segment END FROM c WHERE NOT stop
  UNION ALL SELECT id, source_id, 3, 1, 'full', CASE WHEN two THEN 'Otto ' || segment ELSE nation || ' ' || segment END FROM c WHERE NOT stop
  UNION ALL SELECT id, source_id, 3, 2, 'first', nation FROM c WHERE NOT stop AND NOT two),
g AS (SELECT * FROM f UNION ALL SELECT id, source_id, rule, pos + 0.5, 'surname', string_split(value, ' ')[-1] FROM f WHERE part = 'full')"""
ORACLES = {
    "people": f"WITH {_MAILS} SELECT DISTINCT source_id, part, value FROM g",
    "mask_names": f"""WITH {_MAILS}, l AS (
  SELECT source_id, 1 AS line_no, 'Hallo ' || CASE WHEN stop THEN nation ELSE '[NAME-ENTFERNT]' END || '!' AS masked FROM c
  UNION ALL SELECT source_id, 2, 'Geschäftsführer: ' || CASE WHEN stop THEN nation ELSE '[NAME-ENTFERNT]' END || ' und [NAME-ENTFERNT]' FROM c
  UNION ALL SELECT source_id, 3, 'Mit freundlichen Grüßen' FROM c UNION ALL SELECT source_id, 4, '[NAME-ENTFERNT]' FROM c)
SELECT source_id, CAST(line_no AS BIGINT) AS line_no, masked FROM l""",
    # A full name opens a number where it is first seen, a surname shares that of the first full name before it; first names come behind
    # the full names of their mail, and each mail with a first name has a full name that begins with it.
    "person_numbers": f"""WITH {_MAILS},
o AS (SELECT value, part, min(row(id, CASE part WHEN 'first' THEN 2 ELSE 0 END, rule, pos)) AS p FROM g GROUP BY ALL),
n AS (SELECT value, row_number() OVER (ORDER BY p) AS n FROM o WHERE part = 'full'),
s AS (SELECT o.value, o.part, min_by(b.n, b.first_seen) AS n FROM o JOIN (
        SELECT f.id, f.rule, f.pos, f.value, n.n, row(f.rule, f.pos) AS first_seen FROM f JOIN n ON f.value = n.value WHERE f.part = 'full') b
      ON b.id = o.p[1] AND CASE o.part WHEN 'first' THEN starts_with(b.value, o.value || ' ') ELSE ends_with(b.value, ' ' || o.value) END
      WHERE o.part <> 'full' GROUP BY o.value, o.part)
SELECT value AS key, '[PERSON-' || printf('%03d', n) || ']' AS token FROM n
UNION ALL SELECT value, CASE part WHEN 'surname' THEN '[NAME-' ELSE '[VORNAME-' END || printf('%03d', n) || ']' FROM s""",
    "export_masked": f"""WITH {tables.EVENTS_SQL},
l AS (SELECT *, row_number() OVER (ORDER BY ts_ms, event_type, event_id) AS line_no, 'acct' || user_id AS a, 'dev' || (user_id % 97) AS d FROM ev),
k AS (SELECT 'E' AS c, a AS v, line_no, 1 AS p FROM l UNION ALL SELECT 'E', d, line_no, 2 FROM l UNION ALL SELECT 'I', ip, line_no, 3 FROM l),
f AS (SELECT c, v, min(row(line_no, p)) AS m FROM k GROUP BY ALL),
n AS (SELECT c, v, printf('%03d', row_number() OVER (PARTITION BY c ORDER BY m)) AS n FROM f),
q AS (SELECT event_type, row_number() OVER (ORDER BY min(ts_ms), event_type) AS q FROM ev GROUP BY event_type)
SELECT event_id, line_no, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S.') || printf('%03d', ts_ms % 1000) || ' +00:00 Q' || q || ': ' || l.event_type
       || ' by [WERT-' || x.n || ']&id_[WERT-' || y.n || ']_ from [IPv4-' || z.n || ']' AS masked
FROM l JOIN q ON l.event_type = q.event_type JOIN n x ON x.c = 'E' AND x.v = a JOIN n y ON y.c = 'E' AND y.v = d JOIN n z ON z.c = 'I' AND z.v = ip""",
}
