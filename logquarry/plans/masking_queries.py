"""Masking, restoring, redacting and checking the documents' lines."""

from pyspark.sql import functions as F

from logquarry.operators import learning, masking
from logquarry.plans import tables
from logquarry.session import settled

TECHNICAL = masking.Options(personal=False)


def _found(spark, sf_dir, options=TECHNICAL):
    return settled(masking.segmented(tables.document_lines(spark, sf_dir), options))


def _kind(category):
    def query(spark, sf_dir):
        found = _found(spark, sf_dir).select("source_id", F.explode("segments").alias("s")).where(F.col("s.category") == category)
        return found.groupBy("source_id", F.lower("s.original").alias("value")).agg(F.count("*").alias("n"))

    return query


def mask_stats(spark, sf_dir):
    return masking.stats(_found(spark, sf_dir))


def dictionary(spark, sf_dir):
    """Every key, numbered by category in the order of first sight."""
    return masking.dictionary(masking.keys(_found(spark, sf_dir))).select("category", "key", "token")


def mask_redact(spark, sf_dir):
    """Lines with findings of any kind, redacted."""
    found = _found(spark, sf_dir).where(F.exists("segments", lambda s: s["category"].isNotNull()))
    return masking.redacted(found).select("source_id", "line_no", F.sha2("masked", 256).alias("masked_sha256"))


def restore_roundtrip(spark, sf_dir):
    """Masked with all kinds and learned names, then restored: every line as it was."""
    lines = tables.document_lines(spark, sf_dir)
    findings = settled(learning.learn(learning.blocks(lines)))
    found = settled(masking.segmented(lines, masking.Options(), findings.select("category", "value").distinct()))
    entries = settled(learning.dictionary(masking.keys(found), findings))
    back = masking.restored(masking.masked(found, entries), entries, settled(masking.spellings(found, entries)))
    return back.select("source_id", "line_no", F.sha2("restored", 256).alias("text_sha256"), F.col("unresolved").cast("long").alias("unresolved"))


def secret_hints(spark, sf_dir):
    return masking.leaks(tables.document_lines(spark, sf_dir), TECHNICAL).where(F.col("label").isin(*masking.SECRETS))


def leak_counts(spark, sf_dir):
    found = _found(spark, sf_dir)
    entries = masking.dictionary(masking.keys(found))
    masked = masking.masked(found, entries).withColumnRenamed("masked", "text")
    return masking.leaks(masked, TECHNICAL)


QUERIES = {"mask_ipv4": _kind("IPv4"), "mask_mail": _kind("Mail")} | {f.__name__: f for f in (mask_stats, dictionary, mask_redact, restore_roundtrip, secret_hints, leak_counts)}

# The tables' addresses are plain, so that these simple shapes find the same ones.
_MAIL = tables.MAIL_SQL
_IP = tables.IP_SQL
_L = tables.LINES_SQL
_SECRET = r"(?i)\b(?:password|passwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key)\b"
_KEY = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
ORACLES = {
    "mask_ipv4": f"WITH {_L}, f AS (SELECT source_id, unnest(regexp_extract_all(text, '{_IP}')) AS value FROM dl) SELECT source_id, value, COUNT(*) AS n FROM f GROUP BY ALL",
    "mask_mail": f"WITH {_L}, f AS (SELECT source_id, lower(unnest(regexp_extract_all(text, '{_MAIL}'))) AS value FROM dl) SELECT source_id, value, COUNT(*) AS n FROM f GROUP BY ALL",
    "mask_stats": f"WITH {_L} SELECT 'IPv4' AS category, CAST(SUM(len(regexp_extract_all(text, '{_IP}'))) AS BIGINT) AS n FROM dl UNION ALL SELECT 'Mail', CAST(SUM(len(regexp_extract_all(text, '{_MAIL}'))) AS BIGINT) FROM dl",
    "dictionary": f"""WITH {_L}, i AS (SELECT source_id, line_no, unnest(regexp_extract_all(text, '{_IP}')) AS key, generate_subscripts(regexp_extract_all(text, '{_IP}'), 1) AS place FROM dl),
m AS (SELECT source_id, line_no, unnest(regexp_extract_all(text, '{_MAIL}')) AS mail, generate_subscripts(regexp_extract_all(text, '{_MAIL}'), 1) AS place FROM dl),
d AS (SELECT source_id, line_no, place, split_part(mail, '@', 1) AS box, string_split(lower(split_part(mail, '@', 2)), '.') AS labels FROM m),
h AS (SELECT source_id, line_no, place, unnest(labels[:-3]) AS host, generate_subscripts(labels[:-3], 1) AS sub FROM d),
f AS (SELECT 'IPv4' AS category, source_id, line_no, place, 0 AS sub, key FROM i
  UNION ALL SELECT 'Local', source_id, line_no, place, 0, box || '@' || array_to_string(labels, '.') FROM d
  UNION ALL SELECT 'Domain', source_id, line_no, place, 0, array_to_string(labels[-2:], '.') FROM d
  UNION ALL SELECT 'Host', source_id, line_no, place, sub, host FROM h),
g AS (SELECT category, key, min(row(source_id, line_no, place, sub)) AS p FROM f GROUP BY ALL),
n AS (SELECT category, key, printf('%03d', row_number() OVER (PARTITION BY category ORDER BY p)) AS n FROM g)
SELECT category, key, CASE category WHEN 'IPv4' THEN '[IPv4-' || n || ']' WHEN 'Local' THEN 'user' || n WHEN 'Domain' THEN 'kunde' || n || '.tld' ELSE 'host' || n END AS token FROM n""",
    "mask_redact": f"""WITH {_L}, t AS (SELECT *, regexp_replace(regexp_replace(text, '{_MAIL}', '[MAIL-ENTFERNT]', 'g'), '{_IP}', '[IP-ENTFERNT]', 'g') AS m FROM dl)
SELECT source_id, line_no, sha256(m) AS masked_sha256 FROM t WHERE m <> text""",
    "restore_roundtrip": f"WITH {_L} SELECT source_id, line_no, sha256(text) AS text_sha256, CAST(0 AS BIGINT) AS unresolved FROM dl",
    "secret_hints": f"WITH {_L}, s AS (SELECT 'Secret word' AS label, CAST(SUM(len(regexp_extract_all(text, '{_SECRET}'))) AS BIGINT) AS n FROM dl UNION ALL SELECT 'Private key', CAST(SUM(len(regexp_extract_all(text, '{_KEY}'))) AS BIGINT) FROM dl) SELECT * FROM s WHERE n > 0",
    "leak_counts": f"WITH {_L}, s AS (SELECT 'Secret word' AS label, CAST(SUM(len(regexp_extract_all(text, '{_SECRET}'))) AS BIGINT) AS n FROM dl UNION ALL SELECT 'Private key', CAST(SUM(len(regexp_extract_all(text, '{_KEY}'))) AS BIGINT) FROM dl) SELECT * FROM s WHERE n > 0",
}
