"""Names of kinds, levels and flags, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
SEVERITIES = {0: "detail", 1: "info", 2: "warning", 3: "error"}
LEVELS = {1: "direct", 2: "strong", 3: "possible"}
LEVEL_WORDS = {
    **dict.fromkeys(("trace", "debug", "d", "t"), 0),
    **dict.fromkeys(("info", "notice", "i", "g"), 1),
    **dict.fromkeys(("warn", "warning", "w"), 2),
    **dict.fromkeys(("error", "err", "fatal", "critical", "e", "f"), 3),
}
KINDS = {
    "msgid": "message id", "queue": "queue file", "session": "session", "request": "request", "email": "mail address", "account": "account",
    "device": "device", "ipv4": "IPv4 address", "ipv6": "IPv6 address", "endpoint": "address and port", "domain": "domain", "host": "host",
    "url": "URL", "status": "status code", "code": "message code", "pid": "process or thread", "port": "port",
}
UNIQUE_KINDS = ("msgid", "queue", "session", "request")
PIVOT_KINDS = ("msgid", "queue")
LINK_KINDS = ("email", "account", "device", "ipv4", "ipv6", "endpoint")
IP_KINDS = ("ipv4", "ipv6", "endpoint")
WEAK_KINDS = ("status", "code", "pid", "port")
TIME_FLAGS = {
    "exact": "the line states its zone", "source": "the file's zone", "inferred": "the zone all statements agree on", "local": "the default zone",
    "inherited": "the line before", "ambiguous": "the day is uncertain", "invalid": "not a time", "none": "no time",
}
CATEGORIES = {
    "IPv4": "IPv4 address", "IPv6": "IPv6 address", "Domain": "domain", "Local": "mailbox", "Host": "host", "Extra": "own term", "Person": "name", "Company": "company",
    "Phone": "phone number", "Street": "street", "City": "postcode and city", "Register": "register number", "Account": "IBAN",
}
#: Findings of mail and PTR shape are counted by themselves but keep their parts in other categories.
FOUND_LABELS = CATEGORIES | {"Mail": "mail address", "Ptr": "PTR record"}


def label_table(spark: SparkSession, labels: dict) -> DataFrame:
    """``key`` and ``label`` of one of the tables above."""
    return spark.createDataFrame([(str(k), v) for k, v in labels.items()], "key string, label string")
