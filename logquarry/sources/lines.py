"""Text lines with their numbers out of whole files."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Fixed values.
ENCODING_ALIASES = {"ansi": "cp1252", "latin1": "iso-8859-1", "unicode": "utf-16", "utf8": "utf-8", "ascii": "ascii"}
SAMPLE_BYTES = 1 << 20


def detected_encoding(content: Column) -> Column:
    """For investigation: a byte order mark decides, then UTF-8 if the first MiB is, else cp1252.

    A character cut at the sample's end doesn't count against UTF-8.
    """
    head = F.substring(content, 1, SAMPLE_BYTES)
    whole = [F.substring(content, F.lit(1), F.greatest(F.lit(0), F.length(head) - k)) for k in range(4)]
    utf8 = F.coalesce(*[F.when(F.is_valid_utf8(w.cast("string")), True) for w in whole], F.lit(False))
    mark = F.hex(F.substring(content, 1, 3))
    return F.when(mark == "EFBBBF", "utf-8-sig").when(mark.startswith("FFFE") | mark.startswith("FEFF"), "utf-16").when(utf8, "utf-8").otherwise("cp1252")


def masking_encoding(content: Column, encoding: str = "auto") -> Column:
    """For masking: a named encoding or alias, a byte order mark, else cp1252."""
    name = (encoding or "auto").lower()
    if name != "auto":
        return F.lit(ENCODING_ALIASES.get(name, name))
    mark = F.hex(F.substring(content, 1, 3))
    return F.when(mark == "EFBBBF", "utf-8-sig").when(mark.startswith("FFFE") | mark.startswith("FEFF"), "utf-16").otherwise("cp1252")


def checking_encoding(content: Column, encoding: str = "auto") -> Column:
    """For the leak check: like ``masking_encoding``, but valid UTF-8 without a mark is UTF-8."""
    found = masking_encoding(content, encoding)
    if (encoding or "auto").lower() != "auto":
        return found
    return F.when((found == "cp1252") & F.is_valid_utf8(content.cast("string")), "utf-8").otherwise(found)


#: Bytes that can't be decoded become these characters of private use, one each; a text's own ones become their bytes.
KEPT_BYTES = 0xF0000
_RESERVED = re.compile(rb"(?:\xf3\xb0[\x80-\x83][\x80-\xbf])+")


def _keep_bytes(error: UnicodeError) -> tuple[str, int]:
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "".join(chr(KEPT_BYTES | b) for b in error.object[error.start : error.end]), error.end


codecs.register_error("keepbytes", _keep_bytes)


def decode(data: bytes, encoding: str) -> str:
    """Bytes as text from which ``encode`` makes the same bytes, whether they can be decoded or not."""
    if encoding.lower().startswith("utf-8") and _RESERVED.search(data):
        out, at = [], 0
        for m in _RESERVED.finditer(data):
            out += [codecs.decode(data[at : m.start()], encoding, "keepbytes"), "".join(chr(KEPT_BYTES | b) for b in m[0])]
            at = m.end()
        return "".join(out) + codecs.decode(data[at:], "utf-8", "keepbytes")
    return codecs.decode(data, encoding, "keepbytes")


def encode(text: str, encoding: str) -> bytes:
    """The bytes of a text; those that ``decode`` kept come back."""
    pieces = _KEPT.split(text)
    if len(pieces) == 1:
        return codecs.encode(text, encoding, "replace")
    plain = encoding.lower().replace("utf-8-sig", "utf-8")
    return b"".join(bytes(ord(c) & 0xFF for c in p) if k % 2 else codecs.encode(p, plain if k else encoding, "replace") for k, p in enumerate(pieces))


_KEPT = re.compile(f"([{chr(KEPT_BYTES)}-{chr(KEPT_BYTES | 0xFF)}]+)")


@F.pandas_udf(StringType())
def decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes as text, see ``decode``."""
    return pd.Series([None if c is None else decode(bytes(c), e) for c, e in zip(content, encoding, strict=True)], dtype=object)


@F.pandas_udf(BinaryType())
def encoded(text: pd.Series, encoding: pd.Series) -> pd.Series:
    """Text as bytes, see ``encode``."""
    return pd.Series([None if t is None else encode(t, e) for t, e in zip(text, encoding, strict=True)], dtype=object)


def lines_of(files: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``source_id``, ``line_no`` (from 1) and ``text`` of each line.

    A line ends at LF, CRLF or a lone CR; nothing follows the last line end.
    """
    parts = F.split(text, r"\r\n|\n|\r")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return files.select(F.col(id_col).alias("source_id"), F.posexplode(parts).alias("pos", "text")).select("source_id", (F.col("pos") + 1).alias("line_no"), "text")


def line_ending(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(\r\n|\n|\r)$", 1)


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Lines of all files below ``path``, whatever their size; ``source_id`` is the file's URI."""
    from logquarry.sources import ranges

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return ranges.read(ranges.with_encoding(files.select("path", F.col("length").alias("size")))).drop("offset")


def context_window(lines: DataFrame, events: DataFrame, before: int = 6, after: int = 6) -> DataFrame:
    """Lines around each event (``event_id``, ``source_id``, ``line_start``, ``line_end``)."""
    wanted = events.select("event_id", "source_id", F.explode(F.sequence(F.greatest(F.col("line_start") - before, F.lit(1)), F.col("line_end") + after)).alias("line_no"))
    return wanted.join(lines, ["source_id", "line_no"]).select("event_id", "source_id", "line_no", "text")


def last_mark(events: DataFrame, marks: DataFrame, order: str = "line_no") -> DataFrame:
    """As-of join: for each event the mark of its source with the greatest ``order`` at or before ``line_start``.

    Both are laid out on one axis and the marks carried forward, so no event
    meets more than one mark.
    """
    from logquarry.functions.running import carry_last

    axis = marks.select("source_id", F.col(order).cast("long").alias("at"), F.struct(*marks.columns).alias("mark"), F.lit(None).cast("long").alias("event_id"))
    asks = events.select("source_id", F.col("line_start").cast("long").alias("at"), F.lit(None).cast(axis.schema["mark"].dataType).alias("mark"), "event_id")
    both = axis.union(asks).withColumn("rank", F.col("at") * 2 + F.col("event_id").isNotNull().cast("long"))
    found = carry_last(both, "source_id", "rank", F.col("mark"), "last")
    return found.where("event_id is not null").select("event_id", "source_id", *[F.col("last")[c].alias(c) for c in marks.columns if c != "source_id"])
