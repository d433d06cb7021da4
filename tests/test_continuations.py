"""Lines without a stamp: the path by runs gives what windows over all lines and a plain loop give."""

import random

import pytest
from pyspark.sql import functions as F

from logquarry.operators import formats

STAMP = "2026-10-21 15:40:{:02d} | INFO | x{}"


def plain(rows):
    """(line_start, line_end, text, second, flag) of a source's (line_no, text) in order."""
    out, clock = [], None
    for n, text in rows:
        if not text.strip():
            continue
        if text.startswith("2026"):
            clock = int(text[17:19])
            out.append([n, n, text, clock, "local"])
        elif text[0].isspace() and out:
            out[-1][1], out[-1][2] = n, out[-1][2] + "\n" + text
        else:
            out.append([n, n, text, clock, "none" if clock is None else "inherited"])
    return [tuple(x) for x in out]


def made(rng, n, start, gaps):
    number, rows = start, []
    for k in range(n):
        rows.append((number, rng.choice([STAMP.format(rng.randrange(60), k), "bare %d" % k, "  more %d" % k, "\tmore", "", "  "])))
        number += rng.choice([1, 1, 3]) if gaps else 1
    return rows


@pytest.mark.parametrize("small", [0, 100_000])
def test_runs_are_like_a_loop(spark, monkeypatch, small):
    monkeypatch.setattr(formats, "SMALL_ROWS", small)
    rng = random.Random(small)
    texts = {f"s{k}": made(rng, rng.randint(1, 60), rng.choice([1, 2]), k % 4 == 3) for k in range(16)}
    texts |= {"indented": [(1, "  a"), (2, " b"), (3, "c"), (4, " d")], "blank": [(1, ""), (2, " ")], "stamped": [(k, STAMP.format(k, k)) for k in range(1, 9)]}
    lines = spark.createDataFrame([(s, n, t) for s, rows in texts.items() for n, t in rows], "source_id string, line_no long, text string").repartition(3)
    got = formats.parse(lines, "pipe").select("source_id", "line_start", "line_end", "text", F.second("wall"), "ts_flag").collect()
    for source, rows in texts.items():
        assert sorted(tuple(r)[1:] for r in got if r["source_id"] == source) == plain(rows), source


def test_stamped_lines_need_no_window(spark):
    """A few lines without a stamp are brought to the stamped ones."""
    lines = spark.range(1, 2000).select(F.lit("s").alias("source_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 100 == 0, "  more").otherwise(F.format_string("2026-10-21 15:40:00 | INFO | x%d", "id")).alias("text"))
    found = formats.parse(lines, "pipe")
    assert found.count() == 1999 - 19
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("BroadcastHashJoin") >= 2
