"""The golden table of URL resolution, and the quirks that are decided."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from crawlspark.functions import urls

TEXT = (Path(__file__).parent.parent / "FIXTURES.md").read_text()


def cell(s):
    return "" if s.strip() in ("—", "(empty)") else s.strip().strip("`")


def rows(pipes):
    return [[cell(x) for x in line.strip("|").split("|")] for line in TEXT.split("\n") if re.match(r"\| \d+ \|", line) and line.count("|") == pipes]


@pytest.fixture(scope="module")
def resolved(spark):
    df = spark.createDataFrame([(int(i[0]), i[1], i[2], i[4] or None) for i in rows(6)], "id int, url string, typ string, base string")
    return {r["id"]: r["u"] for r in df.select("id", urls.resolve(F.col("url"), F.col("typ"), F.col("base")).alias("u")).collect()}


@pytest.mark.parametrize("want", rows(8), ids=lambda r: r[0])
def test_golden(resolved, want):
    u = resolved[int(want[0])]
    assert [u.full_url, u.full_filename, u.valid_filename, str(u.is_rel), str(u.filelike), u.anchor] == want[1:]


def test_canonical_form_is_idempotent(spark):
    df = spark.createDataFrame([(r[1],) for r in rows(8)], "u string")
    once = df.select(urls.full_url(urls.parse(F.col("u"))).alias("u"))
    assert [r.u for r in once.collect()] == [r.u for r in once.select(urls.full_url(urls.parse(F.col("u"))).alias("u")).collect()]


def test_scalars(spark):
    r = spark.range(1).select(
        urls.base_domain(F.lit("a.b.c.org")).alias("bd"),
        urls.relative_filename(F.lit("h/a/b/x.html"), F.lit("h/a/c/y.html")).alias("rf"),
        urls.relative_depth(F.lit("http://a/b/c/"), F.lit("http://a/")).alias("depth"),
        urls.http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")).cast("string").alias("date"),
        urls.image_signature(F.encode(F.lit("GIF89a..."), "UTF-8")).alias("sig"),
        urls.percent_decoded(F.lit("a+b%20c")).alias("pd"),
    ).first()
    assert tuple(r) == ("c.org", "../b/x.html", 2, "1994-11-06 08:49:37", "gif", "a+b c")
