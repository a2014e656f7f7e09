"""Column functions over strings, dates, numbers, arrays and JSON. All but match_text() are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref|igshid|mc_cid|mc_eid)$"


def bare_ticker(c: Column) -> Column:
    """A ticker without exchange suffix and leading letter: A005930.KS is 005930."""
    return F.regexp_replace(F.regexp_replace(c, r"\.[A-Z]+$", ""), r"^[A-Z](?=[0-9]{6}$)", "")


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, trailing slash or tracking parameters; parameters in order."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(c, r"://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(c, r"://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).rlike(TRACKING)))
    return F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def stable_id(prefix: str, *cols: Column) -> Column:
    """prefix and the first 24 hex digits of a hash of the parts; a null part differs from an empty one."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24))


def article_id(url: Column, title: Column, published: Column) -> Column:
    """Hash of the normalised url; without one, of title and time."""
    n = normalize_url(url)
    return F.sha2(F.when(url.rlike("://"), n).otherwise(F.concat_ws("|", title, published.cast("string"))), 256)


def content_hash(*cols: Column) -> Column:
    """Hash of normalised contents; null, empty and the word null differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.trim(c.cast("string"))), F.lit("~")) for c in cols]), 256)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def match_text(c: Column) -> Column:
    """Unicode NFKC, with white space collapsed. Texts of ASCII alone skip the UDF's work but not its transfer."""
    return F.trim(F.regexp_replace(_nfkc(c), r"\s+", " "))


def local_date(ts: Column, tz: str) -> Column:
    """The date in a time zone of an instant stored in UTC."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def period_key(year: Column, code: Column) -> Column:
    """Reports' codes as periods: 11011 full year, 11012 half, 11013 first and 11014 third quarter."""
    return F.concat(year.cast("string"), F.when(code == "11011", "FY").when(code == "11012", "H1").when(code == "11013", "Q1").when(code == "11014", "Q3"))


def fiscal_available_from(year: Column, month: int) -> Column:
    """The first of a month of the year after the fiscal one."""
    return F.make_date(year + 1, F.lit(month), F.lit(1))


def log_return(a: Column, b: Column) -> Column:
    """ln(b / a); null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.log(b / a))


def pct_of_log(c: Column) -> Column:
    return F.expm1(c)


def ratio(a: Column, b: Column) -> Column:
    """a over b as floating point has it: infinite for b of 0, NaN for 0 over 0."""
    return F.when(b == 0, F.when(a == 0, float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))).otherwise(a / F.when(b != 0, b))


def log_ratio(a: Column, b: Column) -> Column:
    """Log of a over b as floating point has it: infinite if one of them is 0, NaN for 0 over 0; null for a negative ratio."""
    return F.when((a == 0) & (b != 0), float("-inf")).otherwise(F.log(ratio(a, b)))


def revision(latest: Column, prior: Column) -> Column:
    """Log change where both are positive, else the change over the prior's size; null for a prior of zero."""
    return F.when((latest > 0) & (prior > 0), F.log(latest / prior)).when(prior != 0, (latest - prior) / F.abs(prior))


def mentions_union(*cols: Column) -> Column:
    """JSON arrays of {market, ticker} as one, without repeats, sorted."""
    kind = "array<struct<market: string, ticker: string>>"
    arrays = [F.coalesce(F.from_json(c, kind), F.expr(f"cast(array() AS {kind})")) for c in cols]
    return F.to_json(F.array_sort(F.array_distinct(F.concat(*arrays))))
