"""Line deduplication by site-relative frequency.

For every host, the pages that contain a line are divided by the host's pages; a line beyond the boilerplate ratio goes.
Lines are counted by 128 bits of hash with partial sums, so a host with a third of all pages is no hot key, and no text is
shuffled. The boilerplate lines of a host are few by definition (at most lines a page / ratio); they return to the pages as
one array a host, broadcast while its size is small and joined by salted host otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut

#: Share of a host's pages from which on a line is boilerplate (exclusive), and the least number of pages with it.
RATIO, LEAST = 0.1, 5
#: The pipeline's share for lines of LONG characters or more, as its hosts mix languages; short natural lines keep RATIO.
LONG_RATIO, LONG = 0.01, 15
#: Salts a host's pages are dealt by where its boilerplate is joined instead of broadcast.
SALTS = 64


def _key(line: str) -> str:
    return f"struct(xxhash64({line}) as a, xxhash64(1, {line}) as b)"


def boilerplate(documents: DataFrame, host: Column, text: Column, *, ratio: float = RATIO, least: int = LEAST, long_ratio: float | None = None) -> DataFrame:
    """(host, lines): the keys of the lines that more than `ratio` of a host's distinct pages, and at least `least`, contain;
    for lines of LONG characters or more, `long_ratio` stands in place of `ratio` if it is given."""
    pages = documents.select(host.alias("host"), text.alias("text")).where("text is not null").select(
        "host", F.expr("struct(xxhash64(text) as a, xxhash64(1, text) as b)").alias("page"), F.expr("array_distinct(filter(transform(split(text, '\\n'), x -> trim(x)), x -> x <> ''))").alias("lines")
    )
    share = f"{ratio}D" if long_ratio is None else f"if(char_length(x) >= {LONG}, {long_ratio}D, {ratio}D)"
    lines = pages.select("host", "page", F.explode(F.expr(f"transform(lines, x -> struct({_key('x')} as line, {share} as share))")).alias("l")).select("host", "page", "l.line", "l.share")
    totals = cut(pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")))
    n_hosts = totals.count()
    totals = F.broadcast(totals) if n_hosts <= BROADCAST_ROWS else totals
    same = F.col("host").eqNullSafe(F.col("its_host"))
    of_host = totals.select(F.col("host").alias("its_host"), "pages")
    # Copies of a page count once. Rows bound distinct pages from above, so few lines need the exact count.
    rows = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.max("share").alias("share")).where(F.col("n") >= least)
    maybe = cut(rows.join(of_host, same).where(F.col("n") > F.col("share") * F.col("pages")).select("host", "line", "pages", "share"))
    n_maybe = maybe.count()
    named = maybe.select(F.col("host").alias("its_host"), F.col("line").alias("its_line"), "pages", F.col("share").alias("its_share"))
    named = F.broadcast(named) if n_maybe <= BROADCAST_ROWS else named
    exact = lines.join(named, same & (F.col("line") == F.col("its_line"))).select("host", "line", "pages", "its_share", "page").distinct()
    exact = exact.groupBy("host", "line", "pages", "its_share").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") > F.col("its_share") * F.col("pages")))
    return cut(exact.groupBy("host").agg(F.collect_set("line").alias("lines")))


def dedup_lines(
    documents: DataFrame, *, text_col: str = "text", host_col: str | None = "source", url_col: str | None = None, ratio: float = RATIO, least: int = LEAST,
    long_ratio: float | None = None, spare: bool = True,
) -> DataFrame:
    """The documents, all columns, with the boilerplate lines of their host cut from the text, and two columns more:
    n_lines (lines that are not blank) and n_dropped.

    The host is `host_col`, or the host part of `url_col`. A line is what newlines separate, compared without spaces around
    it; blank lines are never counted or dropped. A line is boilerplate if at least `least` of its host's distinct pages and
    more than `ratio` of them (`long_ratio`, if given, for lines of LONG characters or more) contain it; identical pages count once. A page that consists of such lines alone is left as it
    is: it holds nothing that they could frame; without `spare` they go from it, too. Null texts stay null with 0 lines; documents without a host share one, the
    null host. Repeated rows each give a row; an empty table gives none. Columns named n_lines or n_dropped are replaced.
    """
    host = F.col(host_col) if host_col else F.lower(F.regexp_extract(F.col(url_col or "url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    text = F.col(text_col)
    found = boilerplate(documents, host, text, ratio=ratio, least=least, long_ratio=long_ratio)
    size = found.agg(F.coalesce(F.sum(F.size("lines") + 1), F.lit(0))).first()[0]
    base = documents.drop("n_lines", "n_dropped")
    columns = base.columns
    mine = base.withColumn("__host", host)
    side = found.select(F.col("host").alias("__of"), F.col("lines").alias("__bad"))
    if size <= BROADCAST_ROWS // 4:
        joined = mine.join(F.broadcast(side), F.col("__host").eqNullSafe(F.col("__of")), "left")
    else:
        salted = side.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = mine.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        joined = mine.join(salted, F.col("__host").eqNullSafe(F.col("__of")) & (F.col("__salt") == F.col("__salt2")), "left")
    parts = joined.withColumn("__all", F.split(text, "\n"))
    parts = parts.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__all")).otherwise(F.expr(f"filter(__all, x -> trim(x) = '' or not array_contains(__bad, {_key('trim(x)')}))")))
    full = "size(filter({}, x -> trim(x) <> ''))"
    parts = parts.withColumns({"__n": F.when(text.isNull(), 0).otherwise(F.expr(full.format("__all"))).cast("long"), "__m": F.when(text.isNull(), 0).otherwise(F.expr(full.format("__kept"))).cast("long")})
    spared = (F.col("__m") == 0) if spare else F.lit(False)
    return parts.select(
        *[(F.when(spared | (F.col("__n") == F.col("__m")), text).otherwise(F.array_join("__kept", "\n")).alias(c) if c == text_col else F.col(c)) for c in columns],
        F.col("__n").alias("n_lines"), F.when(spared, F.lit(0).cast("long")).otherwise(F.col("__n") - F.col("__m")).alias("n_dropped"),
    )


#: The query's result for `documents` in DuckDB.
ORACLE_SQL = f"""
with pages as (select source, text, md5(text) as page, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) as lines
               from documents where text is not null),
totals as (select source, count(distinct page) as pages from pages group by source),
counts as (select source, line, count(distinct page) as n from (select source, page, unnest(lines) as line from pages) group by source, line),
bad as (select c.source, list(c.line) as lines from counts c join totals t on c.source is not distinct from t.source
        where c.n >= {LEAST} and c.n > (case when length(c.line) >= {LONG} then {LONG_RATIO} else {RATIO} end) * t.pages group by c.source),
parts as (select d.*, string_split(d.text, chr(10)) as a, list_filter(string_split(d.text, chr(10)), lambda x: trim(x, ' ') = '' or not coalesce(list_contains(b.lines, trim(x, ' ')), false)) as k
          from documents d left join bad b on d.source is not distinct from b.source),
sized as (select *, coalesce(len(list_filter(a, lambda x: trim(x, ' ') <> '')), 0) as n, coalesce(len(list_filter(k, lambda x: trim(x, ' ') <> '')), 0) as m from parts)
select doc_id, case when n = m then text else array_to_string(k, chr(10)) end as text, cast(n as bigint) as n_lines, cast(n - m as bigint) as n_dropped from sized
"""
