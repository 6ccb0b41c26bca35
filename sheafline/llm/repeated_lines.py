"""Lines that one source repeats over many of its pages, found by PrefixSpan and removed.

Each page is a sequence of line identifiers. The first level of PrefixSpan keeps the lines
that stand on enough different pages of their source; every further level projects the
pages on the frequent sequences and extends them by each frequent line that comes later,
until no sequence is frequent. The run returns the places of the lines of its sequences,
which are taken out of each page's text. As each line of a frequent sequence is frequent
itself, the first level has all places already: who asks for places only stops there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.functions.text import line_key, lines, source_key
from sheafline.plans.storage import small_or_shuffled, stored
from sheafline.sources.tables import table

PAGE = ("stream_id", "original_position")


def page_lines(pages: DataFrame) -> DataFrame:
    """Stored ``source, page, stream_id, original_position, line_no, line`` of each non-empty line.

    Source, page and line are 64-bit hashes: texts are read once and never shuffled.
    """
    keyed = pages.select(source_key("source").alias("source"), F.xxhash64(*PAGE).alias("page"), *PAGE, F.transform(lines("text"), lambda x: _hashed(x)).alias("l"))
    return stored(keyed.where("source is not null").select(F.xxhash64("source").alias("source"), "page", *PAGE, F.posexplode("l").alias("line_no", "line")).where("line is not null"))


def _hashed(line: Column) -> Column:
    key = line_key(line)
    return F.when(key != "", F.xxhash64(key))


def frequent_lines(placed: DataFrame, min_pages: int) -> DataFrame:
    """``source, line, pages``: level one, lines on at least ``min_pages`` different pages of a source."""
    rows = placed.select("source", "line", "page")
    # rows bound pages from above: partial counts thin out the pairs before pages are told apart
    often = rows.groupBy("source", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).drop("n")
    often = stored(often)
    n = often.count()
    exact = rows.join(small_or_shuffled(often, n), ["source", "line"]).distinct().groupBy("source", "line").agg(F.count("*").alias("pages"))
    return stored(exact.where(F.col("pages") >= min_pages))


def occurrences(placed: DataFrame, frequent: DataFrame) -> DataFrame:
    """Places of frequent lines: ``stream_id, original_position, line_no, source, page, line``."""
    return placed.join(small_or_shuffled(frequent.select("source", "line")), ["source", "line"])


def prefix_span(pages: DataFrame, min_pages: int = 10, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Places of all lines of frequent sequences (as ``occurrences``), and the sequences up to length
    ``levels`` (None: all) as ``source, length, pages, sequence``.

    A sequence is frequent when it stands on at least ``min_pages`` different pages of a source,
    other lines in between or not; ``sequence`` is the hash of the line hashes. A page is
    projected on the first place where a sequence ends and adds at most one row for each of its
    frequent sequences at each level. The places are the same for any number of levels.
    """
    placed = page_lines(pages)
    frequent = frequent_lines(placed, min_pages)
    places = occurrences(placed, frequent)
    out = frequent.select("source", F.lit(1).alias("length"), "pages", F.col("line").alias("sequence"))
    if levels == 1:
        return places, out
    steps = stored(places.select("source", "page", "line_no", F.col("line").alias("step")).distinct())
    projected = steps.groupBy("source", "page", F.col("step").alias("sequence")).agg(F.min("line_no").alias("at"))
    length = 1
    while length != levels:
        length += 1
        later = projected.join(steps, ["source", "page"]).where(F.col("line_no") > F.col("at"))
        grown = stored(later.groupBy("source", "page", F.xxhash64("sequence", "step").alias("sequence")).agg(F.min("line_no").alias("at")))
        support = stored(grown.groupBy("source", "sequence").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages))
        n = support.count()
        if not n:
            break
        out = out.unionByName(support.select("source", F.lit(length).alias("length"), "pages", "sequence"))
        projected = grown.join(small_or_shuffled(support.select("source", "sequence"), n), ["source", "sequence"])
    return places, out


def frequent_sequences(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """``source, length, pages, sequence``: all frequent sequences."""
    return prefix_span(pages, min_pages)[1]


def repeated_lines(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """Distinct ``stream_id, original_position, line_no`` of the lines of frequent sequences.

    Nulls: pages without a source, position or text give nothing; blank lines never count.
    Pages delivered twice count once. Pages and lines of any length are read whole. An empty
    table gives an empty result. Only the named columns are read.
    """
    pages = pages.select(*PAGE, "source", F.col("text").cast("string").alias("text"))
    return prefix_span(pages, min_pages, levels=1)[0].select(*PAGE, "line_no").distinct()


def without_repeated_lines(pages: DataFrame, min_pages: int = 10) -> DataFrame:
    """Every page once for each distinct text, with the repeated lines of its source taken out."""
    pages = pages.select(*PAGE, "source", F.col("text").cast("string").alias("text"))
    drop = prefix_span(pages, min_pages, levels=1)[0].select(*PAGE, F.col("source").alias("of"), "line_no").distinct().groupBy(*PAGE, "of").agg(F.collect_set("line_no").alias("drop"))
    keyed = pages.select(*PAGE, "text", F.xxhash64(source_key("source")).alias("of")).distinct()
    same = [keyed[c].eqNullSafe(drop[c]) for c in (*PAGE, "of")]
    joined = keyed.join(drop, same, "left").select(*[keyed[c] for c in PAGE], keyed["text"], drop["drop"])
    kept = F.filter(lines("text"), lambda line, i: ~F.array_contains("drop", i))
    return joined.select(*PAGE, F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "stream_pages", *PAGE, "source", "text"))


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(table(spark, folder, "stream_pages", *PAGE, "source", "text"))


def p3_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Number and support of the frequent sequences by length."""
    found = frequent_sequences(table(spark, folder, "stream_pages", *PAGE, "source", "text"))
    return found.groupBy("length").agg(F.count("*").alias("sequences"), F.max("pages").alias("most_pages"))


_LINES = r"""
with p as (select distinct stream_id, original_position, trim(lower(trim(source, chr(32) || chr(9) || chr(10) || chr(13)))) s, string_split(text, chr(10)) l, text from stream_pages where text is not null),
     x as (select *, unnest(range(0, len(l))) line_no from p),
     k as (select stream_id, original_position, s, line_no, text,
                  regexp_replace(lower(regexp_replace(regexp_replace(l[line_no + 1], '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g'),
                      '[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') line from x where s <> ''),
     f as (select s, line from (select distinct s, line, stream_id, original_position from k where line <> '') group by s, line having count(*) >= 10),
     o as (select distinct stream_id, original_position, line_no from k join f using (s, line))
"""
QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_sequences": p3_sequences}
SQL = {
    "p3_found": _LINES + "select stream_id, original_position, cast(line_no as int) line_no from o",
    "p3_clean": _LINES
    + """, kept as (select stream_id, original_position, text, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) line_no
                   from (select distinct stream_id, original_position, text from stream_pages where text is not null)),
          t as (select stream_id, original_position, text, coalesce(string_agg(line, chr(10) order by line_no) filter (where o.line_no is null), '') clean
                from kept left join o using (stream_id, original_position, line_no) group by all)
       select stream_id, original_position, clean as text from t
       union select stream_id, original_position, text from stream_pages where text is null""",
    # every subsequence of the frequent lines of a page, counted
    "p3_sequences": _LINES.replace("with p", "with recursive p", 1)
    + """, c as (select distinct s, stream_id, original_position, line_no, f.line from k join f using (s, line)),
          q as (select s, stream_id, original_position, line_no, [line] as sequence from c
                union select q.s, q.stream_id, q.original_position, c.line_no, list_append(q.sequence, c.line) from q join c
                on q.s = c.s and q.stream_id = c.stream_id and q.original_position = c.original_position and c.line_no > q.line_no),
          n as (select s, sequence, count(distinct (stream_id, original_position)) pages from q group by all having pages >= 10)
       select cast(len(sequence) as int) as length, count(*) as sequences, max(pages) as most_pages from n group by all""",
}
