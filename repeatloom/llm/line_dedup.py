"""Line dedup by site-relative frequency.

A line is boilerplate of a site if more than ``ratio`` of the site's pages hold it.  Lines are counted as 128-bit
hashes, once per page, with a map-side sum, so a line that all pages of a hot site share is a few rows per task; text
is shuffled once, when the lines go.  Where copies are yet to be removed, all copies of a text can count as one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatloom.llm.rows import free_name, quoted

#: Pages that a line needs besides its share; one floor for the query, its SQL and the pipeline.  It binds only in sites
#: of fewer than MIN_PAGES / ratio pages.
MIN_PAGES = 2


def line_key(line: Column) -> Column:
    """Hash of a line without the blanks around it."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("k1"), F.xxhash64(F.lit(1), bare).alias("k2"))


def text_lines(text: Column) -> Column:
    """Lines of a text; null has none."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def site_lines(df: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """``id, site, k1, k2``: the distinct lines of each page, blank ones left out; pages without site have none."""
    full = F.filter(text_lines(quoted(text_col)), lambda x: F.trim(x) != "")
    return df.where(quoted(site_col).isNotNull()).select(
        quoted(id_col).alias("id"), quoted(site_col).alias("site"),
        F.inline(F.array_distinct(F.transform(full, line_key))))


def texts_once(df: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """``site, lines``: the distinct line keys of each distinct whole text of a site; no text is shuffled for it."""
    text = quoted(text_col)
    full = F.filter(text_lines(text), lambda x: F.trim(x) != "")
    return df.where(quoted(site_col).isNotNull()).groupBy(
        quoted(site_col).alias("site"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")).agg(
        F.first(F.array_distinct(F.transform(full, line_key))).alias("lines"))


def boilerplate(
    df: DataFrame, id_col: str, site_col: str, text_col: str, ratio: float, min_pages: int, copies_once: bool = False,
) -> DataFrame:
    """``site, k1, k2`` of lines on more than ``ratio`` of the site's pages and on ``min_pages`` pages at least."""
    sited, site = df.where(quoted(site_col).isNotNull()), quoted(site_col).alias("site")
    if copies_once:
        text = quoted(text_col)
        pages = sited.select(site, F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")).distinct()
        lines = texts_once(df, site_col, text_col).select("site", F.inline("lines"))
    else:
        pages = sited.select(site)
        lines = site_lines(df, id_col, site_col, text_col)
    pages = pages.groupBy("site").agg(F.count("*").alias("pages"))
    lines = lines.groupBy("site", "k1", "k2").agg(F.count("*").alias("with_line"))
    return (
        lines.where(F.col("with_line") >= min_pages).join(pages, "site")
        .where(F.col("with_line") > ratio * F.col("pages")).select("site", "k1", "k2"))


def drop_boilerplate(
    df: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", ratio: float = 0.1,
    min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None, copies_once: bool = False,
) -> DataFrame:
    """``df`` with its columns, the text without the boilerplate lines of its site.

    Every row stays, also one whose lines are all boilerplate (its text becomes empty).  Blank lines stay and are not
    counted; lines are compared without the blanks around them.  A null text stays null, a page without site keeps
    all lines, a repeated row is one page more; with ``copies_once`` all rows of one text are one page of their site, in
    both counts, so that a text's own copies don't take its lines.  ``counts`` names two more columns: how many non-blank lines the page had and how many went.
    Extra columns of any name pass through.
    """
    bad = boilerplate(df, id_col, site_col, text_col, ratio, min_pages, copies_once)
    keys = ["site", "k1", "k2"]
    gone, site, key = (free_name(df, n) for n in ("_gone", "_site", "_id"))
    dropped = (
        site_lines(df, id_col, site_col, text_col).join(bad, keys, "left_semi")
        .groupBy(F.col("id").alias(key), F.col("site").alias(site))
        .agg(F.collect_set(F.struct("k1", "k2")).alias(gone)))
    joined = df.join(dropped, quoted(id_col).eqNullSafe(F.col(key)) & (quoted(site_col) == F.col(site)), "left")
    lines = text_lines(quoted(text_col))
    is_gone = lambda x: (F.trim(x) != "") & F.array_contains(F.col(gone), line_key(x))
    kept = F.when(F.col(gone).isNull(), quoted(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda x: ~is_gone(x)), "\n"))
    more = {} if counts is None else {
        counts[0]: F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long"),
        counts[1]: F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(lines, is_gone))).cast("long")}
    return joined.select(
        *[(kept.alias(c) if c == text_col else quoted(c)) for c in df.columns],
        *[c.alias(n) for n, c in more.items()])


#: Elements that end a line when a page is read as text.
_BLOCKS = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|"
           "head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul")
SKIPPED = r"(?is)<(?:script[^>]*>.*?</script>|style[^>]*>.*?</style>|!--.*?-->|!doctype[^>]*>)"
BREAKS = rf"(?i)</?({_BLOCKS})([\s/][^>]*)?>"
TAGS = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"


def html_lines(html: Column) -> Column:
    """Text of a page, one line per block element; scripts, styles and comments are left out."""
    text = F.regexp_replace(html, SKIPPED, "")
    return F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")


def host(url: Column) -> Column:
    """Lower-case host of a URL, null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))
