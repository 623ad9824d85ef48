"""String expressions over document text.  All JVM-side, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant import vocab

ELLIPSIS = "…"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode white space (plain ``trim`` removes spaces only)."""
    return F.btrim(col(c), F.lit(vocab.WHITESPACE))


def strip_start(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(vocab.WHITESPACE))


def strip_end(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(vocab.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only.  Never null itself."""
    return F.coalesce(F.length(strip_start(c)) == 0, F.lit(True))


def left(c: Column | str, n: Column | int) -> Column:
    return F.left(col(c), n if isinstance(n, Column) else F.lit(n))


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def tail_of(items: Column) -> Column:
    """All elements but the first."""
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def one_line(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))


# ── cleaning ──────────────────────────────────────────────────────────────────


def cleanup_page_artifacts(c: Column | str) -> Column:
    """Split run-together digits and letters that page layout produced."""
    c = col(c)
    out = F.regexp_replace(c, r"([0-9])([A-Za-z])", "$1 $2")
    out = F.regexp_replace(out, r"Gbps([0-9])", "Gbps $1")
    out = F.regexp_replace(out, r"Mbps([0-9])", "Mbps $1")
    out = F.regexp_replace(out, r"([A-Za-z])([0-9])([A-Za-z])", "$1 $2 $3")
    out = strip(F.regexp_replace(out, r" {2,}", " "))
    return F.when(is_blank(c), c).otherwise(out)


def normalize_text(c: Column | str, paged: Column | bool = False) -> Column:
    """Uniform line ends, no tabs, at most one blank line, single spaces inside a line.

    ``paged`` says that the whole document had page markers, in which case the
    page artifacts are cleaned as well.
    """
    out = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.replace(out, F.lit("\t"), F.lit("    "))
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?<!\n) {2,}", " ")
    if isinstance(paged, Column):
        out = F.when(paged, cleanup_page_artifacts(out)).otherwise(out)
    elif paged:
        out = cleanup_page_artifacts(out)
    return strip(out)


def join_model_suffix(c: Column | str) -> Column:
    """Re-join a model letter that page layout split off: ``FG-120 G`` becomes ``FG-120G``."""
    c = col(c)
    out = F.regexp_replace(c, r"\b(FG|FWF)-([0-9]+)\s+([A-Z])\b", "$1-$2$3")
    out = F.regexp_replace(out, r"\b(FG/FWF)-([0-9]+)\s+([A-Z])\b", "$1-$2$3")
    return F.when(is_blank(c), c).otherwise(out)


def escape_cell(c: Column | str) -> Column:
    return strip(one_line(F.replace(F.coalesce(col(c), F.lit("")), F.lit("|"), F.lit("\\|"))))


# ── shortening ────────────────────────────────────────────────────────────────


def preview(c: Column | str, n: int) -> Column:
    clean = strip(one_line(c))
    return (F.when(is_blank(c), F.lit(""))
            .when(F.length(clean) > n, F.concat(left(clean, n), F.lit(ELLIPSIS)))
            .otherwise(clean))


def truncate_text(c: Column | str, n: int) -> Column:
    return F.when(is_blank(c), F.lit("")).otherwise(left(c, n))


def truncate_or_null(c: Column | str, n: int) -> Column:
    return F.when(F.length(col(c)) > 0, left(c, n))


def conversation_title(c: Column | str) -> Column:
    flat = F.replace(F.replace(col(c), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    title = strip(flat)
    return (F.when(is_blank(c), F.lit(vocab.NEW_CONVERSATION_TITLE))
            .when(F.length(title) > 42, F.concat(strip(left(title, 42)), F.lit("...")))
            .otherwise(title))


def token_estimate(c: Column | str) -> Column:
    quarter = F.ceil(F.length(col(c)) / F.lit(4.0)).cast("int")
    return F.when(is_blank(c), F.lit(0)).otherwise(F.greatest(F.lit(1), quarter))


# ── structure ─────────────────────────────────────────────────────────────────


def detect_heading(c: Column | str) -> Column:
    """Heading of a chunk, judged on its first non-empty line."""
    line = strip(F.regexp_extract(col(c), r"^\n*([^\n]+)", 1))
    # sharp s has no single-letter capital and must not count as lower case
    caps = F.replace(line, F.lit("ß"), F.lit(""))
    return (F.when((F.length(line) == 0) | (F.length(line) > 120), F.lit(None).cast("string"))
            .when(line.rlike(r"^([0-9]+\.)+\s*\S"), left(line, 100))
            .when((F.length(line) <= 80) & (F.upper(caps) == caps) & line.rlike(r"\p{L}"), line)
            .when(F.endswith(line, F.lit(":")) & (F.length(line) <= 80), F.rtrim(line, F.lit(":"))))


def count_pages(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(vocab.PAGE_MARKER))


def has_page_marker(c: Column | str) -> Column:
    return col(c).rlike(vocab.PAGE_MARKER)


def separator_from_header(c: Column | str) -> Column:
    parts = F.filter(F.split(col(c), r"\|", -1), lambda p: F.length(p) > 0)
    dashes = F.transform(parts, lambda p: F.repeat(F.lit("-"), F.greatest(F.lit(3), F.length(strip(p)))))
    return F.concat(F.lit("| "), F.array_join(dashes, " | "), F.lit(" |"))


def last_index(c: Column | str, needle: str) -> Column:
    """0-based position of the last occurrence, -1 when absent."""
    c = col(c)
    p = F.instr(F.reverse(c), needle[::-1])
    return F.when(p > 0, F.length(c) - p - len(needle) + 1).otherwise(F.lit(-1))


def best_split(c: Column | str, limit: int) -> Column:
    """Where to cut a full window: paragraph, sentence, line or word end in its second half."""
    half = limit // 2
    paragraph = last_index(c, "\n\n")
    sentence = F.greatest(last_index(c, ". "), last_index(c, "! "), last_index(c, "? "))
    line, space = last_index(c, "\n"), last_index(c, " ")
    return (F.when(paragraph > half, paragraph).when(sentence > half, sentence + 1)
            .when(line > half, line).when(space > half, space).otherwise(F.lit(-1)))


def is_pipe_row(line: Column) -> Column:
    """A line that starts and ends with a pipe once outer white space is gone."""
    t = strip(line)
    return F.startswith(t, F.lit("|")) & F.endswith(t, F.lit("|"))


def structure_type(document_type: Column | str, text: Column | str) -> Column:
    """Spreadsheet, Table, Mixed or Unstructured."""
    all_lines = lines(text)
    share = F.size(F.filter(all_lines, is_pipe_row)) / F.size(all_lines)
    return (F.when(col(document_type).isin(vocab.TABLE_DOCUMENT_TYPES), F.lit("Spreadsheet"))
            .when(is_blank(text), F.lit("Unstructured"))
            .when(share >= 0.6, F.lit("Table")).when(share >= 0.2, F.lit("Mixed"))
            .otherwise(F.lit("Unstructured")))


def sniff_delimiter(line: Column | str) -> Column:
    """Tab, semicolon or comma; tab wins ties, also when none occurs."""
    line = col(line)
    tab, semi, comma = (F.regexp_count(line, F.lit(p)) for p in ("\t", ";", ","))
    return (F.when((tab >= semi) & (tab >= comma), F.lit("\t"))
            .when(semi > comma, F.lit(";")).otherwise(F.lit(",")))


# ── item counts ───────────────────────────────────────────────────────────────


def count_source_rows(c: Column | str) -> Column:
    """Table rows in a text: lines between pipes that are not header rules."""
    return F.size(F.filter(lines(c), lambda x: is_pipe_row(x)
                           & (F.length(F.translate(strip(x), "|-: ", "")) > 0)))


def count_response_items(c: Column | str) -> Column:
    """List items, numbered items and table rows in an answer."""
    def item(x: Column) -> Column:
        t = strip_start(x)
        return (t.rlike(r"^[-*•] ") | t.rlike(r"^\s*[0-9]+[.)]\s+\S") | is_pipe_row(x))
    return F.when(is_blank(c), F.lit(0)).otherwise(F.size(F.filter(lines(c), item)))


# ── patterns ──────────────────────────────────────────────────────────────────


def all_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def distinct_ignoring_case(items: Column) -> Column:
    """First spelling of each item, in encounter order (arrays of one row only)."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def identifiers(c: Column | str) -> Column:
    """Circuit codes and IPv4-shaped tokens in a query, first spelling of each."""
    return distinct_ignoring_case(all_matches(c, vocab.IDENTIFIER))


def model_codes(c: Column | str) -> Column:
    return all_matches(c, vocab.MODEL_CODE)


def ipv4_addresses(c: Column | str) -> Column:
    return all_matches(c, vocab.IPV4)
